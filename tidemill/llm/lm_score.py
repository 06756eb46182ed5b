"""Hashed maximum-entropy language model: n-gram and skip features, softmax factored by classes, trained by distributed
gradient updates and scored in sparse numpy batches.

P(token | context) = P(class | context) * P(member | class, context) * P(token | member). Both softmaxes are log-linear in
hashed features of the two tokens before: the last one, the one before it (skip), and, for the class, both. A class's most
frequent words are members of their own, all others are its last member, in which counts decide. Every count covers all
training documents:

* tokens are known by 64-bit hashes; their counts stay a distributed table;
* the `head` most frequent of those counted twice or more go to every worker with their class: a table of fixed size;
* all others form the rare class, with the unseen type, which gets what absolute discounting takes from their counts;
  the rare tokens of a document meet their counts in a join.

A context sees a token as itself if it is among the `top` ones, else as its last two bytes. Classes are k-means clusters
of these items by the frequent words that they follow.

Documents are dealt to learners by a hash of doc_id and text, so the model and every score hang on the rows alone and not
on files, partitions or the order in which tasks end. Learners and feature rows grow with the training tokens and types,
the rows up to 2^15 (4 MB a worker).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt, scratch, text_bytes, trim
from .shingles import SPACE, STEPS, TABLE, mix

END = np.uint64(0x0123456789ABCDEF)
SUFFIXES = 1024
BUCKET_BITS = 22
INNER_BITS = 14
GOLD = np.uint64(0x9E3779B97F4A7C15)
LN10 = math.log(10)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and suffix numbers of the documents' tokens, an end after each document, and where each document ends."""
    joined = b"\n".join(raws) + b"\n"
    x = np.frombuffer(joined.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[x]])))
    start, end = edge[::2], edge[1::2]
    up, down = STEPS.get(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(TABLE[x] * up[: len(x)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    suffix = (x[end - 1].astype(np.int32) * 61 + x[np.maximum(end - 2, start)].astype(np.int32) * 17) % SUFFIXES
    stop = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))
    return np.insert(h, stop, END), np.insert(suffix, stop, 0), stop + np.arange(1, len(raws) + 1)


def groups(batches, columns: int, size: int = 1 << 19):
    """Rows of Arrow batches, gathered to about `size` bytes of text; the text is the last column."""
    held, n = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            held.append(row)
            n += len(row[-1])
            if n >= size:
                yield list(zip(*held))
                held, n = [], 0
    if held:
        yield list(zip(*held))


class Head:
    """Frequent tokens: sorted hashes with count, class, item and member, found through a table of first places."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, items: np.ndarray, members: np.ndarray | None = None) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts, self.classes, self.items = hashes[order], counts[order], classes[order], items[order]
        self.members = np.zeros(len(order), np.uint8) if members is None else members[order]
        self.first = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is none of them."""
        if self.first is None:
            self.first = np.searchsorted(self.hashes, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            self.first[-1] = len(self.hashes)
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, last = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        live = np.flatnonzero(at < last)
        while len(live):
            hit = self.hashes[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < last[live]]
        return out


def scores(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the weights of each column of rows, and a bias; far from what exp() can hold."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    return np.minimum(z, 80, out=z)


def chances(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def log_chances(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log of chances(z) at one place of each row."""
    own = z[np.arange(len(z)), of].astype(float)
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def descend(weights: np.ndarray, past: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One minibatch step: the gradient of each row, scaled by the root of its squared lengths so far."""
    for r in rows:
        short = r.astype(np.uint16) if len(weights) <= 1 << 16 else r
        order = np.argsort(short, kind="stable")
        short = short[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        at = short[first].astype(np.int64)
        step = np.add.reduceat(np.take(g, order, axis=0), first, axis=0)
        past[at] = squares = past[at] + np.einsum("ij,ij->i", step, step)
        weights[at] -= step * (rate / np.sqrt(squares + 1e-3))[:, None]
        seen[at] += np.diff(np.append(first, len(r)))


class Net:
    """The class softmax: rows of weights for hashed features, and a bias. The softmax over a class's members: rows for
    hashed features of the class, and a bias for each class."""

    def __init__(self, classes: int, bits: int, top: int, members: int = 32) -> None:
        self.classes, self.bits, self.top, self.members = classes, bits, top, members
        self.rows = (1 << bits) + 2 * (top + SUFFIXES)
        self.bias = np.zeros(classes, np.float32)
        self.weights = np.zeros((self.rows, classes), np.float32)
        self.inner_bias = np.zeros((classes, members), np.float32)
        self.inner = np.zeros((1 << min(bits, INNER_BITS), members), np.float32)

    def before(self, items: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last item and the one before it; what stands before a document is its end token, item 0."""
        one, two = np.concatenate([[0], items[:-1]]), np.concatenate([[0, 0], items[:-2]])[: len(items)]
        begin = np.concatenate([[0], stops[:-1]])
        one[begin] = two[begin] = 0
        second = begin + 1
        two[second[second < np.append(begin[1:], len(items))]] = 0
        return one, two

    def features(self, items: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Three rows for each token."""
        one, two = self.before(items, stops)
        n = self.top + SUFFIXES
        both = ((one.astype(np.uint64) * np.uint64(n) + two.astype(np.uint64)) * GOLD) >> np.uint64(64 - self.bits)
        return np.stack([one, n + two, 2 * n + both.astype(np.int64)])

    def inner_features(self, f: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Two rows of the members' weights: of the last item, and of the one before it, each with the class."""
        seen = f[:2].astype(np.uint64) * np.uint64(self.classes) + kinds.astype(np.uint64)
        return ((seen * GOLD) >> np.uint64(64 - min(self.bits, INNER_BITS))).astype(np.int64)

    def log_softmax(self, f: np.ndarray) -> np.ndarray:
        return np.log(chances(scores(self.weights, f, self.bias)))

    def inner_softmax(self, f: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(chances(scores(self.inner, self.inner_features(f, kinds), self.inner_bias[kinds])), 1e-38))

    def update(self, f: np.ndarray, kinds: np.ndarray, past: np.ndarray, seen: np.ndarray, rate: float) -> None:
        g = chances(scores(self.weights, f, self.bias))
        g[np.arange(len(kinds)), kinds] -= 1
        descend(self.weights, past, seen, f, g, rate)

    def update_inner(self, f: np.ndarray, kinds: np.ndarray, members: np.ndarray, past: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """As update(), for the tokens of classes with members."""
        some = np.flatnonzero(kinds)
        if len(some):
            rows = self.inner_features(f[:, some], kinds[some])
            g = chances(scores(self.inner, rows, self.inner_bias[kinds[some]]))
            g[np.arange(len(some)), members[some]] -= 1
            descend(self.inner, past, seen, rows, g, rate)

    def log_chance(self, f: np.ndarray, kinds: np.ndarray, members: np.ndarray) -> np.ndarray:
        """log P(class | context), and for tokens of classes with members log P(member | class, context) too."""
        out = log_chances(scores(self.weights, f, self.bias), kinds)
        some = np.flatnonzero(kinds)
        if len(some):
            out[some] += log_chances(scores(self.inner, self.inner_features(f[:, some], kinds[some]), self.inner_bias[kinds[some]]), members[some])
        return out


def count(train: DataFrame) -> DataFrame:
    """hash, suffix, n of every token of the training documents; tasks sum up some million tokens before the shuffle."""

    def of(batches):
        for (raws,) in groups(batches, 1, 1 << 24):
            hs, ss = [], []
            for i in range(0, len(raws), 256):
                h, s, _ = tokens(list(raws[i : i + 256]))
                hs.append(h)
                ss.append(s)
            u, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(ss)[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["hash", "suffix", "n"])
            del hs, ss, u, first, n
        trim()

    return scratch(train.select("raw").mapInArrow(of, "hash long, suffix int, n long").groupBy("hash").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n")), "lm-counts")


def merged(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of equally named blocks of numbers (block, task, raw), in the order of task, so that reruns agree to the last
    digit; in two steps, so that no task meets all parts."""

    def total(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        raws = group.column("raw").to_pylist()
        out = np.frombuffer(raws[0], np.float32).copy()
        for r in raws[1:]:
            out += np.frombuffer(r, np.float32)
        return pa.table({"block": group.column("block")[:1], "task": group.column("task")[:1], "raw": pa.array([out.tobytes()], pa.binary())})

    some = parts.withColumn("some", (F.col("task") % 32).cast("int")).groupBy("block", "some").applyInArrow(total, "block int, task int, raw binary")
    rows = some.groupBy("block").applyInArrow(total, "block int, task int, raw binary").toArrow()
    return {b: np.frombuffer(r, np.float32) for b, r in zip(rows.column("block").to_pylist(), rows.column("raw").to_pylist())}


def blocks(array: np.ndarray, task: int, rows: int = 256):
    for b in range(0, len(array), rows):
        if array[b : b + rows].any():
            yield pa.RecordBatch.from_arrays([pa.array([b // rows], pa.int32()), pa.array([task], pa.int32()), pa.array([array[b : b + rows].astype(np.float32).tobytes()], pa.binary())], ["block", "task", "raw"])


def gathered(found: dict[int, np.ndarray], shape: tuple[int, int], rows: int = 256) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    for b, part in found.items():
        part = part.reshape(-1, shape[1])
        out[b * rows : b * rows + len(part)] = part
    return out


def cluster(vectors: np.ndarray, sizes: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means with weights; the heaviest rows begin, far ones first."""
    x = np.sqrt(vectors / np.maximum(vectors.sum(axis=1, keepdims=True), 1e-9))
    centre = [int(np.argmax(sizes))]
    near = ((x - x[centre[0]]) ** 2).sum(axis=1)
    for _ in range(min(k, len(x)) - 1):
        centre.append(int(np.argmax(near * np.sqrt(sizes))))
        near = np.minimum(near, ((x - x[centre[-1]]) ** 2).sum(axis=1))
    c, of = x[centre], np.zeros(len(x), np.int64)
    for _ in range(rounds):
        of = np.argmax(x @ c.T - (c**2).sum(axis=1) / 2, axis=1)
        for j in range(len(c)):
            mine = of == j
            if sizes[mine].sum() > 0:
                c[j] = np.average(x[mine], axis=0, weights=sizes[mine])
    return of


class Model:
    """Words and weights that score a token (sent to every worker), and the corpus figures behind them."""

    def __init__(self, words: Head, net: Net, mass: np.ndarray, rest: np.ndarray, top: int) -> None:
        self.words, self.net, self.mass, self.rest, self.top = words, net, mass, rest, top

    def look(self, raws) -> tuple[np.ndarray, ...]:
        """Of the documents' tokens: hash, place among the words (-1: none), item, class, member, and where documents end."""
        h, s, stops = tokens(list(raws))
        w = self.words
        at = w.find(h)
        if not len(w.hashes):
            none = np.zeros(len(h), np.int64)
            return h, at, self.top + s, none, none, stops
        hit = at >= 0
        return h, at, np.where(hit, w.items[at], self.top + s), np.where(hit, w.classes[at], 0).astype(np.int64), np.where(hit, w.members[at], 0).astype(np.int64), stops

    def log_chance(self, at: np.ndarray, item: np.ndarray, kind: np.ndarray, member: np.ndarray, stops: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Natural log of each token's chance; for tokens of the rare class that of the class alone."""
        f, out = self.net.features(item, stops), np.empty(len(item))
        for i in range(0, len(item), batch):
            part = slice(i, i + batch)
            out[part] = self.net.log_chance(f[:, part], kind[part], member[part])
        late = np.flatnonzero((at >= 0) & (member == 0))
        out[late] += np.log(self.words.counts[at[late]] / self.rest[kind[late]])
        return out


def learnt(train: DataFrame, model: Model, learners: int, rounds: int, batch: int, rate: float) -> Model:
    """Rounds over all training documents: every learner starts from the same weights and passes over its documents in
    the order of a hash, and the learners' weights are averaged row by row, by how often each met the row."""
    spark, first = train.sparkSession, model.net
    names = ("weights", "inner")

    def own(net: Net) -> Net:
        out = Net(net.classes, net.bits, net.top, net.members)
        out.bias, out.inner_bias = net.bias, net.inner_bias
        out.weights, out.inner = net.weights.copy(), net.inner.copy()
        return out

    order = F.xxhash64("doc_id", "raw")
    dealt = train.select(F.pmod(order, F.lit(learners)).cast("int").alias("learner"), order.alias("order"), "doc_id", "raw")
    dealt = dealt.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "order", "doc_id").select("learner", "raw")
    shapes = [getattr(first, n).shape for n in names]
    cut = -(-shapes[0][0] // 256) * 256  # where the members' blocks of rows begin
    wide = max(s[1] for s in shapes) + 1
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches, sent=sent):
            rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for learner, mine in itertools.groupby(rows, key=lambda r: r[0]):
                net = own(sent.value.net)
                past, seen = ([np.zeros(len(getattr(net, n)), np.float32) for n in names] for _ in range(2))
                for raws in gathered_texts(raw for _, raw in mine):
                    _, _, item, kind, member, stops = sent.value.look(raws)
                    f = net.features(item, stops)
                    for i in range(0, len(kind), batch):
                        part = slice(i, i + batch)
                        net.update(f[:, part], kind[part], past[0], seen[0], rate)
                        net.update_inner(f[:, part], kind[part], member[part], past[1], seen[1], rate)
                all_rows = np.zeros((cut + len(net.inner), wide), np.float32)
                for at, n, times in ((0, names[0], seen[0]), (cut, names[1], seen[1])):
                    w = getattr(net, n)
                    all_rows[at : at + len(w), : w.shape[1]] = w * times[:, None]
                    all_rows[at : at + len(w), -1] = times
                del net, past, seen
                yield from blocks(all_rows, learner)
                del all_rows
                trim()

        got = gathered(merged(dealt.mapInArrow(learn, "block int, task int, raw binary")), (cut + shapes[1][0], wide))
        net = own(model.net)
        for at, n in ((0, names[0]), (cut, names[1])):
            w = getattr(net, n)
            part = got[at : at + len(w)]
            met = part[:, -1] > 0
            w[met] = part[met, : w.shape[1]] / part[met, -1:]
        model = Model(model.words, net, model.mass, model.rest, model.top)
    return model


def gathered_texts(raws, size: int = 1 << 19):
    """Lists of texts of about `size` bytes together."""
    held, n = [], 0
    for raw in raws:
        held.append(raw)
        n += len(raw)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Counted:
    """What counting the training documents gives: the table of all types, and totals."""

    def __init__(self, train: DataFrame) -> None:
        self.table = count(train)
        one = self.table.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("n") == 1, 1)).alias("one"), F.sum(F.when(F.col("n") == 2, 1)).alias("two")).first()
        self.tokens, self.types = one["n"] or 0, one["v"] or 0
        singles, twos = one["one"] or 0, one["two"] or 0
        self.discount = singles / (singles + 2 * twos) if singles else 0.5


def fit(train: DataFrame, counted: Counted, classes: int = 32, members: int = 32, head: int = 1 << 20, top: int = 4096, bits: int | None = None, signs: int = 64, rounds: int = 1, batch: int = 4096, rate: float = 0.5, learner_tokens: int = 3_000_000) -> Model:
    """The model of training documents (doc_id, raw). bits: of the hashed rows, by default by the number of types."""
    spark = train.sparkSession
    bits = bits or min(15, max(10, int(counted.types).bit_length() - 5))
    most = counted.table.where("n >= 2").orderBy(F.desc("n"), "hash").limit(head).toArrow()  # at most `head` rows of 20 bytes
    hashes, seen_n, suffix = (most.column(c).to_numpy() for c in ("hash", "n", "suffix"))
    hashes = hashes.view(np.uint64)
    places = np.arange(len(hashes))
    items = np.where(places < top, places, top + suffix)
    at_end = np.flatnonzero(hashes == END)
    if len(at_end) and at_end[0] < top:  # item 0 is the end token
        items[0], items[at_end[0]] = at_end[0], 0
    table = spark.sparkContext.broadcast(Head(hashes, seen_n, np.zeros(len(hashes), np.uint8), items))
    n_items = top + SUFFIXES

    def follow(batches):
        found = np.zeros(n_items * signs, np.int64)
        for (raws,) in groups(batches, 1):
            h, s, _ = tokens(list(raws))
            at = table.value.find(h)
            item = np.where(at >= 0, table.value.items[at], top + s) if len(table.value.hashes) else top + s
            before = np.minimum(np.concatenate([[0], item[:-1]]), signs - 1)
            found += np.bincount(item * signs + before, minlength=len(found))
        yield from blocks(found.reshape(n_items, signs), attempt()[0])

    near = gathered(merged(train.select("raw").mapInArrow(follow, "block int, task int, raw binary")), (n_items, signs))
    of_item = 1 + cluster(near.astype(float), near.sum(axis=1).astype(float) + 1e-9, classes - 1)
    kinds = of_item[items] if len(items) else np.zeros(0, np.int64)
    mass = np.bincount(kinds, seen_n, classes) if len(items) else np.zeros(classes)
    mass[0] = counted.tokens - int(seen_n.sum())
    net = Net(classes, bits, top, members)
    net.bias[:] = np.log((mass + 0.5) / (mass + 0.5).sum())
    of_member, rest = np.zeros(len(hashes), np.uint8), np.maximum(mass, 1.0)
    net.inner_bias[:] = -1e9
    net.inner_bias[:, 0] = 0
    for k in range(1, classes):
        own = np.flatnonzero((kinds == k) & (places < top))[: members - 1]  # the most frequent come first
        of_member[own] = np.arange(1, len(own) + 1)
        left = mass[k] - seen_n[own].sum()
        rest[k] = max(left, 1.0)
        net.inner_bias[k, 1 : len(own) + 1] = np.log(seen_n[own] / max(mass[k], 1.0))
        net.inner_bias[k, 0] = np.log(left / mass[k]) if left > 0 else -1e9 if len(own) else 0
    model = Model(Head(hashes, seen_n, kinds.astype(np.uint8), items, of_member), net, mass, rest, top)
    return learnt(train, model, 1 + counted.tokens // learner_tokens, rounds, batch, rate)


def scored(docs: DataFrame, batch: int = 4096, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null or empty text: the end token alone. Null doc_id: held out (the checksum of no text). Repeated rows: a row each,
    each counted. No training token: base_score is the unseen type's, and every token falls to the rare class. Words are
    64-bit hashes: that any two of v types share one has a chance of about v^2 / 2^65.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    rows = rows.withColumn("out", held_out(F.col("doc_id")))
    train = rows.where(~F.col("out"))
    counted = Counted(train)
    model = fit(train, counted, batch=batch, **options)
    final = spark.sparkContext.broadcast(model)
    n_all, bottom = counted.tokens, counted.tokens + 0.1 * (counted.types + 1)
    rare_n, rare_types, cut = float(model.mass[0]), counted.types - len(model.words.hashes), counted.discount

    def judge(batches):
        part, key = attempt()[0] << 40, 0
        for ids, out, raws in groups(batches, 3):
            m = final.value
            h, at, item, kind, member, stops = m.look(raws)
            score = m.log_chance(at, item, kind, member, stops, batch)
            known = at >= 0
            base = np.zeros(len(h))
            base[known] = np.log10((m.words.counts[at[known]] + 0.1) / bottom)
            begin = np.concatenate([[0], stops[:-1]])
            rare = np.where(known, 0, 1)
            late = np.split(h[~known].view(np.int64), np.cumsum(np.add.reduceat(rare, begin))[:-1])
            n = len(raws)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + key + np.arange(n)), pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(stops - begin, pa.int64()),
                    pa.array(np.add.reduceat(1 - rare, begin), pa.int64()), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(score, begin) / LN10),
                    pa.array([x for x in late], pa.list_(pa.int64())),
                ],
                ["key", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"],
            )
            key += n
        trim()

    main = scratch(rows.select("doc_id", "out", "raw").mapInArrow(judge, "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>"), "lm-scores")
    rare = main.select("key", F.explode("rare").alias("hash")).groupBy("key", "hash").agg(F.count("*").alias("times"))
    met = rare.join(counted.table.select("hash", "n"), "hash", "left")
    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    inside = F.when(F.col("n").isNotNull(), F.col("n") - F.lit(cut)).otherwise(F.lit(max(cut * rare_types, 1e-9 if rare_n else 1.0))) / max(rare_n, 1.0)
    late = met.groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("late_known"),
        F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(bottom))).alias("late_base"),
        F.sum(F.col("times") * F.log10(inside)).alias("late_model"),
    )
    return main.drop("rare").join(late, "key", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("late_model", F.lit(0.0))).alias("score"),
    )
