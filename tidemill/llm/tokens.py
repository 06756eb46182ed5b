"""Token ids of whole texts by the tokenizers library, with ids of frequent pieces kept."""

from __future__ import annotations

import json
import re

import numpy as np

from .common import trim

#: A space that another white space or the end follows: pieces then aren't just the parts between spaces.
UNEVEN = re.compile(r" (?=\s|\Z)")
BEFORE_WORD = re.compile(r"(?= \S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The byte-level pattern never joins what stands on both sides of a space before a non-space character, so a text's
    ids are those of its pieces cut there, one after the other; texts are encoded whole for tokenizers with any other
    pattern, with a normalizer, or with added tokens that aren't special. Pieces repeat; the library encodes each piece once and
    the ids stay in a table of at most `limit` pieces of at most `longest` characters. New pieces of a batch are encoded
    as one text and cut again at the tokens that begin with a space.
    """

    def __init__(self, path: str, limit: int = 800_000, longest: int = 40) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.cuts = plain and not spec.get("normalizer") and all(t.get("special") for t in spec.get("added_tokens") or [])
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        space = self.lib.encode(" a", add_special_tokens=False).tokens[0][0]
        self.opens = np.array([(self.lib.id_to_token(i) or "").startswith(space) for i in range(self.lib.get_vocab_size())])
        self.limit, self.longest, self.known, self.old = limit, longest, {}, {}
        self.ends = {x: self.whole(x) for x in ".,"}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes() if text else b""

    def split(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of a space and each piece, all encoded as one text and cut at the tokens that begin with a space."""
        ids = np.array(self.lib.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(pieces) or at[0]:
            return {p: self.whole(" " + p) for p in pieces}
        raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        return {p: raw[a:b] for p, a, b in zip(pieces, (4 * at).tolist(), ends)}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """As split(); a full stop or comma after letters alone is a piece of its own to the pattern."""
        stem = {p: p[:-1] for p in pieces if p[-1:] in self.ends and p[:-1].isalpha()}
        need = list({stem.get(p, p) for p in pieces}.difference(self.known))
        got = self.split(need) if need else {}
        for p, x in stem.items():
            got[p] = (got.get(x) or self.known[x]) + self.ends[p[-1]]
        return got

    def look(self, pieces: list[str]) -> list[bytes]:
        """Ids of a space and each piece; the table's older half goes when the younger one is full."""
        if len(self.known) > self.limit // 2:
            self.known, self.old = {}, self.known
        known, old, out, new = self.known, self.old, [], []
        for p in pieces:
            if (x := known.get(p)) is None and (x := old.get(p)) is not None:
                known[p] = x
            out.append(x)
        new = [p for p, x in zip(pieces, out) if x is None]
        odd = {p: self.whole(" " + p) for p in new if len(p) > self.longest or " " in p}
        plain = [p for p in new if p not in odd]
        got = odd
        for i in range(0, len(plain), 20_000):
            learnt = self.learn(plain[i : i + 20_000])
            known.update(learnt)
            got |= learnt
        return [got[p] if x is None else x for p, x in zip(pieces, out)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts are cut and their distinct pieces found by Arrow; each distinct piece is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        if not self.cuts:
            return [self.whole(t) for t in texts]
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        ids = self.look(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)  # all pieces' ids, one after the other
        _, ends, data = joined.buffers()
        ends, data = np.frombuffer(ends, np.int64)[joined.offset :], memoryview(data or b"")
        at, out = cut.offsets.to_numpy(), []
        first, last = ends[np.minimum(at[:-1] + 1, at[1:])].tolist(), ends[at[1:]].tolist()
        for text, alone, i, j in zip(texts, (np.diff(at) == 1).tolist(), first, last):
            if UNEVEN.search(text):
                head, *rest = BEFORE_WORD.split(text)
                out.append(self.whole(head) + b"".join(self.look([x[1:] for x in rest])))
            else:
                out.append(self.whole(text if alone else text[: text.find(" ")]) + bytes(data[i:j]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, limit: int = 800_000) -> Encoder:
    """One encoder for each worker process, kept between its tasks; limit: of the pieces whose ids it keeps."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].limit = limit
    return _encoders[path]


def chunks(batch, column: int = 1, size: int = 6 << 20):
    """Parts of an Arrow batch with about `size` bytes in a column, small enough to encode together; what a batch took
    is given back after it."""
    import pyarrow.compute as pc

    group = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield batch.slice(i, j - i)
    trim()
