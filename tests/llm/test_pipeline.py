"""The corpus pipeline against a brute-force version of its stages, and on awkward and empty tables."""

import gc
import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import brute_components, word_sets
from tidemill.llm import common, mixing, packing, tokens, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(11)
    words = [f"{a}{b}n" for a in "bcdfghklmnprst" for b in "aeiou"]
    line = lambda n: " ".join(random.choices(words, k=n))
    passage, rows, labels = line(30), [], []
    for i in range(60):
        rows.append((i, line(60), "en", f"s{i % 3}"))
    rows += [(100 + i, rows[i][1] + " tail", "en", "s1") for i in range(8)]  # near copies
    rows += [(200 + i, line(20) + " " + passage + " " + line(20), "en", "s2") for i in range(5)]  # a shared passage
    rows += [(300 + i, "scumword trashword idiotword " + line(20), "en", "s0") for i in range(40)]
    labels = [(d, 1, int(d >= 300)) for d, *_ in rows]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def cut(texts, length=50):
    """Texts without the characters that 50-byte strings of smaller doc_ids cover (ASCII)."""
    seen, out = {}, {}
    for d in sorted(texts):
        t, gone = texts[d], set()
        for i in range(len(t) - length + 1):
            if seen.setdefault(t[i : i + length], d) < d:
                gone.update(range(i, i + length))
        out[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    return out


def test_every_stage_and_run_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"]
    held = {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    start, clean = (texts(x) for x in held["toxicity"])
    model = toxicity.fit(held["toxicity"][0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert clean == {d: t for d, t in start.items() if model.score(t.encode()) < 0.5} and max(clean) < 300
    single = texts(held["near_dedup"][1])
    least = brute_components(word_sets(clean, 5), 80)
    assert single == {d: t for d, t in clean.items() if least[d] == d} and len(single) < len(clean)
    shorter = texts(held["suffix_dedup"][1])
    assert shorter == cut(single) and shorter != single
    assert all(r["n_chars"] == len(r["text"]) for r in held["suffix_dedup"][1].collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(held["mixing"][0]).collect()}
    mixed = [r["doc_id"] for r in held["mixing"][1].collect()]
    assert {d: mixed.count(d) for d in want} == want
    lib, ends = tokens.Encoder(tokens.default_path()).lib, {}
    rows = held["packing"][1].collect()
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in shorter.items()}
    assert sum(r["length"] for r in rows) == sum(sizes[d] for d in mixed)
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    again = pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in again.collect()) == sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows)


def test_awkward_and_empty_tables(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (5, "x" * 20_000), (None, "null id"), (6, "é" * 3_000 + " ü"), (7, "tie tie"), (8, "tie tie")]
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    schema = COLUMNS + ", _row string, copies long, _copy int"
    for name, data in (("awkward", [(d, t, None, None if i % 2 else "s", None, "z", 7, 3) for i, (d, t) in enumerate(rows)]), ("empty", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where("true" if data else "false").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, step in pipeline.STAGES[:-1]:
            step(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            if stage == "near_dedup" and data:
                kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
                assert len(kept) == len(set(kept)) and {1, 2, 3, 4, 5, 6, 7, None} >= {d for d, _ in kept} and 8 not in {d for d, _ in kept}
        out = pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/{name}")
        assert out.count() == 0 if not data else np.array([r["length"] for r in out.collect()]).max() <= packing.fit.__defaults__[0]


def test_driver_memory_is_given_back_before_stages_and_scratch_tables(spark, monkeypatch):
    eased = []
    monkeypatch.setattr(pipeline, "ease", lambda s: eased.append("stage"), raising=False)
    monkeypatch.setattr(common, "ease", lambda s: eased.append("scratch"), raising=False)
    pipeline.staged(lambda s, docs, d: common.scratch(docs, "eased"))(spark, spark.range(3), "").collect()
    assert eased == ["stage", "scratch"]
    monkeypatch.undo()
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    ballast = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, 8_000_000)  # 64 MB
    del ballast
    gc.collect()
    before = runtime.totalMemory() - runtime.freeMemory()
    common.ease(spark, 0.0)
    assert runtime.totalMemory() - runtime.freeMemory() < before
