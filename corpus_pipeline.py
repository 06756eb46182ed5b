"""A corpus pipeline of five operators: toxicity, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from tidemill.llm.common import documents, ease, scratch_path
from tidemill.session import MADE, discard

#: Scratch tables of the stage that ran last.
_held: list[str] = []


def staged(stage):
    """A stage's result is written before the next stage begins, so what the last one left in the shared folder goes then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _held)
        ease(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # documents are long; small batches take less memory
        first = len(MADE)
        out = stage(spark, docs, sf_dir)
        _held[:] = MADE[first:]
        return out

    return run


#: The pipeline's results come from a classifier, a tokenizer and hashes, which SQL can't express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5; null and empty texts stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the least doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Every row counts, repeated and null doc_ids too; rows without words stay.
    """
    return near_dedup.without_near_copies(docs, width=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 50-byte strings of smaller doc_ids cover; no document goes."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it (0 to 3 times)."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.packed(docs, pieces_kept=200_000)


STAGES = [("toxicity", staged(drop_toxic)), ("near_dedup", staged(drop_near_copies)), ("suffix_dedup", staged(drop_repeats)), ("mixing", staged(mix)), ("packing", staged(pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
