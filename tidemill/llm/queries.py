"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fingerprints, lm_score, media, mixing, near_dedup, packing, sharding, suffix_dedup, token_files, toxicity
from .common import documents


def queries():
    return {
        "op1_suffix_dedup": lambda spark, d: suffix_dedup.removed(documents(spark, d)),
        "op2_media_columns": lambda spark, d: media.columns(documents(spark, d)),
        "op3_mixing": lambda spark, d: mixing.taken(documents(spark, d)),
        "op4_near_dedup": lambda spark, d: near_dedup.near_duplicates(documents(spark, d)),
        "op5_best_fit_packing": lambda spark, d: packing.packed(documents(spark, d)),
        "op6_maxent_lm": lambda spark, d: lm_score.scored(documents(spark, d)),
        "op7_toxicity": lambda spark, d: toxicity.scored(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op8_jump_hash": lambda spark, d: sharding.assign(documents(spark, d)),
        "op9_token_files": lambda spark, d: token_files.round_trip(documents(spark, d)),
        "op10_fingerprints": lambda spark, d: fingerprints.fingerprints(documents(spark, d)),
    }


def oracle_sql():
    return {"op3_mixing": mixing.SQL}
