"""Aggregates with named definitions where two are in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Always a double; null if there is no number. Numeric strings count."""
    return F.sum(x.try_cast("double"))


def first_by(x: Column, *order: Column) -> Column:
    """First non-null in an explicit order."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(*order)))


def last_by(x: Column, *order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))


def nearest_rank(x: Column, share: float) -> Column:
    """Value at round(share * (n - 1)) of the sorted ones (halves away from zero)."""
    xs = F.sort_array(F.collect_list(x))
    return F.get(xs, F.floor((F.size(xs) - 1) * F.lit(share) + 0.5).cast("int"))


def floor_rank(x: Column, percent: int) -> Column:
    """Value at floor(percent / 100 * n), at most the last."""
    xs = F.sort_array(F.collect_list(x))
    return F.get(xs, F.least(F.floor(F.size(xs) * F.lit(percent) / 100), F.size(xs) - 1).cast("int"))


def top_k(x: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(x), asc=False), 1, k)


def array_with_nulls(x: Column) -> Column:
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def joined(x: Column, separator: str = ",") -> Column:
    """Values in their own order, so that the result doesn't hang on arrival."""
    return F.array_join(F.sort_array(F.collect_list(x.cast("string"))), separator)


def deviation(x: Column, population: bool = True) -> Column:
    """Fewer than two values: 0 for the sample form."""
    return F.stddev_pop(x) if population else F.when(F.count(x) < 2, F.lit(0.0)).otherwise(F.stddev_samp(x))


def cumulative_buckets(x: Column, bounds: list[float]) -> dict[str, Column]:
    return {f"le_{b:g}".replace(".", "_"): F.count(F.when(x <= b, 1)).cast("long") for b in bounds}


def distinct_sketch(x: Column, bits: int = 12) -> Column:
    """HyperLogLog estimate by mergeable sketches."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(x, bits))


#: Names that builders and rollups use.
NAMED = {
    "count": lambda x: F.count(x).cast("long"), "sum": total, "avg": lambda x: F.avg(x.try_cast("double")), "min": F.min, "max": F.max,
    "count_distinct": lambda x: F.count_distinct(x).cast("long"), "stddev": F.stddev_pop, "variance": F.var_pop,
    "p50": lambda x: nearest_rank(x, 0.5), "p95": lambda x: nearest_rank(x, 0.95), "p99": lambda x: nearest_rank(x, 0.99),
}
