"""Expressions given as data (from JSON or YAML) as Columns, for pipelines that aren't written in code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar

BINARY = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "div": F.try_divide, "mod": F.try_mod, "concat": scalar.concat, "like": F.like, "contains": F.contains,
}
UNARY = {"not": lambda a: ~a, "neg": lambda a: -a, "is_null": lambda a: a.isNull(), "is_not_null": lambda a: a.isNotNull()}
CALLS = {
    "upper": F.upper, "lower": F.lower, "length": scalar.length, "trim": scalar.trim, "coalesce": F.coalesce, "abs": F.abs, "round": F.round, "now": F.current_timestamp,
    "concat": scalar.concat, "substring": lambda s, start, size: scalar.substring(s, start + 1, size),
}


def column(spec, variables: dict | None = None) -> Column:
    """{"field": name}, {"value": v}, {"var": name}, {"op": ..., "left": ..., "right": ...} or {"op": ..., "of": ...},
    {"op": "in", "left": ..., "values": [...]}, {"if": ..., "then": ..., "else": ...}, {"call": name, "args": [...]}; other
    things stand for themselves. substring counts from 0."""
    if not isinstance(spec, dict):
        return F.lit(spec)
    of = lambda x: column(x, variables)
    if "field" in spec:
        return F.col(spec["field"])
    if "value" in spec:
        return F.lit(spec["value"])
    if "var" in spec:
        return F.lit((variables or {})[spec["var"]])
    if "if" in spec:
        return F.when(of(spec["if"]), of(spec["then"])).otherwise(of(spec["else"]) if "else" in spec else F.lit(None))
    if "call" in spec:
        return CALLS[spec["call"].lower()](*[of(a) for a in spec.get("args", [])])
    if spec["op"] == "in":
        return of(spec["left"]).isin(*spec["values"])
    return UNARY[spec["op"]](of(spec["of"])) if "of" in spec else BINARY[spec["op"]](of(spec["left"]), of(spec["right"]))
