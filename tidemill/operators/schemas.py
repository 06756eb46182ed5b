"""Schemas of records: differences, compatibility levels, and a summary of JSON messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type changes that lose nothing (old, new).
WIDER = {("int", "bigint"), ("int", "float"), ("int", "double"), ("bigint", "double"), ("float", "double")}
LEVELS = ("NONE", "BACKWARD", "FORWARD", "FULL")
#: The risk of a change, by whether fields went, and by its worst change of a type.
RISK = {
    (False, None): "safe", (False, "wider"): "low", (False, "other"): "high",
    (True, None): "medium", (True, "wider"): "critical", (True, "other"): "critical",
}


@dataclass(frozen=True)
class Diff:
    added: dict[str, str]
    removed: dict[str, str]
    modified: dict[str, tuple[str, str]]

    @property
    def narrowed(self) -> list[str]:
        return [n for n, change in self.modified.items() if change not in WIDER]

    @property
    def breaking(self) -> bool:
        return bool(self.removed or self.narrowed)

    @property
    def risk(self) -> str:
        return RISK[bool(self.removed), "other" if self.narrowed else "wider" if self.modified else None]

    def steps(self) -> list[str]:
        """What a migration does, in an order that lets readers of either version go on while it runs."""
        out = [f"add {n} {t}" for n, t in self.added.items()]
        out += [f"{'widen' if change in WIDER else 'copy'} {n} {change[0]} to {change[1]}" for n, change in self.modified.items()]
        return out + ["move readers"] * bool(out) + [f"drop {n}" for n in self.removed]


def migrate(df: DataFrame, new: T.StructType) -> DataFrame:
    """Rows in the new schema: values cast where that loses nothing that can be kept (else null), new fields null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in new])


def fields(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema}


def diff(old: T.StructType, new: T.StructType) -> Diff:
    a, b = fields(old), fields(new)
    return Diff(
        {n: t for n, t in b.items() if n not in a},
        {n: t for n, t in a.items() if n not in b},
        {n: (t, b[n]) for n, t in a.items() if n in b and b[n] != t},
    )


def reads(reader: T.StructType, writer: T.StructType) -> bool:
    """Whether records of `writer` fit `reader`: types equal or widened, and fields that only it has may be null."""
    d = diff(writer, reader)
    return not d.narrowed and all(reader[n].nullable for n in d.added)


def compatible(old: T.StructType, new: T.StructType, level: str = "BACKWARD") -> bool:
    """BACKWARD: new reads old. FORWARD: old reads new. FULL: both. NONE: anything goes."""
    if level not in LEVELS:
        raise ValueError(f"no level {level}")
    return (level in ("NONE", "FORWARD") or reads(new, old)) and (level in ("NONE", "BACKWARD") or reads(old, new))


class Registry:
    """Versions of schemas by subject; a version that breaks the subject's level is refused."""

    def __init__(self, level: str = "BACKWARD", transitive: bool = False) -> None:
        self.level, self.transitive, self.subjects = level, transitive, {}

    def register(self, subject: str, schema: T.StructType) -> int:
        """The version, from 1; an equal schema keeps its own."""
        held = self.subjects.setdefault(subject, [])
        if schema in held:
            return held.index(schema) + 1
        for i, old in enumerate(held if self.transitive else held[-1:]):
            if not compatible(old, schema, self.level):
                raise ValueError(f"{subject}: not {self.level} compatible with version {i + 1 if self.transitive else len(held)}")
        held.append(schema)
        return len(held)

    def get(self, subject: str, version: int | None = None) -> T.StructType:
        return self.subjects[subject][(version or len(self.subjects[subject])) - 1]


def summary(df: DataFrame, value: str) -> DataFrame:
    """field, type, occurrences, share (percent of all messages) of the top-level fields of JSON objects.

    A field's type is the one of more than four fifths of its values, else mixed. Text that is no object has no field,
    but counts as a message.
    """
    return df.sparkSession.sql(
        f"""
        WITH m AS (SELECT try_parse_json(`{value}`) AS v FROM {{df}}),
        f AS (SELECT e.key AS field, CASE
                WHEN s LIKE 'OBJECT%' THEN 'object' WHEN s LIKE 'ARRAY%' THEN 'array' WHEN s = 'STRING' THEN 'string'
                WHEN s = 'BOOLEAN' THEN 'boolean' WHEN s = 'VOID' THEN 'null' ELSE 'number' END AS type
              FROM (SELECT v FROM m WHERE schema_of_variant(v) LIKE 'OBJECT%') o, LATERAL variant_explode(o.v) e, LATERAL (SELECT schema_of_variant(e.value) AS s)),
        t AS (SELECT field, type, count(*) AS n FROM f GROUP BY field, type),
        g AS (SELECT field, sum(n) AS occurrences, max_by(type, n) AS top, max(n) AS most FROM t GROUP BY field)
        SELECT field, CASE WHEN most > 0.8 * occurrences THEN top ELSE 'mixed' END AS type, occurrences,
               100.0D * occurrences / (SELECT count(*) FROM m) AS share
        FROM g
        """,
        df=df,
    )
