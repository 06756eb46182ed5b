"""Fluent pipelines: Pipeline(df).filter(...).map(...).window(...).aggregate(...).frame()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, windows


class Pipeline:
    """The same steps on a batch or a streaming frame; nothing runs before the frame is used."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.pending, self.keys = df, None, []

    def filter(self, condition: Column | str) -> Pipeline:
        self.df = self.df.where(condition)
        return self

    def map(self, **columns: Column) -> Pipeline:
        self.df = self.df.withColumns(columns)
        return self

    def project(self, *names: str, **renamed: str) -> Pipeline:
        self.df = self.df.select(*names, *[F.col(old).alias(new) for new, old in renamed.items()])
        return self

    def join(self, other: DataFrame, *keys, how: str = "inner", within: tuple[str, str, float] | None = None) -> Pipeline:
        j = joins.Join(self.df).with_(other).on(*keys).type(how).prefixed()
        self.df = (j.within(*within) if within else j).build()
        return self

    def tumbling(self, ts: str, size: str) -> Pipeline:
        self.pending = ("tumbling", ts, size)
        return self

    def hopping(self, ts: str, size: str, hop: str) -> Pipeline:
        self.pending = ("hopping", ts, size, hop)
        return self

    def session(self, ts: str, gap: str) -> Pipeline:
        self.pending = ("session", ts, gap)
        return self

    def group_by(self, *keys: str) -> Pipeline:
        self.keys = list(keys)
        return self

    def aggregate(self, **aggs: Column) -> Pipeline:
        if self.pending:
            kind, *args = self.pending
            self.df = getattr(windows, kind)(self.df, *args, self.keys, **aggs)
        else:
            self.df = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        self.pending = None
        return self

    def having(self, condition: Column | str) -> Pipeline:
        return self.filter(condition)

    def frame(self) -> DataFrame:
        return self.df


#: Node kinds of a flow and what they do to their inputs.
NODES = {
    "source": lambda ins, p: p["frame"],
    "filter": lambda ins, p: ins[0].where(p["condition"]),
    "map": lambda ins, p: ins[0].withColumns(p["columns"]),
    "project": lambda ins, p: ins[0].select(*p["columns"]),
    "aggregate": lambda ins, p: ins[0].groupBy(*p["keys"]).agg(*[a.alias(n) for n, a in p["aggs"].items()]),
    "window": lambda ins, p: windows.tumbling(ins[0], p["ts"], p["size"], p["keys"], **p["aggs"]),
    "join": lambda ins, p: ins[0].join(ins[1], p["on"], p.get("how", "inner")),
    "union": lambda ins, p: ins[0].unionByName(ins[1]),
}


def flow(nodes: dict[str, tuple[str, dict]], edges: list[tuple[str, str]], out: str) -> DataFrame:
    """Compiles a graph of nodes (kind, parameters) to the frame of one of them; cycles raise."""
    made, busy = {}, set()

    def make(name: str) -> DataFrame:
        if name in busy:
            raise ValueError(f"a cycle through {name}")
        if name not in made:
            busy.add(name)
            kind, params = nodes[name]
            made[name] = NODES[kind]([make(a) for a, b in edges if b == name], params)
            busy.discard(name)
        return made[name]

    return make(out)
