"""User functions by name, scalar and aggregate; a name is checked before it is taken."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    params: tuple[str, ...]
    returns: str
    description: str


def _plain(v):
    return None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else v


class Functions:
    """Functions for SQL, run over Arrow batches. Built-in names and names in use are refused."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def _take(self, f: Function, udf) -> None:
        if f.name.lower() in self.held or self.spark.catalog.functionExists(f.name):
            raise ValueError(f"{f.name} is taken")
        self.spark.udf.register(f.name, udf)
        self.held[f.name.lower()] = f

    def scalar(self, name: str, call: Callable, params: list[str], returns: str, description: str = "") -> None:
        """call takes one value a parameter (null: None) and gives one."""

        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series([call(*map(_plain, row)) for row in zip(*columns)], dtype=object)

        self._take(Function(name, "scalar", tuple(params), returns, description), F.pandas_udf(batch, returns))

    def aggregate(self, name: str, start: Callable, step: Callable, finish: Callable, params: list[str], returns: str, description: str = "") -> None:
        """state = start(); state = step(state, *values) a row; finish(state) is the result.

        A key's rows meet in one task, in no given order: for what built-in aggregates can't express, on keys of bounded
        size. Built-in aggregates combine before the shuffle.
        """

        def batch(*columns: pd.Series) -> float:
            state = start()
            for row in zip(*columns):
                state = step(state, *map(_plain, row))
            return finish(state)

        self._take(Function(name, "aggregate", tuple(params), returns, description), F.pandas_udf(batch, returns))

    def remove(self, name: str) -> None:
        del self.held[name.lower()]
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")

    def list(self) -> list[Function]:
        return [self.held[n] for n in sorted(self.held)]
