"""Registry of queries and the small amount of shaping both engines share."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


class Tables:
    """Lazy parquet readers by table name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.once(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The same logical frame each time it is asked for within one query (nothing is cached)."""
        if name not in self._seen:
            self._seen[name] = make()
        return self._seen[name]


def shared(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A derived frame many plans start from: analysed once per query, so subplans can be reused."""

    @functools.wraps(fn)
    def wrapped(t: Tables) -> DataFrame:
        return t.once(f"{fn.__module__}.{fn.__name__}", lambda: fn(t))

    return wrapped


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    longs: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        out = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.DoubleType):
                # + 0.0 folds a rounded negative zero into zero.
                c = F.round(c, DIGITS) + F.lit(0.0)
            elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
                c = c.cast("long")
            out.append(c.alias(f.name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        swaps = [f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in self.doubles]
        swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in self.longs]
        if not swaps:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({self.sql}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, d: str = "", i: str = ""):
    """Register a plan. `d` / `i` name the columns to compare as doubles / integers."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(d.split()), tuple(i.split()))
        return fn

    return wrap
