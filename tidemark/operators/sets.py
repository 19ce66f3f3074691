"""Set operations over frames and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with a tag column; columns a frame lacks are NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def set_check(df: DataFrame, c: str, expected: DataFrame) -> DataFrame:
    """Members seen but unknown, and expected but missing."""
    seen = df.select(c).distinct()
    unknown = seen.join(expected, c, "left_anti").withColumn("problem", F.lit("unknown"))
    missing = expected.join(seen, c, "left_anti").withColumn("problem", F.lit("missing"))
    return unknown.unionByName(missing)


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    """Distinct values; ordering is by range partitioning, not one task."""
    return df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c)


def common_cohort(df: DataFrame, keys: Sequence[str], member: str, complete: str, n: int) -> DataFrame:
    """Rows of groups that have all n members complete."""
    full = (
        df.filter(F.col(complete)).groupBy(*keys, member).agg(F.lit(1).alias("_1"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select(*keys)
    )
    return df.join(full, list(keys), "left_semi")


def overlap_counts(df: DataFrame, member: str, item: str) -> DataFrame:
    """Items (weeks) by how many members (belts) share them."""
    per_item = df.select(member, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("members"))
    return per_item.groupBy("members").agg(F.count(F.lit(1)).alias("items"))
