"""Identifier, status and contract-grid helpers used while cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def translate_ids(
    df: DataFrame, code: str, claimed: str, scope: DataFrame, prefix: str, new_prefix: str, owner: str, width: int
) -> DataFrame:
    """Replace an identifier's prefix through a lookup; a claimed owner that disagrees is an error row.

    Rows whose prefix is not in scope are dropped, which is different from an error.
    """
    j = df.withColumn(prefix, F.substring(code, 1, width)).join(scope, prefix)
    ok = F.col(claimed) == F.col(owner)
    return j.withColumn("translated", F.when(ok, F.concat(F.col(new_prefix), F.substring(F.col(code), F.lit(width + 1), F.length(code))))).withColumn(
        "problem", F.when(~ok, "prefix mismatch")
    )


def drop_unobserved(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Rows with at least one measure: a padded tail has none."""
    return df.dropna(how="all", subset=list(measures))


def observed_counts(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """How many rows `drop_unobserved` keeps and drops, in one pass."""
    seen = F.coalesce(*[F.col(m) for m in measures]).isNotNull()
    return df.groupBy(*keys).agg(F.sum(seen.cast("long")).alias("kept"), F.sum((~seen).cast("long")).alias("dropped"))


def weakest_status(df: DataFrame, keys: Sequence[str], status: str, label: str) -> DataFrame:
    """`prelim` if any file of the period is; the distinct labels seen (a fixed short list)."""
    return df.groupBy(*keys).agg(
        F.when(F.max((F.col(status) == "prelim").cast("int")) == 1, "prelim").otherwise("scaled").alias("weakest"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("seen"),
    )


def stage_features(
    df: DataFrame, date: str, stages: Mapping[str, Sequence[int]], pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """0/1 stage flags by month and their products with features."""
    out = df
    for name, months in stages.items():
        out = out.withColumn(name, F.month(date).isin(*months).cast("double"))
    for name, (stage, c) in pairs.items():
        out = out.withColumn(name, F.col(stage) * F.col(c))
    return out


def contract_requests(
    df: DataFrame, root: str, year: str, letters: Mapping[str, int], as_of: Column, two_digits_from: int
) -> DataFrame:
    """Contract codes and vendor symbols for each (root, year) and listed month.

    A contract past the 15th of its month is expired and carries its decade.
    """
    months = F.array(*[F.struct(F.lit(k).alias("letter"), F.lit(m).alias("month")) for k, m in letters.items()])
    g = df.select("*", F.inline(months))
    yy = F.lpad((F.col(year) % 100).cast("string"), 2, "0")
    digits = F.when(F.col(year) >= two_digits_from, yy).otherwise((F.col(year) % 10).cast("string"))
    expired = F.make_date(F.col(year).cast("int"), F.col("month"), F.lit(15)) < as_of
    decade = F.concat(F.lit("^"), (F.floor(F.col(year) / 10) % 10).cast("string"))
    return g.withColumn("contract", F.concat(root, "letter", yy)).withColumn(
        "symbol", F.concat(F.col(root), F.col("letter"), digits, F.when(expired, decade).otherwise(""))
    )
