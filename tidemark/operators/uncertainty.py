"""Resampling and shift nulls.

Draws come from md5 of (seed, draw, slot), so a lost executor reproduces the same draws and
other engines can compute them too. Resampling works on per-block sums packed into one short
array per key (years, or harvests of a record), so a draw costs as many numbers as there are
blocks and nothing is shuffled per draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(seed: int, draw: Column, slot: Column, n: Column) -> Column:
    """Uniform integer in [0, n) from the first 32 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def block_totals(df: DataFrame, keys: Sequence[str], block: str, value: str, draws: int, seed: int) -> DataFrame:
    """Total of a resample of blocks (as many as there are) per draw."""
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_s"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(block, "_s"))).alias("_a"))
    rows = packed.select(*keys, F.col("_a._s").alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    n = F.size("_a")
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, s: acc + F.get("_a", pick(seed, F.col("draw"), s, n).cast("int"))
    )
    return rows.select(*keys, "draw", total.alias("total"), n.alias("blocks"))


def summary(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return draws.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), q.alias("_q"), F.avg((F.col(value) > 0).cast("double")).alias("probability_positive")
    ).select(
        *keys, "draws", F.col("_q")[0].alias("p025"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p975"), "probability_positive"
    )


def block_bootstrap(df: DataFrame, keys: Sequence[str], block: str, value: str, draws: int, seed: int) -> DataFrame:
    return summary(block_totals(df, keys, block, value, draws, seed), keys, "total")


def row_bootstrap(df: DataFrame, keys: Sequence[str], row: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Interval on the mean of (a - b) by resampling rows, with improved and worsened counts."""
    d = df.withColumn("_d", F.col(a) - F.col(b))
    means = block_totals(d, keys, row, "_d", draws, seed).withColumn("mean", F.col("total") / F.col("blocks"))
    counts = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("harvests"), F.avg("_d").alias("mean_saving"), F.sum((F.col("_d") > 1e-12).cast("long")).alias("improved"),
        F.sum((F.col("_d") < -1e-12).cast("long")).alias("worsened"),
    )
    return counts.join(summary(means, keys, "mean"), list(keys))


def _places(seed: int, draw: int, slots: Sequence, n: int) -> list[int]:
    """What `pick` gives for each slot of a draw."""
    return [int(hashlib.md5(f"{seed}:{draw}:{s}".encode()).hexdigest()[:8], 16) % n for s in slots]


#: Spread that rounding leaves of a constant, as a share of the values.
FLAT = 1e-10


def coef_bootstrap(
    df: DataFrame, keys: Sequence[str], row: str, y: str, xs: Sequence[str], draws: int, seed: int, min_distinct: int = 4
) -> DataFrame:
    """Coefficient of the first regressor over resamples of a record's rows; thin draws are skipped.

    A draw is a count per row, and all draws of a record (one key's harvests, so few rows) are solved at
    once, each on its rows less their mean. A regressor that is constant in a draw gets slope zero there, and
    regressors that are multiples of each other there share the slope.
    """
    keys, names = list(keys), [y, *xs]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(row, "ascending")])
        n = table.num_rows
        v = np.column_stack([table[c].to_numpy() for c in names]).astype(float)
        largest = np.abs(v).max(axis=0)
        v = v - v.mean(axis=0)
        size = v.std(axis=0)
        fixed = size <= FLAT * largest
        v = np.where(fixed, 0.0, v / np.where(fixed, 1.0, size))
        counts = np.array([np.bincount(_places(seed, d, range(1, n + 1), n), minlength=n) for d in range(1, draws + 1)], float)
        counts = counts[(counts > 0).sum(axis=1) >= min_distinct]
        rest = (v[None, :, :] - (counts @ v / n)[:, None, :]) * np.sqrt(counts)[:, :, None]
        rest = np.where(np.abs(rest).max(axis=1, keepdims=True) > FLAT, rest, 0.0)
        slopes = np.linalg.pinv(rest[:, :, 1:], rcond=FLAT) @ rest[:, :, :1]
        solved = slopes[:, 0, 0] * np.where(fixed, 1.0, size)[0] / np.where(fixed, 1.0, size)[1]
        out = [pa.repeat(table[k][0], len(counts)) for k in keys]
        return pa.table([*out, pa.array(solved, from_pandas=True)], names=[*keys, "coefficient"])

    rows = df.dropna(subset=names).select(*keys, row, *[F.col(c).cast("double").alias(c) for c in names])
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("coefficient", T.DoubleType())])
    return summary(rows.groupBy(*keys).applyInArrow(run, schema), keys, "coefficient")


def circular_null(
    df: DataFrame, keys: Sequence[str], date: str, block: str, raw: str, entry: str, exit: str, gross: str, cost: str, draws: int, seed: int
) -> DataFrame:
    """Total net when each year's raw signals are rolled by a random offset and the overlap rule re-applied.

    A year of n rows has n rolls. For all of them at once one pass from the year's end gives, for every
    row from which trading is free again, the total of the rest of the year and the last exit. A draw
    then only chains its years: the last exit tells where the next year starts. Years follow one
    another in time, and entries do not go back within a year. A key's rows are bounded by the calendar.
    """
    keys = list(keys)

    def days(column: pa.ChunkedArray) -> np.ndarray:
        return column.cast(pa.int32()).to_numpy().astype(float)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_b", "ascending"), ("_d", "ascending")])
        starts = table["_b"].to_pylist()
        last, total = np.full(draws, -np.inf), np.zeros(draws)
        for name in dict.fromkeys(starts):
            part = table.filter(pa.array([b == name for b in starts]))
            n = part.num_rows
            e, x = days(part["_e"]), days(part["_x"])
            signal = np.nan_to_num(part["_s"].to_numpy().astype(float))
            g, c = np.nan_to_num(part["_g"].to_numpy()), np.nan_to_num(part["_c"].to_numpy())
            known = ~np.isnan(e)
            e = np.where(known, e, np.inf)
            rolled = signal[(np.arange(n)[:, None] - np.arange(n)[None, :]) % n] * known[:, None]  # row x offset
            free = np.maximum(np.searchsorted(e, x, side="right"), np.arange(n) + 1)
            rest, out = np.zeros((n + 1, n)), np.full((n + 1, n), -np.inf)
            for i in range(n - 1, -1, -1):
                live = rolled[i] != 0
                rest[i] = np.where(live, rolled[i] * g[i] - np.abs(rolled[i]) * c[i] + rest[free[i]], rest[i + 1])
                out[i] = np.where(live, np.maximum(x[i], out[free[i]]), out[i + 1])
            offset = np.array([_places(seed, d, [name], n)[0] for d in range(1, draws + 1)])
            first = np.searchsorted(e, last, side="right")
            total += rest[first, offset]
            last = np.maximum(last, out[first, offset])
        names = [pa.repeat(table[k][0], draws) for k in keys]
        return pa.table([*names, pa.array(range(1, draws + 1), pa.int32()), pa.array(total)], names=[*keys, "draw", "total"])

    rows = df.select(
        *keys, F.col(block).alias("_b"), F.unix_date(date).alias("_d"), F.col(entry).alias("_e"), F.col(exit).alias("_x"),
        F.col(raw).cast("double").alias("_s"), F.col(gross).cast("double").alias("_g"), F.col(cost).cast("double").alias("_c"),
    )
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("draw", T.IntegerType()), T.StructField("total", T.DoubleType())])
    return rows.groupBy(*keys).applyInArrow(run, schema)


def null_p(observed: DataFrame, null: DataFrame, keys: Sequence[str], obs: str, value: str) -> DataFrame:
    """(1 + draws at or above the observed) / (draws + 1)."""
    j = null.join(observed.select(*keys, obs), list(keys))
    return j.groupBy(*keys, obs).agg(
        F.count(F.lit(1)).alias("draws"), ((1 + F.sum((F.col(value) >= F.col(obs)).cast("long"))) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )
