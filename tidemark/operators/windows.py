"""Window operators over series with one row per (key, date).

Callers fold raw rows to that grain first (a partial aggregation), so one key's window
partition is bounded by the calendar: a century of days is 36,500 rows, whatever the data
size. Statistics that need only other rows of the same week, year or record go through
grouped aggregates joined back, never through a window over raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import corr, div

from .common import by, days_back, guarded, rows_back, single_row

# ------------------------------------------------------------------ rolling


def rolling_days(keys: Sequence[str], date: str, c: str, k: int) -> Column:
    """Sum over k calendar days, NULL unless all k were observed."""
    w = days_back(keys, date, k)
    return guarded(F.sum(c).over(w), F.count(c).over(w), k)


def rolling_rows(keys: Sequence[str], order: Sequence[str], c: str, k: int, min_n: int, fn: str = "sum") -> Column:
    """Positional sum / min / max / avg over k rows with a minimum count."""
    w = rows_back(keys, order, k)
    f = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[fn]
    return guarded(f(c).over(w), F.count(c).over(w), min_n)


def run_so_far(df: DataFrame, keys: Sequence[str], order: str, flag: str, out: str = "run") -> DataFrame:
    """Length of the run of true flags that ends at each row."""
    w = by(keys, order)
    return (
        df.withColumn("_pos", F.row_number().over(w))
        .withColumn(
            "_reset",
            F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("_pos"))).over(w.rowsBetween(W.unboundedPreceding, 0)),
        )
        .withColumn(out, (F.col("_pos") - F.coalesce("_reset", F.lit(0))).cast("long"))
        .drop("_pos", "_reset")
    )


def rolling_longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: str, k: int, out: str) -> DataFrame:
    """Longest run of true flags inside each trailing k-row window, NULL for short windows.

    A run reaching back past the window is clipped to the window: the run ending at the
    j-th row of the window can be no longer than j. The window's run lengths are gathered
    into one array of at most k integers.
    """
    w = rows_back(keys, [order], k)
    runs = run_so_far(df, keys, order, flag, "_run").withColumn("_runs", F.collect_list("_run").over(w))
    clipped = F.transform("_runs", lambda r, j: F.least(r, (j + 1).cast("long")))
    return runs.withColumn(out, F.when(F.size("_runs") == k, F.array_max(clipped))).drop("_run", "_runs")


def longest_run(df: DataFrame, keys: Sequence[str], group: Sequence[str], order: str, flag: str, out: str) -> DataFrame:
    """Longest run of true flags per group (a run does not cross a group's edge)."""
    runs = run_so_far(df, [*keys, *group], order, flag, "_run")
    return runs.groupBy(*keys, *group).agg(F.max("_run").alias(out))


# ------------------------------------------------------------------ prior years


def prior_years(keys: Sequence[str], date: str) -> W:
    """Same (month, day) in strictly earlier years."""
    return (
        W.partitionBy(*keys, F.month(date), F.dayofmonth(date)).orderBy(F.year(date)).rowsBetween(W.unboundedPreceding, -1)
    )


def prior_year_z(keys: Sequence[str], date: str, c: str) -> Column:
    w = prior_years(keys, date)
    # One prior value has no spread; a zero spread gives no z.
    return div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))


def prior_year_anomaly(keys: Sequence[str], date: str, c: str) -> Column:
    return F.col(c) - F.avg(c).over(prior_years(keys, date))


# ------------------------------------------------------------------ differences and returns


def diff(keys: Sequence[str], order: str, c: str, n: int = 1) -> Column:
    return F.col(c) - F.lag(c, n).over(by(keys, order))


def consecutive_revision(keys: Sequence[str], date: str, c: str) -> tuple[Column, Column]:
    """(revision, flag): change since the previous run only if that run was exactly one day before."""
    w = by(keys, date)
    ok = F.datediff(F.col(date), F.lag(date).over(w)) == 1
    return F.when(ok, F.col(c) - F.lag(c).over(w)), F.coalesce(ok, F.lit(False))


def pct_change(keys: Sequence[str], order: str, c: str, n: int = 1) -> Column:
    return div(c, F.lag(c, n).over(by(keys, order))) - 1


def rolling_vol(keys: Sequence[str], order: str, ret: str, k: int, min_n: int, per_year: float = 252.0) -> Column:
    w = rows_back(keys, [order], k)
    return guarded(F.stddev_samp(ret).over(w), F.count(ret).over(w), min_n) * F.lit(math.sqrt(per_year))


def rolling_beta(keys: Sequence[str], order: str, y: str, x: str, k: int, min_n: int, clip: float = 3.0) -> Column:
    """cov(y, x) / var(x) over trailing rows. The covariance uses complete pairs, the variance all x."""
    w = rows_back(keys, [order], k)
    pair = F.col(y).isNotNull() & F.col(x).isNotNull()
    cov = guarded(F.covar_samp(y, x).over(w), F.sum(pair.cast("int")).over(w), min_n)
    var = guarded(F.var_samp(x).over(w), F.count(x).over(w), min_n)
    beta = div(cov, var)
    return F.when(beta.isNotNull(), F.least(F.greatest(beta, F.lit(-clip)), F.lit(clip)))


def rolling_log_z(keys: Sequence[str], order: str, c: str, k: int, min_n: int) -> Column:
    x = F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
    w = rows_back(keys, [order], k)
    n = F.count(c).over(w)
    return div(x - guarded(F.avg(x).over(w), n, min_n), guarded(F.stddev_samp(x).over(w), n, min_n))


def forward_window(keys: Sequence[str], order: str, c: str, k: int, fn: str = "avg") -> Column:
    """Mean or sum over this row and the k-1 after it, NULL near the end."""
    w = by(keys, order).rowsBetween(0, k - 1)
    f = {"avg": F.avg, "sum": F.sum}[fn]
    return guarded(f(c).over(w), F.count(c).over(w), k)


def forward_return(keys: Sequence[str], order: str, close: str, h: int) -> Column:
    return div(F.lead(close, h).over(by(keys, order)), close) - 1


def target_end(keys: Sequence[str], order: str, h: int) -> Column:
    return F.lead(order, h).over(by(keys, order))


def relative_targets(own: str, others: Sequence[str], beta: str) -> tuple[Column, Column]:
    """(spread against the second other, return neutral to the basket of all others)."""
    basket = sum((F.col(c) for c in others[1:]), F.col(others[0])) / F.lit(float(len(others)))
    return F.col(own) - F.col(others[-1]), F.col(own) - F.col(beta) * basket


# ------------------------------------------------------------------ season and equity


def deseasonalise(df: DataFrame, keys: Sequence[str], date: str, c: str, out: str) -> DataFrame:
    """Value minus the mean of the same week in other years.

    Week and week-year totals are small grouped tables joined back on (key, week).
    """
    keys = list(keys)
    rows = df.withColumn("_w", F.weekofyear(date)).withColumn("_y", F.year(date))
    own = rows.groupBy(*keys, "_w", "_y").agg(F.sum(c).alias("_s"), F.count(c).alias("_n"))
    week = W.partitionBy(*keys, "_w")
    others = own.select(
        *keys, "_w", "_y",
        div(F.sum("_s").over(week) - F.coalesce("_s", F.lit(0.0)), F.sum("_n").over(week) - F.col("_n")).alias("_m"),
    )
    out_col = (F.col(c) - F.coalesce(F.col("_m"), F.lit(0.0))).alias(out)
    return rows.join(others, [*keys, "_w", "_y"]).select(*df.columns, out_col)


def cumulate(keys: Sequence[str], offset: str, c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(by(keys, offset).rowsBetween(W.unboundedPreceding, 0))


def equity(keys: Sequence[str], order: Sequence[str], net: str) -> Column:
    """Running product of (1 + net), safe for a wipe-out or a sign change."""
    w = by(keys, *order).rowsBetween(W.unboundedPreceding, 0)
    g = F.lit(1.0) + F.coalesce(F.col(net), F.lit(0.0))
    size = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)).over(w))
    negatives = F.sum((g < 0).cast("int")).over(w)
    dead = F.max((g == 0).cast("int")).over(w)
    return F.when(dead == 1, 0.0).when(negatives % 2 == 1, -size).otherwise(size)


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], net: str, start: float | None = None) -> DataFrame:
    """Equity, its running peak (from `start` when given) and the drop from it."""
    w = by(keys, *order).rowsBetween(W.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    return (
        df.withColumn("equity", equity(keys, order, net))
        .withColumn("peak", peak if start is None else F.greatest(peak, F.lit(start)))
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    )


# ------------------------------------------------------------------ contract strips


def strip_rank(keys: Sequence[str], expiry: str, contract: str) -> Column:
    """Position by expiry among one session's contracts (a handful of rows per partition)."""
    return F.row_number().over(by(keys, expiry, contract))


def eligible(df: DataFrame, date: str, expiry: str, roll: int) -> DataFrame:
    from tidemark.functions.scalar import busdays

    return df.withColumn("days_left", busdays(date, expiry)).filter(F.col("days_left") > roll)


def front_contract(df: DataFrame, keys: Sequence[str], date: str, expiry: str, contract: str, roll: int, payload: Sequence[str]) -> DataFrame:
    """Nearest contract outside the roll window per key and session: one grouped minimum, no sort."""
    s = F.struct(*[F.col(c) for c in (expiry, contract, *payload)])
    return (
        eligible(df, date, expiry, roll).groupBy(*keys, date)
        .agg(F.min_by(s, F.struct(expiry, contract)).alias("_s")).select(*keys, date, "_s.*")
    )


def curve(df: DataFrame, keys: Sequence[str], date: str, expiry: str, contract: str, settle: str, roll: int) -> DataFrame:
    """Two nearest contracts per session, the slope between them, its 20-row change and volatility."""
    ranked = eligible(df, date, expiry, roll).withColumn("_r", strip_rank([*keys, date], expiry, contract))

    def at(r: int, c: str) -> Column:
        return F.max(F.when(F.col("_r") == r, F.col(c)))

    two = (
        ranked.filter("_r <= 2").groupBy(*keys, date)
        .agg(
            at(1, contract).alias("near"), at(2, contract).alias("far"),
            at(1, settle).alias("near_settle"), at(2, settle).alias("far_settle"),
        )
        .filter("far IS NOT NULL")
        .withColumn("slope", div("far_settle", "near_settle") - 1)
    )
    two = two.withColumn("slope_mom20", diff(keys, date, "slope", 20)).withColumn("_d1", diff(keys, date, "slope", 1))
    return two.withColumn("slope_vol20", rolling_vol(keys, date, "_d1", 20, 15)).drop("_d1")


# ------------------------------------------------------------------ alignment, ranks and quantiles


def shift_within(keys: Sequence[str], order: str, c: str, n: int) -> Column:
    """Shift by n rows inside a key (n > 0 moves values later)."""
    w = by(keys, order)
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def rank_gap(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Descending ranks of two measures and the difference of their z-scores within a key."""
    every = W.partitionBy(*keys)

    def z(c: str) -> Column:
        return div(F.col(c) - F.avg(c).over(every), F.stddev_samp(c).over(every))

    def rank(c: str) -> Column:
        w = W.partitionBy(*keys).orderBy(F.col(c).desc())
        ties = F.count(F.lit(1)).over(W.partitionBy(*keys, c))
        # Average rank of ties, truncated to a whole number.
        return F.floor(F.rank().over(w) + (ties - 1) / F.lit(2.0)).cast("long")

    return df.withColumn("rank_a", rank(a)).withColumn("rank_b", rank(b)).withColumn("gap", z(b) - z(a))


def quantile_edges(df: DataFrame, keys: Sequence[str], c: str, qs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per key.

    `percentile` keeps a map of distinct values per key; callers pass measures already folded
    to one row per (key, date or year).
    """
    return df.groupBy(*keys).agg(
        F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias("_e"),
        F.count(c).alias("_n"), F.count_distinct(c).alias("_u"),
    )


def quantile_bucket(
    df: DataFrame, keys: Sequence[str], c: str, qs: Sequence[float], labels: Sequence[str], min_n: int, out: str
) -> DataFrame:
    """Right-closed quantile labels; NULL when there are too few rows or the edges coincide."""
    e = quantile_edges(df, keys, c, qs)
    edges = [F.col("_e")[i] for i in range(len(qs))]
    ok = F.col("_n") >= min_n
    for lo, hi in zip(edges, edges[1:]):
        ok = ok & (lo < hi)
    label = F.lit(labels[-1])
    for edge, name in reversed(list(zip(edges, labels))):
        label = F.when(F.col(c) <= edge, name).otherwise(label)
    joined = df.join(e, list(keys)) if keys else df.crossJoin(single_row(e))
    return joined.withColumn(out, F.when(ok & F.col(c).isNotNull(), label)).drop("_e", "_n", "_u")


def autocorr(df: DataFrame, keys: Sequence[str], order: str, c: str, k: int) -> DataFrame:
    lagged = df.withColumn("_l", F.lag(c, k).over(by(keys, order)))
    return lagged.groupBy(*keys).agg(
        corr(c, "_l").alias("autocorr"), F.count(F.when(F.col("_l").isNotNull(), F.col(c))).alias("pairs")
    )


def last_of_period(df: DataFrame, keys: Sequence[str], bucket: Column, date: str, payload: Sequence[str]) -> DataFrame:
    """Last row of each period per key as a grouped maximum."""
    s = F.struct(date, *payload)
    return df.groupBy(*keys, bucket.alias("period")).agg(F.max_by(s, F.col(date)).alias("_s")).select(*keys, "period", "_s.*")


def lead_lag_frame(df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, ks: Sequence[int]) -> DataFrame:
    """x at t paired with y at t+k for every k, as correlation and count per k.

    Each x row is copied once per k (a short fixed list) and meets y in an equi-join.
    """
    a = df.select(*keys, F.col(idx).alias("_i"), F.col(x).alias("_x"))
    a = a.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("_j", F.col("_i") + F.col("k"))
    b = df.select(*keys, F.col(idx).alias("_j"), F.col(y).alias("_y"))
    return a.join(b, [*keys, "_j"]).groupBy(*keys, "k").agg(
        corr("_x", "_y").alias("r"), F.count(F.when(F.col("_y").isNotNull(), F.col("_x"))).alias("n")
    )


def pct_rank(df: DataFrame, keys: Sequence[str], c: str, out: str) -> DataFrame:
    """Average rank / n of a value within its key's record; rows without a value have none and count for none."""
    known = F.col(c).isNotNull()
    w = W.partitionBy(*keys, known)
    below = F.rank().over(w.orderBy(c))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, c))
    n = F.count(c).over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(known, (below + (ties - 1) / F.lit(2.0)) / n))
