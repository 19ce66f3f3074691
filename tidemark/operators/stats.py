"""Moments, regressions and comparisons.

A regression needs only counts, means and centred cross-products, which Spark aggregates
with map-side partials. Fits are solved from that one small row per group: in closed form
for one or two regressors, by a batched solve over moment rows otherwise. Leaving a row out
subtracts its own share from the group's moments instead of refitting.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import corr, div, normal_two_sided_p

from .common import by, single_row
from .pit import asof_join

# ------------------------------------------------------------------ correlation


def correlate(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 8) -> DataFrame:
    """Pearson r, n, normal-approximation p and stars; NULL below min_n or for a constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*keys).agg(
        corr(x, y).alias("_r"), F.sum(both.cast("long")).alias("n")
    )
    r = F.when(F.col("n") >= min_n, F.col("_r"))
    t = r * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), F.lit(1.0) - r * r))
    out = out.withColumn("r", r).withColumn("p", normal_two_sided_p(t)).drop("_r")
    return out.withColumn(
        "stars", F.when(F.col("p") < 0.01, "***").when(F.col("p") < 0.05, "**").when(F.col("p") < 0.10, "*").otherwise("")
    )


def corr_matrix(
    features: DataFrame, targets: DataFrame, keys: Sequence[str], year: str, measures: Sequence[str], target: str, min_n: int = 8
) -> DataFrame:
    """Every measure against the target, same-year and one year lagged, with the number of tests."""
    stack = ", ".join(f"'{m}', `{m}`" for m in measures)
    long = features.select(*keys, year, F.expr(f"stack({len(measures)}, {stack}) as (measure, _x)"))
    shifts = F.array(F.struct(F.lit("same").alias("alignment"), F.lit(0).alias("_k")), F.struct(F.lit("lagged").alias("alignment"), F.lit(1).alias("_k")))
    long = long.select("*", F.inline(shifts)).withColumn(year, F.col(year) + F.col("_k"))
    j = long.join(targets.select(*keys, year, target), [*keys, year])
    return correlate(j, [*keys, "measure", "alignment"], "_x", target, min_n).withColumn("tests", F.lit(2 * len(measures)))


# ------------------------------------------------------------------ trend


def detrend(df: DataFrame, keys: Sequence[str], year: str, y: str, fit: Column, out: str, min_fit: int = 3) -> DataFrame:
    """Deviation from a linear trend as a fraction of it, the trend fitted on `fit` rows only.

    A non-positive trend stops the job: a share of it would flip signs silently.
    """
    use = fit & F.col(y).isNotNull()
    t = df.groupBy(*keys).agg(
        F.regr_slope(F.when(use, F.col(y)), F.when(use, F.col(year))).alias("_b"),
        F.regr_intercept(F.when(use, F.col(y)), F.when(use, F.col(year))).alias("_a"), F.sum(use.cast("int")).alias("_n"),
    )
    j = df.join(t, list(keys)).withColumn("trend", F.when(F.col("_n") >= min_fit, F.col("_a") + F.col("_b") * F.col(year)))
    safe = F.when(F.col("trend") <= 0, F.raise_error(F.lit("non-positive trend")).cast("double")).otherwise(F.col(y) / F.col("trend") - 1)
    return j.withColumn(out, safe).drop("_a", "_b", "_n")


# ------------------------------------------------------------------ moments and fits


def moment_exprs(y: str, xs: Sequence[str], use: Column | None = None) -> dict[str, Column]:
    """n, means and centred cross-products of complete rows, as aggregate (or window) expressions."""
    full = F.col(y).isNotNull()
    for x in xs:
        full = full & F.col(x).isNotNull()
    if use is not None:
        full = full & use

    def v(c: str) -> Column:
        return F.when(full, F.col(c).cast("double"))

    out = {"_n": F.count(v(y)), "_my": F.avg(v(y)), "_syy": F.var_pop(v(y))}
    for i, x in enumerate(xs):
        out[f"_m{i}"] = F.avg(v(x))
        out[f"_c{i}"] = F.covar_pop(v(x), v(y))
        for j in range(i, len(xs)):
            out[f"_s{i}{j}"] = F.covar_pop(v(x), v(xs[j]))
    return out


def moments(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], use: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in moment_exprs(y, xs, use).items()])


def slopes(p: int, alpha: float = 0.0, m: Mapping[str, Column] | None = None) -> list[Column]:
    """Slopes on the raw scale for one or two regressors.

    alpha > 0 is a ridge penalty on population-standardised regressors, which adds
    alpha/n of each variance to the diagonal. A constant regressor gets slope zero.
    """
    m = m or {k: F.col(k) for k in ("_n", "_s00", "_c0", "_s01", "_s11", "_c1")}
    grow = F.lit(1.0) + F.lit(float(alpha)) / m["_n"]
    a, ca = m["_s00"] * grow, m["_c0"]
    if p == 1:
        return [F.when(a > 0, ca / a).otherwise(0.0)]
    d, cd, b = m["_s11"] * grow, m["_c1"], m["_s01"]
    det = a * d - b * b
    ok = det > a * d * 1e-12
    b0 = F.when(ok, (ca * d - cd * b) / F.when(ok, det)).when(a > 0, ca / F.when(a > 0, a)).otherwise(0.0)
    b1 = F.when(ok, (cd * a - ca * b) / F.when(ok, det)).when((a <= 0) & (d > 0), cd / F.when(d > 0, d)).otherwise(0.0)
    return [b0, b1]


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per group: intercept, slopes, standard errors, t, R2 and adjusted R2 for one or two regressors."""
    if len(xs) > 2:
        return ols_wide(df, keys, y, xs)
    p = len(xs)
    m = moments(df, keys, y, xs)
    for i, b in enumerate(slopes(p)):
        m = m.withColumn(f"b_{xs[i]}", b)
    fit = sum((F.col(f"b_{x}") * F.col(f"_m{i}") for i, x in enumerate(xs)), F.lit(0.0))
    sse = (F.col("_syy") - sum((F.col(f"b_{x}") * F.col(f"_c{i}") for i, x in enumerate(xs)), F.lit(0.0))) * F.col("_n")
    dof = F.col("_n") - F.lit(p + 1)
    m = m.withColumn("intercept", F.col("_my") - fit).withColumn("_sse", F.greatest(sse, F.lit(0.0)))
    m = m.withColumn("r2", F.when(F.col("_syy") > 1e-20, 1 - F.col("_sse") / (F.col("_syy") * F.col("_n"))))
    m = m.withColumn("adjusted_r2", F.when(dof > 0, 1 - (1 - F.col("r2")) * (F.col("_n") - 1) / dof))
    sigma2 = F.when(dof > 0, F.col("_sse") / dof)
    inv = [F.col("_s11"), F.col("_s00")] if p == 2 else [F.lit(1.0)]
    det = (F.col("_s00") * F.col("_s11") - F.col("_s01") * F.col("_s01")) if p == 2 else F.col("_s00")
    # the rule of `slopes`: a regressor that gets slope zero has no error, the other one that of its own fit
    ok = det > (F.col("_s00") * F.col("_s11") * 1e-12 if p == 2 else F.lit(0.0))
    alone = [F.col("_s00"), F.when(F.col("_s00") <= 0, F.col("_s11"))]
    for i, x in enumerate(xs):
        spread = F.when(ok, div(inv[i], det)).otherwise(F.when(alone[i] > 0, div(F.lit(1.0), alone[i])))
        se = F.sqrt(sigma2 * spread / F.col("_n"))
        m = m.withColumn(f"se_{x}", se).withColumn(f"t_{x}", div(f"b_{x}", f"se_{x}"))
    keep = [f"{q}_{x}" for x in xs for q in ("b", "se", "t")]
    return m.select(*keys, F.col("_n").alias("n"), "intercept", *keep, "r2", "adjusted_r2")


def ols_wide(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], alpha: float = 0.0) -> DataFrame:
    """Any number of regressors: Spark aggregates the moments, tasks solve batches of moment rows."""
    p = len(xs)
    m = moments(df, keys, y, xs)
    packed = m.select(
        *keys, "_n", "_my", "_syy", F.array(*[f"_m{i}" for i in range(p)]).alias("_m"), F.array(*[f"_c{i}" for i in range(p)]).alias("_c"),
        F.array(*[f"_s{min(i, j)}{max(i, j)}" for i in range(p) for j in range(p)]).alias("_s"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema.fields)
    names = list(keys)
    out = [f"b_{x}" for x in xs] + [f"t_{x}" for x in xs]
    schema = ", ".join(filter(None, [fields, "n bigint, intercept double", *[f"`{c}` double" for c in out], "r2 double"]))

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, my, syy, mean, c, s = r[len(names):]
                gram = np.asarray(s, dtype=float).reshape(p, p)
                c = np.asarray(c, dtype=float)
                reg = gram + np.diag(np.diag(gram) * alpha / n)
                inv = np.linalg.pinv(reg)
                b = inv @ c
                sse = max(n * (syy - b @ c), 0.0)
                dof = n - p - 1
                se = np.sqrt(np.maximum(np.diag(inv), 0.0) / n * sse / dof) if dof > 0 else np.full(p, np.nan)
                t = [float(bi / si) if si > 0 else None for bi, si in zip(b, se)]
                r2 = 1 - sse / (n * syy) if syy > 1e-20 else None
                rows.append([*r[: len(names)], int(n), float(my - b @ np.asarray(mean)), *map(float, b), *t, r2])
            yield pd.DataFrame(rows, columns=[*names, "n", "intercept", *out, "r2"])

    return packed.mapInPandas(solve, schema)


# ------------------------------------------------------------------ horse race


def drop_one(m: dict[str, Column], y: Column, xs: Sequence[Column]) -> dict[str, Column]:
    """Moments of a group without the current row, from the group's moments and the row itself.

    A variance that the row held alone is zero without it, not what rounding leaves.
    """
    n = m["_n"].cast("double")
    left = n - 1
    out = {"_n": left}
    dy = y - m["_my"]
    scale = n / left

    def cut(s: Column, a: Column, b: Column) -> Column:
        return (s * n - scale * a * b) / left

    def cut_square(s: Column, a: Column) -> Column:
        rest = cut(s, a, a)
        return F.when(rest > s * 1e-12, rest).otherwise(F.when(rest.isNotNull(), 0.0))

    out["_my"] = (m["_my"] * n - y) / left
    out["_syy"] = cut_square(m["_syy"], dy)
    for i, x in enumerate(xs):
        dx = x - m[f"_m{i}"]
        out[f"_c{i}"] = cut(m[f"_c{i}"], dx, dy)
        out[f"_s{i}{i}"] = cut_square(m[f"_s{i}{i}"], dx)
        for j in range(i + 1, len(xs)):
            out[f"_s{i}{j}"] = cut(m[f"_s{i}{j}"], dx, xs[j] - m[f"_m{j}"])
    return out


def r2_one(c: Column, s: Column, syy: Column) -> Column:
    """R2 of one regressor; a constant one explains nothing."""
    return div(F.when(s > 0, c * c / F.when(s > 0, s)).otherwise(F.when(s.isNotNull(), 0.0)), syy)


def r2_two(m: Mapping[str, Column]) -> Column:
    b = slopes(2, 0.0, {**m})
    return div(b[0] * m["_c0"] + b[1] * m["_c1"], m["_syy"])


def horse_race(df: DataFrame, keys: Sequence[str], actual: str, forecast: str, price: str, year: str, min_n: int = 8) -> DataFrame:
    """Forecast alone, price alone and both: R2 of each, what the forecast adds, and its drop-one range.

    The drop-one scores come from one pass that takes each row's share out of the group moments.
    """
    keys = list(keys)
    rows = df.dropna(subset=[actual, forecast, price])
    m = moments(rows, keys, actual, [forecast, price]).filter(F.col("_n") >= min_n)
    c = {k: F.col(k) for k in ("_n", "_my", "_syy", "_m0", "_m1", "_c0", "_c1", "_s00", "_s01", "_s11")}
    each = rows.join(m, keys)
    d = drop_one(c, F.col(actual), [F.col(forecast), F.col(price)])
    inc = (r2_two(d) - r2_one(d["_c1"], d["_s11"], d["_syy"])).alias("_inc")
    each = each.select(*keys, year, inc)
    span = each.groupBy(*keys).agg(
        F.min("_inc").alias("incremental_min"), F.max("_inc").alias("incremental_max"),
        # rounded for ranking only, so that equal years go to the first one
        F.min_by(year, F.struct(F.round("_inc", 12), year)).alias("load_bearing_year"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )
    joint = slopes(2, 0.0, c)
    alone = slopes(1, 0.0, c)[0]
    out = m.select(
        *keys, F.col("_n").alias("harvests"), r2_one(c["_c0"], c["_s00"], c["_syy"]).alias("forecast_r2"),
        r2_one(c["_c1"], c["_s11"], c["_syy"]).alias("price_r2"), r2_two(c).alias("joint_r2"),
        alone.alias("beta_alone"), joint[0].alias("beta_joint"), joint[1].alias("price_beta_joint"),
        F.when(F.abs(alone) > 1e-12, div(joint[0], alone)).alias("beta_retained"),
    )
    return out.withColumn("incremental_r2", F.col("joint_r2") - F.col("price_r2")).join(span, keys)


# ------------------------------------------------------------------ prices


def price_signal(series: DataFrame, keys: Sequence[str], date: str, price: str, issues: DataFrame, baseline: str, issue: str) -> DataFrame:
    """Log change from the last price on or before a baseline date to the last before an issue date."""
    quotes = series.filter(F.col(price) > 0).select(*keys, F.col(date).alias("_q"), F.col(date).alias("baseline_date"), F.col(price).alias("_p0"))
    a = asof_join(issues, quotes, keys, baseline, "_q", ["baseline_date", "_p0"], grid=True)
    later = series.select(*keys, F.col(date).alias("_q"), F.col(date).alias("signal_date"), F.col(price).alias("_p1"))
    b = asof_join(a, later, keys, issue, "_q", ["signal_date", "_p1"], strict=True, grid=True)
    ok = F.col("_p0").isNotNull() & (F.col("_p1") > 0) & (F.col("signal_date") >= F.col(baseline))
    return b.filter(ok).withColumn("price_change", F.log(F.col("_p1") / F.col("_p0"))).drop("_p0", "_p1")


def return_moments(df: DataFrame, keys: Sequence[str], date: str, close: str, horizons: Sequence[int], months: Sequence[int]) -> DataFrame:
    """Spread of in-season log returns per horizon, overlapping and independent counts."""
    w = by(keys, date)
    logp = F.log(F.when(F.col(close) > 0, F.col(close)))
    rows = df.withColumn("_l", logp)
    rets = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col("_l") - F.lag("_l", h).over(w)).alias("_r")) for h in horizons])
    long = rows.withColumn("_a", rets).select(*keys, date, F.inline("_a")).filter(F.col("_r").isNotNull() & F.month(date).isin(*months))
    out = long.groupBy(*keys, "horizon").agg(
        F.stddev_samp("_r").alias("return_sd"), F.count("_r").alias("overlapping"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    return out.withColumn("independent", F.floor(F.col("overlapping") / F.col("horizon"))).filter(F.col("overlapping") >= F.col("horizon") * 2)


def power_budget(m: DataFrame, costs_bps: Sequence[float], alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Correlation that pays the cost next to the one the sample could have detected."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    cost = m.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])))
    even = div(F.col("cost_bps") / 10000.0, F.col("return_sd") * math.sqrt(2 / math.pi))
    out = cost.withColumn("break_even", even).withColumn("detectable", F.lit(z) / F.sqrt("independent"))
    need = F.ceil(F.pow(div(F.lit(z), "break_even"), 2))
    return out.withColumn("observations_needed", need).withColumn("shortfall", div("observations_needed", "independent")).withColumn(
        "blind", F.col("break_even") < F.col("detectable")
    )


def stress_index(df: DataFrame, keys: Sequence[str], parts: Mapping[str, int], outcome: str, n: int, tiebreak: str) -> DataFrame:
    """Mean of signed z-scores, and the outcome's mean in the n most stressed rows against the rest."""
    w = W.partitionBy(*keys)
    z = [F.lit(float(s)) * div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c, s in parts.items()]
    scored = df.withColumn("stress", sum(z[1:], z[0]) / F.lit(float(len(z))))
    scored = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("stress"), tiebreak)))
    top = F.col("rank") <= n
    return scored.withColumn("mean_top", F.avg(F.when(top, F.col(outcome))).over(w)).withColumn(
        "mean_rest", F.avg(F.when(~top, F.col(outcome))).over(w)
    )


def pair_comovement(df: DataFrame, on: Sequence[str], member: str, value: str) -> DataFrame:
    """Every two members (a before b) over the periods that both have: correlation and how often signs oppose.

    A period's members are one array (`on` and `member` are unique together), paired where they lie, so
    the frame is shuffled once and not joined to itself; only grouped sums go on to a second exchange.
    """
    s = F.struct(F.col(member).alias("m"), F.col(value).alias("v"))
    held = df.filter(F.col(member).isNotNull() & F.col(value).isNotNull())
    per = held.groupBy(*on).agg(F.sort_array(F.collect_list(s)).alias("_s"))
    later = F.slice("_s", F.col("_i") + 2, F.size("_s"))
    pairs = per.select("_s", F.posexplode("_s").alias("_i", "_a")).select("_a", F.explode(later).alias("_b"))
    both = pairs.select(F.col("_a.m").alias("a"), F.col("_b.m").alias("b"), F.col("_a.v").alias("_x"), F.col("_b.v").alias("_y"))
    return both.groupBy("a", "b").agg(
        corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"), F.sum((F.col("_x") * F.col("_y") < 0).cast("long")).alias("opposite")
    )


def compare_returns(a: DataFrame, b: DataFrame, keys: Sequence[str], date: str, x: str, y: str) -> DataFrame:
    """Agreement of two price series in daily returns: correlation, median and largest difference."""
    j = a.select(*keys, date, x).join(b.select(*keys, date, y), [*keys, date])
    w = by(keys, date)
    j = j.withColumn("_x", div(x, F.lag(x).over(w)) - 1).withColumn("_y", div(y, F.lag(y).over(w)) - 1).dropna(subset=["_x", "_y"])
    gap = F.abs(F.col("_x") - F.col("_y"))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), corr("_x", "_y").alias("correlation"),
        F.percentile(gap, F.lit(0.5)).alias("median_gap"), F.max(gap).alias("max_gap"),
    )


def agreement(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sign agreement and correlation between two definitions of an outcome."""
    rows = df.dropna(subset=[x, y])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("same_sign"),
        corr(x, y).alias("r"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mean_gap"),
    )
