"""Walk-forward folds, refits inside folds, scores, intervals and decisions.

Annual refits copy a harvest into every fold that trains on it. That is bounded by the
record: one row per (key, harvest), so a century gives a few thousand copies per key. All
fits of all folds and keys then run in one windowed pass, partitioned by (key, fold).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import corr, div, position

from .common import by
from .stats import moment_exprs, slopes

# ------------------------------------------------------------------ fold assignment


def forward_folds(
    df: DataFrame, keys: Sequence[str], order: str, splits: int, embargo: int, min_train: int = 50, min_test: int = 10
) -> DataFrame:
    """Expanding folds by row position: each row is copied into the folds it trains or tests."""
    keys = list(keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rows = df.withColumn("_p", F.row_number().over(by(keys, order)) - 1).withColumn("_size", F.floor(n / F.lit(splits + 1)))
    f = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    start = F.col("_size") * F.col("fold")
    role = F.when(F.col("_p") < start - embargo, "train").when((F.col("_p") >= start) & (F.col("_p") < start + F.col("_size")), "test")
    f = f.withColumn("role", role).filter("role IS NOT NULL")
    # Fold sizes follow from positions alone; no counting pass is needed.
    big = (F.greatest(start - embargo, F.lit(0)) >= min_train) & (F.col("_size") >= min_test)
    return f.filter(big).drop("_p", "_size")


def year_folds(df: DataFrame, year: str, tests: Sequence[int], first: int, sealed: int | None = None) -> DataFrame:
    """Train on earlier years, test on one; the sealed year is never returned."""
    rows = df if sealed is None else df.filter(F.col(year) != sealed)
    f = rows.filter(F.col(year) >= first).withColumn("fold", F.explode(F.array(*[F.lit(t) for t in tests])))
    return f.withColumn("role", F.when(F.col(year) < F.col("fold"), "train").when(F.col(year) == F.col("fold"), "test")).filter(
        "role IS NOT NULL"
    )


def inner_split(
    df: DataFrame, keys: Sequence[str], order: str, frac: float, embargo: int, min_fit: int = 50,
    entry: str | None = None, exit: str | None = None,
) -> DataFrame:
    """Trailing validation block of a training set, `embargo` rows apart from the fit block.

    With entry and exit columns the split is by date: a fit row must have exited before the
    first validation entry.
    """
    keys = list(keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    p = F.row_number().over(by(keys, order)) - 1
    rows = df.withColumn("_p", p).withColumn("_b", F.greatest(F.lit(min_fit + 1), F.floor(n * F.lit(1.0 - frac))))
    valid = F.col("_p") >= F.col("_b")
    if entry is None:
        part = F.when(valid, "valid").when(F.col("_p") < F.col("_b") - embargo, "fit")
    else:
        rows = rows.withColumn("_e", F.min(F.when(valid, F.col(entry))).over(W.partitionBy(*keys)))
        part = F.when(valid, "valid").when(F.col(exit) < F.col("_e"), "fit")
    return rows.withColumn("part", part).filter("part IS NOT NULL").drop("_p", "_b", *([] if entry is None else ["_e"]))


# ------------------------------------------------------------------ preparation and linear fits


def fit_prep(df: DataFrame, keys: Sequence[str], cols: Sequence[str], train: Column) -> DataFrame:
    """Median imputation and standardisation learned on training rows only.

    Training statistics are one small row per fold, joined back to all its rows.
    """
    med = df.groupBy(*keys).agg(*[F.percentile(F.when(train, F.col(c)), F.lit(0.5)).alias(f"_md_{c}") for c in cols])
    filled = df.join(med, list(keys))
    for c in cols:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_md_{c}")))
    sums = filled.groupBy(*keys).agg(
        *[F.avg(F.when(train, F.col(c))).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_sd_{c}") for c in cols]
    )
    out = filled.join(sums, list(keys))
    for c in cols:
        scale = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"_mu_{c}")) / scale)
    return out.drop(*[f"_{q}_{c}" for c in cols for q in ("md", "mu", "sd")])


def fit_ridge(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], alpha: float, out: str = "score") -> DataFrame:
    """Standardised ridge per fold from training moments, applied to every row of the fold.

    Closed form for one or two features; more go through a batched solve over moment rows.
    """
    train = F.col("role") == "train"
    if len(xs) > 2:
        from .stats import ols_wide

        fit = ols_wide(df.filter(train), keys, y, xs, alpha).select(*keys, "intercept", *[F.col(f"b_{x}").alias(f"_b{i}") for i, x in enumerate(xs)])
    else:
        m = df.groupBy(*keys).agg(*[c.alias(n) for n, c in moment_exprs(y, xs, train).items()])
        for i, b in enumerate(slopes(len(xs), alpha)):
            m = m.withColumn(f"_b{i}", b)
        fit = m.withColumn("intercept", F.col("_my") - sum((F.col(f"_b{i}") * F.col(f"_m{i}") for i in range(len(xs))), F.lit(0.0)))
        fit = fit.select(*keys, "intercept", *[f"_b{i}" for i in range(len(xs))])
    score = sum((F.col(f"_b{i}") * F.col(x) for i, x in enumerate(xs)), F.col("intercept"))
    return df.join(fit, list(keys)).withColumn(out, score).drop("intercept", *[f"_b{i}" for i in range(len(xs))])


def ridge_grid(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], alphas: Mapping[str, float], out: str = "score") -> DataFrame:
    """Test rows scored by every ridge of a grid, with the candidate's name and its place in the list.

    The training moments of a fold are taken once and serve all candidates; one or two features.
    """
    m = df.groupBy(*keys).agg(*[c.alias(n) for n, c in moment_exprs(y, xs, F.col("role") == "train").items()])
    cells = []
    for place, (name, alpha) in enumerate(alphas.items()):
        b = slopes(len(xs), alpha)
        intercept = F.col("_my") - sum((b[i] * F.col(f"_m{i}") for i in range(len(xs))), F.lit(0.0))
        cells.append(F.struct(F.lit(name).alias("candidate"), F.lit(place).alias("place"), intercept.alias("_a"), *[b[i].alias(f"_b{i}") for i in range(len(xs))]))
    fits = m.select(*keys, F.inline(F.array(*cells)))
    score = sum((F.col(f"_b{i}") * F.col(x) for i, x in enumerate(xs)), F.col("_a"))
    rows = df.filter("role = 'test'").join(fits, list(keys))
    return rows.withColumn(out, score).drop("_a", *[f"_b{i}" for i in range(len(xs))])


def nested_choice(
    df: DataFrame, keys: Sequence[str], order: str, y: str, xs: Sequence[str], cost: str, alphas: Mapping[str, float], frac: float = 0.2, embargo: int = 1
) -> DataFrame:
    """Candidate and threshold of each fold, chosen on the tail of its training rows only.

    Every candidate is fitted on the training block without its tail and scored on the tail, `embargo`
    rows later. Returns what `choose` returns, per fold; refit the choice with `refit_choice`.
    """
    train = df.filter("role = 'train'").drop("role")
    inner = inner_split(train, keys, order, frac, embargo).withColumn("role", F.when(F.col("part") == "fit", "train").otherwise("test"))
    scored = ridge_grid(inner, keys, y, xs, alphas)
    return choose(scored, keys, "candidate", "score", y, cost, place="place")


def refit_choice(df: DataFrame, chosen: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], alphas: Mapping[str, float]) -> DataFrame:
    """Test rows scored by the chosen candidate, refitted on the whole training block, and the position it takes."""
    scored = ridge_grid(df, keys, y, xs, alphas).join(chosen.select(*keys, "candidate", "threshold"), [*keys, "candidate"])
    return scored.withColumn("signal", position("score", F.col("threshold"))).drop("place")


def score_folds(df: DataFrame, keys: Sequence[str], fold: str, y: str, pred: str) -> DataFrame:
    """R2 against the training mean, hit rate and sizes per fold, averaged over folds."""
    keys = list(keys)
    train, test = F.col("role") == "train", F.col("role") == "test"
    means = df.groupBy(*keys, fold).agg(F.avg(F.when(train, F.col(y))).alias("_mu"), F.sum(train.cast("long")).alias("n_train"))
    t = df.filter(test).join(means, [*keys, fold])
    moved = F.col(pred) != 0
    folds = t.groupBy(*keys, fold).agg(
        (1 - div(F.sum((F.col(y) - F.col(pred)) ** 2), F.sum((F.col(y) - F.col("_mu")) ** 2))).alias("r2"),
        F.avg(F.when(moved, (F.signum(pred) == F.signum(y)).cast("double"))).alias("hit_rate"),
        F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
    )
    return folds.groupBy(*keys).agg(
        F.avg("r2").alias("r2"), F.avg("hit_rate").alias("hit_rate"), F.floor(F.avg("n_train")).alias("n_train"),
        F.floor(F.avg("n_test")).alias("n_test"), F.count(F.lit(1)).alias("folds"),
    )


# ------------------------------------------------------------------ choice inside a fold


#: Thresholds of a score that is a difference of probabilities.
PROBABILITY_THRESHOLDS = (0.0, 0.10, 0.20, 0.35, 0.50)


def thresholds(
    df: DataFrame, keys: Sequence[str], score: str, cost: str, qs: Sequence[float] = (0.5, 0.7, 0.85), fixed: Sequence[float] | None = None
) -> DataFrame:
    """Action thresholds per key, without repeats: the cost and quantiles of |score|, or a fixed list.

    Quantiles are taken over distinct values with their counts, so a key's rows never meet in one place.
    """
    if fixed is not None:
        return df.select(*keys).distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in fixed])))
    folded = df.groupBy(*keys, F.abs(F.col(score)).alias("_a")).agg(F.count(F.lit(1)).alias("_f"))
    q = folded.groupBy(*keys).agg(F.percentile("_a", F.array(*[F.lit(q) for q in qs]), F.col("_f")).alias("_q"))
    costs = df.groupBy(*keys, F.col(cost).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    c = costs.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5), F.col("_f")).alias("_c"))
    values = F.array_distinct(F.concat(F.array("_c"), F.coalesce("_q", F.array().cast("array<double>"))))
    return c.join(q, list(keys), "left").select(*keys, F.explode(values).alias("threshold"))


def choose(
    df: DataFrame, keys: Sequence[str], candidate: str, score: str, actual: str, cost: str, min_share: float = 0.05, min_trades: int = 10,
    place: str | None = None, fixed: Sequence[float] | None = None,
) -> DataFrame:
    """Candidate and threshold with the best Sharpe, then net, among cells with enough trades.

    Equal cells go to the candidate listed first (`place` is its number in the list; without one its
    name decides), then to the smallest threshold. A key where no cell trades enough gets the first
    candidate and an infinite threshold, i.e. no trade. `fixed` thresholds replace those from the scores.
    """
    keys = list(keys)
    place = place or candidate
    first = list(dict.fromkeys([candidate, place]))
    grid = df.join(thresholds(df, [*keys, *first], score, cost, fixed=fixed), [*keys, *first])
    pos = position(score, F.col("threshold"))
    cells = grid.withColumn("_pos", pos).withColumn("_net", F.col("_pos") * F.col(actual) - F.abs("_pos") * F.col(cost))
    cells = cells.groupBy(*keys, *first, "threshold").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("_pos") != 0).cast("long")).alias("trades"), F.sum("_net").alias("net"),
        (F.lit(math.sqrt(52.0)) * div(F.avg("_net"), F.stddev_samp("_net"))).alias("sharpe"),
    )
    # Rounded for ranking only, so the last bits of a sum cannot decide between equal cells.
    ok = F.col("trades") >= F.greatest(F.lit(min_trades), F.floor(F.col("_n") * min_share))
    low = F.lit(float("-inf"))
    rank = F.struct(
        F.when(ok, -F.coalesce(F.round("sharpe", 9), low)).alias("a"), (-F.round("net", 9)).alias("b"), F.col(place).alias("c"), F.col("threshold").alias("d")
    )
    best = cells.groupBy(*keys).agg(
        F.min_by(F.struct(candidate, "threshold", "trades", "net", "sharpe"), F.when(ok, rank)).alias("_s"), F.min_by(candidate, place).alias("_first")
    )
    return best.select(
        *keys, F.coalesce(F.col(f"_s.{candidate}"), F.col("_first")).alias(candidate),
        F.coalesce("_s.threshold", F.lit(float("inf"))).alias("threshold"), F.coalesce("_s.trades", F.lit(0)).alias("trades"),
        F.col("_s.net").alias("net"), F.col("_s.sharpe").alias("sharpe"),
    )


# ------------------------------------------------------------------ annual refits


def fold_copies(df: DataFrame, keys: Sequence[str], year: str, how: str) -> DataFrame:
    """Copies of each harvest with (fold, role).

    how = 'expanding': fold t trains on harvests before t. how = 'leave_one_out': fold t trains
    on all other harvests.
    """
    keys = list(keys)
    years = df.groupBy(*keys).agg(F.sort_array(F.collect_set(year)).alias("_y"))
    j = df.join(years, keys)
    wanted = F.filter("_y", lambda t: t >= F.col(year)) if how == "expanding" else F.col("_y")
    f = j.withColumn("fold", F.explode(wanted)).drop("_y")
    return f.withColumn("role", F.when(F.col("fold") == F.col(year), "test").otherwise("train"))


def refit(
    df: DataFrame, fold_keys: Sequence[str], year: str, y: str, sets: Mapping[str, Sequence[str]], alpha: float, min_train: int
) -> DataFrame:
    """Refit trend and standardised ridge inside every fold; rows whose role is not 'train' get predictions.

    Trend, fractional target and ridge moments are window aggregates over (key, fold), so one
    shuffle serves every feature set. Returns one row per test row and feature set, the
    trend-only control included.
    """
    fold_keys = list(fold_keys)
    w = W.partitionBy(*fold_keys)
    train = F.col("role") == "train"
    ty, tx = F.when(train, F.col(y)), F.when(train & F.col(y).isNotNull(), F.col(year))
    r = df.withColumn("_b", F.regr_slope(ty, tx).over(w)).withColumn("_a", F.regr_intercept(ty, tx).over(w))
    r = r.withColumn("train_years", F.sum(train.cast("long")).over(w)).withColumn("_first", F.min(tx).over(w)).withColumn("_last", F.max(tx).over(w))
    r = r.withColumn("trend", F.col("_a") + F.col("_b") * F.col(year)).withColumn("actual_anomaly", F.col(y) / F.col("trend") - 1)
    preds = {"trend_only": F.lit(0.0)}
    for name, xs in sets.items():
        m = {k: F.col(f"_{name}{k}") for k in moment_exprs("actual_anomaly", xs)}
        r = r.withColumns({f"_{name}{k}": c.over(w) for k, c in moment_exprs("actual_anomaly", xs, train).items()})
        b = slopes(len(xs), alpha, m)
        preds[name] = sum((bi * (F.col(x) - m[f"_m{i}"]) for i, (bi, x) in enumerate(zip(b, xs))), m["_my"])
    tests = r.filter(~train & (F.col("train_years") >= min_train))
    out = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_set"), p.alias("predicted_anomaly")) for n, p in preds.items()]))
    t = tests.withColumn("_o", out)
    return t.select(
        *fold_keys, F.col(year), "role", "_o.feature_set", "train_years", F.col("_first").alias("train_start"), F.col("_last").alias("train_end"),
        F.col(y).alias("actual"), "trend", "actual_anomaly", "_o.predicted_anomaly", (F.col("trend") * (1 + F.col("_o.predicted_anomaly"))).alias("predicted"),
    )


def expanding_predictions(df: DataFrame, keys: Sequence[str], year: str, y: str, sets: Mapping[str, Sequence[str]], min_train: int, alpha: float = 1.0) -> DataFrame:
    """Forecast each harvest from earlier ones only, on the harvests complete for every feature set."""
    cols = sorted({c for xs in sets.values() for c in xs})
    usable = df.dropna(subset=[*cols, y])
    f = fold_copies(usable, keys, year, "expanding")
    return refit(f, [*keys, "fold"], year, y, sets, alpha, min_train).drop("fold", "role")


def loyo(df: DataFrame, keys: Sequence[str], year: str, y: str, sets: Mapping[str, Sequence[str]], min_years: int = 10, alpha: float = 1.0) -> DataFrame:
    """Leave one harvest out with the trend refitted in the fold: R2 and correlation per key and set."""
    cols = sorted({c for xs in sets.values() for c in xs})
    f = fold_copies(df.dropna(subset=[*cols, y]), keys, year, "leave_one_out")
    p = refit(f, [*keys, "fold"], year, y, sets, alpha, 8).filter("feature_set <> 'trend_only'")
    g = p.groupBy(*keys, "feature_set").agg(
        F.count(F.lit(1)).alias("years"), F.sum((F.col("actual_anomaly") - F.col("predicted_anomaly")) ** 2).alias("_e"),
        (F.var_pop("actual_anomaly") * F.count(F.lit(1))).alias("_t"), corr("predicted_anomaly", "actual_anomaly").alias("r"),
    )
    return g.filter(F.col("years") >= min_years).select(*keys, "feature_set", "years", (1 - div("_e", "_t")).alias("r2"), "r")


# ------------------------------------------------------------------ scores


def score_exprs() -> list[Column]:
    e, b = F.col("predicted") - F.col("actual"), F.col("trend") - F.col("actual")
    n = F.count(F.lit(1))
    return [
        n.alias("test_years"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(b)).alias("trend_mae"),
        F.sqrt(F.avg(b * b)).alias("trend_rmse"), F.when(F.sum(b * b) > 1e-20, 1 - F.sum(e * e) / F.sum(b * b)).alias("r2_vs_trend"),
        F.when(F.avg(F.abs(b)) > 1e-10, 1 - F.avg(F.abs(e)) / F.avg(F.abs(b))).alias("mae_improvement"),
        (F.avg(F.abs(F.col("predicted_anomaly") - F.col("actual_anomaly"))) * 100).alias("anomaly_mae_pp"),
    ]


def score_predictions(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys).agg(*score_exprs())


def per_year_errors(pred: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """Model and trend error per harvest, the gap, and each harvest's share of the squared errors."""
    e, b = F.col("predicted") - F.col("actual"), F.col("trend") - F.col("actual")
    total = pred.groupBy(*keys).agg(F.sum(e * e).alias("_e"), F.sum(b * b).alias("_b"))
    return pred.join(total, list(keys)).select(
        *keys, year, e.alias("error"), b.alias("trend_error"), (F.abs(b) - F.abs(e)).alias("abs_error_gap"),
        ((F.col("predicted_anomaly") - F.col("actual_anomaly")) * 100).alias("anomaly_error_pp"),
        div(e * e, "_e").alias("sse_share"), div(b * b, "_b").alias("trend_sse_share"),
    )


def influence(pred: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """Rescore without one harvest at a time: group totals minus the harvest's own part."""
    e, b = F.col("predicted") - F.col("actual"), F.col("trend") - F.col("actual")
    t = pred.groupBy(*keys).agg(
        F.sum(e * e).alias("_e"), F.sum(b * b).alias("_b"), F.sum(F.abs(e)).alias("_m"), F.count(F.lit(1)).alias("test_years")
    ).filter("test_years >= 3")
    j = pred.join(t, list(keys))
    full = 1 - div("_e", "_b")
    without = 1 - div(F.col("_e") - e * e, F.col("_b") - b * b)
    return j.select(
        *keys, F.col(year).alias("dropped_year"), "test_years", full.alias("baseline_r2"), without.alias("r2_without"), (without - full).alias("r2_delta"),
        (F.col("_m") / F.col("test_years")).alias("baseline_mae"), ((F.col("_m") - F.abs(e)) / (F.col("test_years") - 1)).alias("mae_without"),
    )


def influence_summary(inf: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.struct("dropped_year", "r2_without")
    return inf.groupBy(*keys).agg(
        F.max("test_years").alias("test_years"), F.max("baseline_r2").alias("r2_vs_trend"), F.min("r2_without").alias("r2_min"),
        F.max("r2_without").alias("r2_max"), F.min_by(s, F.struct("r2_delta", "dropped_year")).alias("_s"),
        F.sum((F.signum("r2_without") != F.signum("baseline_r2")).cast("long")).alias("sign_flips"),
    ).select(*keys, "test_years", "r2_vs_trend", "r2_min", "r2_max", F.col("_s.dropped_year").alias("load_bearing_year"), "sign_flips")


def score_strata(pred: DataFrame, keys: Sequence[str], dims: Sequence[str], min_years: int = 4) -> DataFrame:
    """Scores per bucket of every dimension, thin buckets left out."""
    stack = ", ".join(f"'{d}', `{d}`" for d in dims)
    cols = [*keys, "predicted", "actual", "trend", "predicted_anomaly", "actual_anomaly"]
    long = pred.select(*cols, F.expr(f"stack({len(dims)}, {stack}) as (dimension, bucket)")).filter("bucket IS NOT NULL")
    return long.groupBy(*keys, "dimension", "bucket").agg(*score_exprs()).filter(F.col("test_years") >= min_years)


# ------------------------------------------------------------------ residuals, intervals, decisions


def fold_residuals(df: DataFrame, keys: Sequence[str], year: str, y: str, sets: Mapping[str, Sequence[str]], min_train: int, alpha: float = 1.0) -> DataFrame:
    """Per fold: the forecast, and leave-one-out residuals and forecasts from inside its training years.

    Every (fold, withheld harvest) refits trend and ridge without that harvest. Withheld 0 is
    the fold's own fit.
    """
    keys = list(keys)
    cols = sorted({c for xs in sets.values() for c in xs})
    f = fold_copies(df.dropna(subset=[*cols, y]), keys, year, "expanding").filter("role IS NOT NULL")
    n = F.sum((F.col("role") == "train").cast("long")).over(W.partitionBy(*keys, "fold"))
    f = f.withColumn("_n", n).filter(F.col("_n") >= min_train).drop("_n")
    held = F.array_sort(F.collect_set(F.when(F.col("role") == "train", F.col(year))).over(W.partitionBy(*keys, "fold")))
    zero = F.array(F.lit(0).cast(df.schema[year].dataType))
    g = f.withColumn("_held", F.concat(zero, held)).withColumn("withheld", F.explode("_held")).drop("_held")
    g = g.withColumn("role", F.when(F.col("withheld") == F.col(year), "held").otherwise(F.col("role")))
    p = refit(g, [*keys, "fold", "withheld"], year, y, sets, alpha, 2)
    own = (F.col("withheld") == 0) & (F.col("role") == "test")
    per = p.groupBy(*keys, "fold", "feature_set", "withheld").agg(
        F.max(F.when(F.col("role") == "held", F.col("actual") - F.col("predicted"))).alias("signed"),
        F.max(F.when(F.col("role") == "test", F.col("predicted"))).alias("at_test"),
        F.max(F.when(own, F.col("predicted"))).alias("point"), F.max(F.when(own, F.col("trend"))).alias("trend"),
        F.max(F.when(F.col("role") == "test", F.col("actual"))).alias("actual"),
    )
    out = per.groupBy(*keys, "fold", "feature_set").agg(
        F.max("point").alias("point"), F.max("trend").alias("trend"), F.max("actual").alias("actual"),
        F.array_sort(F.collect_list(F.when(F.col("withheld") != 0, F.struct("withheld", "signed", F.col("at_test").alias("loo_point"))))).alias("_l"),
    )
    train = f.withColumn("_y", F.col(y))
    tw = W.partitionBy(*keys, "fold")
    is_train = F.col("role") == "train"
    ty, tx = F.when(is_train, F.col(y)), F.when(is_train, F.col(year))
    train = train.withColumn("_t", F.regr_intercept(ty, tx).over(tw) + F.regr_slope(ty, tx).over(tw) * F.col(year)).filter(is_train)
    clim = train.groupBy(*keys, "fold").agg(F.collect_list(F.col("_y") / F.col("_t") - 1).alias("train_anomalies"), F.count(F.lit(1)).alias("train_years"))
    return out.join(clim, [*keys, "fold"]).select(
        *keys, F.col("fold").alias(year), "feature_set", "train_years", "point", "trend", "actual",
        F.col("_l.signed").alias("signed"), F.col("_l.loo_point").alias("loo_point"), "train_anomalies",
    ).filter("feature_set <> 'trend_only'")


def order_stat(values: Column, rank: Column) -> Column:
    return F.get(F.sort_array(values), rank.cast("int") - 1)


def upper(values: Column, level: float) -> Column:
    """ceil(level*(n+1))-th smallest, +infinity when the level needs more values."""
    k = F.ceil(F.lit(level) * (F.size(values) + 1))
    return F.when(k > F.size(values), float("inf")).otherwise(order_stat(values, k))


def lower(values: Column, level: float) -> Column:
    """floor((1-level)*(n+1))-th smallest, -infinity when unsupported."""
    k = F.floor(F.lit(1.0 - level) * (F.size(values) + 1))
    return F.when(k < 1, float("-inf")).otherwise(order_stat(values, k))


def _sd(a: Column) -> Column:
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    return F.when(n > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - 1)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def intervals(resid: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Jackknife+, jackknife and Gaussian interval per fold and level."""
    r = resid.withColumn("_abs", F.transform("signed", lambda v: F.abs(v))).withColumn("_sd", _sd(F.col("signed")))
    r = r.withColumn("_lo", F.zip_with("loo_point", "_abs", lambda p, a: p - a)).withColumn("_hi", F.zip_with("loo_point", "_abs", lambda p, a: p + a))
    cells = []
    for lv in levels:
        half, z = upper(F.col("_abs"), lv), NormalDist().inv_cdf(0.5 + lv / 2)
        for name, lo, hi in (
            ("jackknife_plus", lower(F.col("_lo"), lv), upper(F.col("_hi"), lv)),
            ("jackknife", F.col("point") - half, F.col("point") + half),
            ("gaussian", F.col("point") - z * F.col("_sd"), F.col("point") + z * F.col("_sd")),
        ):
            cells.append(F.struct(F.lit(name).alias("method"), F.lit(lv).alias("nominal_level"), lo.alias("lower"), hi.alias("upper")))
    error = F.abs(F.col("actual") - F.col("point"))
    hits = F.size(F.filter("_abs", lambda v: v <= error))
    r = r.withColumn("pit", F.least(F.lit(1.0), (hits + 1) / (F.size("_abs") + 1)))
    out = r.select(*keys, "actual", "trend", F.col("point").alias("predicted"), "pit", F.inline(F.array(*cells)))
    finite = (F.abs("lower") != float("inf")) & (F.abs("upper") != float("inf"))
    return out.withColumn("finite", finite).withColumn("covered", F.col("actual").between(F.col("lower"), F.col("upper"))).withColumn(
        "width", F.when(finite, F.col("upper") - F.col("lower"))
    )


def coverage(iv: DataFrame, keys: Sequence[str]) -> DataFrame:
    return iv.groupBy(*keys, "method", "nominal_level").agg(
        F.count(F.lit(1)).alias("harvests"), F.sum(F.col("finite").cast("long")).alias("finite_intervals"),
        F.sum(F.col("covered").cast("long")).alias("covered"), F.avg(F.col("covered").cast("double")).alias("observed_coverage"),
        F.avg("width").alias("mean_width"), F.percentile("width", F.lit(0.5)).alias("median_width"),
    )


def calibration(iv: DataFrame, keys: Sequence[str], year: str, grid: Sequence[float]) -> DataFrame:
    """Share of harvests whose conformal rank falls at or below each nominal level."""
    once = iv.groupBy(*keys, year).agg(F.max("pit").alias("pit"))
    g = once.withColumn("nominal_level", F.explode(F.array(*[F.lit(v) for v in grid])))
    return g.groupBy(*keys, "nominal_level").agg(
        F.count(F.lit(1)).alias("harvests"), F.avg((F.col("pit") <= F.col("nominal_level")).cast("double")).alias("observed")
    )


# The compared provisioning strategies.
STRATEGIES = ("no_buffer", "climatology", "climatology_scaled", "model", "model_point_only")


def shortfall_samples(resid: DataFrame) -> DataFrame:
    """Predictive shortfalls below trend per strategy, as arrays of at most one value per training year."""
    mean = _mean(F.col("train_anomalies"))
    r = resid.withColumn("_mean", mean).withColumn("_dev", F.transform("train_anomalies", lambda a: F.col("trend") * (a - F.col("_mean"))))
    r = r.withColumn("_spread", _sd(F.col("_dev"))).withColumn("_resid", _sd(F.col("signed")))
    r = r.withColumn("_scale", F.when(F.col("_spread") > 1e-12, F.col("_resid") / F.col("_spread")).otherwise(1.0))

    def below(arr, value) -> Column:
        return F.transform(arr, lambda v: F.greatest(F.col("trend") - value(v), F.lit(0.0)))

    return r.withColumns({
        "s_climatology": below("train_anomalies", lambda v: F.col("trend") * (1 + v)),
        "s_climatology_scaled": below("_dev", lambda v: F.col("trend") + v * F.col("_scale")),
        "s_model": below("signed", lambda v: F.col("point") + v),
        "s_model_point_only": below("_dev", lambda v: F.col("point") + v),
    })


def decide(resid: DataFrame, keys: Sequence[str], ratios: Sequence[float]) -> DataFrame:
    """Newsvendor buffer (the ceil(q*n)-th shortfall) and its realised cost per strategy and penalty ratio."""
    s = shortfall_samples(resid).withColumn("shortfall", F.greatest(F.col("trend") - F.col("actual"), F.lit(0.0)))
    cells = []
    for ratio in ratios:
        q = ratio / (ratio + 1.0)
        for name in STRATEGIES:
            if name == "no_buffer":
                buffer = F.lit(0.0)
            else:
                arr = F.col(f"s_{name}")
                k = F.least(F.size(arr), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(arr)).cast("int")))
                buffer = order_stat(arr, k)
            cells.append(F.struct(F.lit(float(ratio)).alias("ratio"), F.lit(name).alias("strategy"), buffer.alias("buffer")))
    d = s.select(*keys, "shortfall", F.inline(F.array(*cells)))
    short, unused = F.greatest(F.col("shortfall") - F.col("buffer"), F.lit(0.0)), F.greatest(F.col("buffer") - F.col("shortfall"), F.lit(0.0))
    return d.withColumn("short", short).withColumn("unused", unused).withColumn("cost", F.col("ratio") * F.col("short") + F.col("unused"))


def score_decisions(dec: DataFrame, keys: Sequence[str], baseline: str = "climatology", level: float = 0.8) -> DataFrame:
    """Total, mean and tail cost per strategy, against the no-weather baseline."""
    keys = list(keys)
    n = F.count(F.lit(1))
    d = dec.withColumn("_n", n.over(W.partitionBy(*keys, "ratio", "strategy")))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "ratio", "strategy").orderBy(F.desc("cost"))))
    tail = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(1 - level), 0).cast("int"))
    g = d.groupBy(*keys, "ratio", "strategy").agg(
        n.alias("harvests"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"),
        F.avg(F.when(F.col("_r") <= tail, F.col("cost"))).alias("cvar_cost"), F.max("cost").alias("worst_cost"),
        F.avg("buffer").alias("mean_buffer"), F.sum((F.col("short") > 1e-12).cast("long")).alias("years_short"),
    )
    ref = F.max(F.when(F.col("strategy") == baseline, F.col("total_cost"))).over(W.partitionBy(*keys, "ratio"))
    g = g.withColumn("_ref", ref)
    return g.withColumn("cost_reduction", F.when(F.col("_ref") > 1e-12, 1 - F.col("total_cost") / F.col("_ref"))).drop("_ref")


def spread_diagnostic(resid: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = shortfall_samples(resid)
    return s.select(
        *keys, F.col("_resid").alias("model_sd"), F.col("_spread").alias("climatology_sd"), F.when(F.col("_spread") > 1e-12, F.col("_resid") / F.col("_spread")).alias("ratio")
    )


def regime_strata(dec: DataFrame, keys: Sequence[str], baseline: str = "climatology") -> DataFrame:
    """Cost per strategy where the harvest fell short and where it did not."""
    d = dec.withColumn("regime", F.when(F.col("shortfall") > 1e-12, "shortfall").otherwise("at_or_above_trend"))
    g = d.groupBy(*keys, "ratio", "regime", "strategy").agg(
        F.count(F.lit(1)).alias("harvests"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost")
    )
    ref = F.max(F.when(F.col("strategy") == baseline, F.col("total_cost"))).over(W.partitionBy(*keys, "ratio", "regime"))
    return g.withColumn("saving", ref - F.col("total_cost"))
