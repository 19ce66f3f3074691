"""Strategy metrics, rule baselines, headline choice, gates and strata."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import div

from .topk import no_overlap, pick_best
from .windows import drawdown


def net_of(signal: str, gross: str, cost: str, multiplier: float = 1.0) -> Column:
    return F.col(signal) * F.col(gross) - F.abs(F.col(signal)) * F.lit(multiplier) * F.col(cost)


def strategy_metrics(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, fold: str = "fold", year: str = "year", net: str = "net", gross: str = "gross",
    signal: str = "signal", cost: str = "cost", per_year: float = 52.0, sharpe_rows: str = "all", ex_year: int | None = None,
) -> DataFrame:
    """One row per ledger: trades, coverage, hit rate, net, Sharpe, drawdown, positive folds and years.

    `sharpe_rows` picks the Sharpe denominator: all rows, or traded rows only. A ledger has one
    row per decision day, so the equity window is bounded by the calendar.
    """
    keys = list(keys)
    if sharpe_rows not in ("all", "traded"):
        raise ValueError(sharpe_rows)
    traded = F.col(signal) != 0
    base = F.col(net) if sharpe_rows == "all" else F.when(traded, F.col(net))
    eq = drawdown(df, keys, order, net)
    main = eq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.sum(traded.cast("long")).alias("trades"), F.avg(traded.cast("double")).alias("coverage"),
        F.avg(F.when(traded, (F.col(signal) * F.col(gross) > 0).cast("double"))).alias("hit_rate"),
        F.avg(F.when(traded, F.col(net))).alias("mean_net_per_trade"), F.sum(net).alias("total_net"),
        (F.lit(math.sqrt(per_year)) * div(F.avg(base), F.stddev_samp(base))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.sum(net_of(signal, gross, cost, 2.0)).alias("double_cost_net"),
        *([F.sum(F.when(F.col(year) != ex_year, F.col(net)).otherwise(0.0)).alias("net_ex_year")] if ex_year is not None else []),
    )

    def positive(by: str, name: str) -> DataFrame:
        g = df.groupBy(*keys, by).agg(F.sum(net).alias("_s"))
        return g.groupBy(*keys).agg(F.sum((F.col("_s") > 0).cast("long")).alias(f"positive_{name}"), F.count(F.lit(1)).alias(name))

    return main.join(positive(fold, "folds"), keys).join(positive(year, "years"), keys)


def prediction_r2(df: DataFrame, keys: Sequence[str], actual: str, score: str, baseline: str) -> DataFrame:
    e, b = F.col(actual) - F.col(score), F.col(actual) - F.col(baseline)
    return df.groupBy(*keys).agg((1 - div(F.sum(e * e), F.sum(b * b))).alias("r2"))


# The deterministic baseline rules.
RULES = ("no_trade", "long_only", "short_only", "momentum", "mean_reversion", "trailing_mean", "seasonal_mean")


def rule_signals(
    folds: DataFrame, keys: Sequence[str], fold: str, date: str, gross: str, cost: str, momentum: str, rules: Sequence[str] = RULES
) -> DataFrame:
    """Deterministic rules on the test rows of every fold, learned statistics from its training rows only.

    The training statistics are one row per fold (and month), so the test rows are read once
    and each is copied per rule.
    """
    keys = [*keys, fold]
    train, test = folds.filter("role = 'train'"), folds.filter("role = 'test'")
    mean = train.groupBy(*keys).agg(F.avg(gross).alias("_mean"), F.percentile(cost, F.lit(0.5)).alias("_cost"))
    month = train.groupBy(*keys, F.month(date).alias("_m")).agg(F.avg(gross).alias("_season"))
    t = test.withColumn("_m", F.month(date)).join(mean, keys).join(month, [*keys, "_m"], "left")

    def beyond(v: Column) -> Column:
        return F.when(v > F.col("_cost"), 1).when(v < -F.col("_cost"), -1).otherwise(0)

    sign = F.signum(F.coalesce(F.col(momentum), F.lit(0.0))).cast("int")
    all_rules = {
        "no_trade": F.lit(0), "long_only": F.lit(1), "short_only": F.lit(-1), "momentum": sign, "mean_reversion": -sign,
        "trailing_mean": beyond(F.col("_mean")), "seasonal_mean": beyond(F.coalesce("_season", "_mean")),
    }
    unknown = set(rules) - set(all_rules)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), all_rules[r].cast("int").alias("raw_signal")) for r in rules])
    return t.select("*", F.inline(cells)).drop("_m", "_mean", "_cost", "_season")


def rule_ledger(signals: DataFrame, keys: Sequence[str], entry: str, exit: str, gross: str, cost: str) -> DataFrame:
    run = no_overlap(signals, [*keys, "rule"], entry, exit, "raw_signal", "signal")
    return run.withColumn("net", net_of("signal", gross, cost))


def headline(ledger: DataFrame, keys: Sequence[str], candidate: str, order: Sequence[str], years: Sequence[int], **kw) -> DataFrame:
    """Best candidate by Sharpe, then net, judged on the selection years only."""
    m = strategy_metrics(ledger.filter(F.col(kw.get("year", "year")).isin(*years)), [*keys, candidate], order, **kw)
    return pick_best(m, keys, [candidate], "sharpe", "total_net")


def best_rule(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pick_best(metrics, keys, ["rule"], "sharpe", "total_net")


def placebo_checks(headline_m: DataFrame, others: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Whether the headline's net beats each matched comparison (shifted placebos, market only)."""
    out = headline_m.select(*keys, F.col("total_net").alias("headline_net"))
    for name, m in others.items():
        out = out.join(m.select(*keys, F.col("total_net").alias(f"{name}_net")), list(keys), "left")
        out = out.withColumn(f"beats_{name}", F.col("headline_net") > F.col(f"{name}_net"))
    return out


def gate(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Named checks to a verdict and the list of failures; a check that cannot be decided fails."""
    fails = F.filter(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull()
    )
    return df.select(*keys, (F.size(fails) == 0).alias("passed"), F.size(fails).alias("n_failed"), F.array_join(fails, "; ").alias("failures"))


def strata(df: DataFrame, keys: Sequence[str], dims: Mapping[str, Column], *, net: str = "net", gross: str = "gross", signal: str = "signal") -> DataFrame:
    """Observations, trades, hit rate and net per bucket of every dimension."""
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("bucket")) for n, c in dims.items()])
    long = df.select(*keys, net, gross, signal, F.inline(cells)).filter("bucket IS NOT NULL")
    traded = F.col(signal) != 0
    return long.groupBy(*keys, "dimension", "bucket").agg(
        F.count(F.lit(1)).alias("observations"), F.sum(traded.cast("long")).alias("trades"),
        F.avg(F.when(traded, (F.col(signal) * F.col(gross) > 0).cast("double"))).alias("hit_rate"),
        F.sum(net).alias("total_net"), F.avg(F.when(traded, F.col(net))).alias("mean_net_per_trade"),
    )


def cost_stress(df: DataFrame, keys: Sequence[str], multipliers: Sequence[float]) -> DataFrame:
    """Frozen actions repriced at several cost multiples."""
    cells = [F.sum(net_of("signal", "gross", "cost", m)).alias(f"net_x{m:g}") for m in multipliers]
    return df.groupBy(*keys).agg(*cells)
