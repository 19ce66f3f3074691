"""Completeness-checked aggregations.

All of these are grouped aggregates with map-side partial results, so a group holding a
third of the rows costs one partial row per map task, not one overloaded reducer. Distinct
members are counted by first folding to one row per (group, member).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import div, null_if

from .common import spread_join

# ------------------------------------------------------------------ belts


def belt_mean(df: DataFrame, keys: Sequence[str], date: str, measures: Sequence[str], member: str, pub: str) -> DataFrame:
    """Equal-weight mean over members per day, newest publication, member count.

    Input holds one row per (key, date, member), so counting rows counts members.
    """
    return df.groupBy(*keys, date).agg(
        *[F.avg(m).alias(m) for m in measures], F.max(pub).alias(pub), F.count(member).alias("members")
    )


def nested_mean(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], measures: Sequence[str], pub: str | None = None
) -> DataFrame:
    """Mean within the inner groups, then of those means within the outer groups."""
    extra = [F.max(pub).alias(pub)] if pub else []
    first = df.groupBy(*inner).agg(*[F.avg(m).alias(m) for m in measures], *extra)
    return first.groupBy(*outer).agg(
        *[F.avg(m).alias(m) for m in measures], *extra, F.count(F.lit(1)).alias("groups")
    )


def strict_belt_mean(
    df: DataFrame, keys: Sequence[str], date: str, measures: Sequence[str], pub: str, expected: DataFrame, n: str
) -> DataFrame:
    """Belt mean only where every expected member has a value and a publication date.

    `expected` has the member count `n` per key; no row at all for an incomplete day.
    """
    full = F.lit(True)
    for c in (*measures, pub):
        full = full & F.col(c).isNotNull()
    days = df.groupBy(*keys, date).agg(
        *[F.avg(m).alias(m) for m in measures], F.max(pub).alias(pub), F.sum(full.cast("int")).alias("_full")
    )
    return days.join(expected, list(keys)).filter(F.col("_full") == F.col(n)).drop("_full", n)


def strict_nested_mean(
    df: DataFrame, belt: str, state: str, member: str, date: str, measure: str, pub: str
) -> DataFrame:
    """Nested mean of dates on which every state is complete, with the latest publication.

    The members seen on a belt's earliest date are its reference. A state is complete on a date when
    as many members as its reference has are there, each with a value and a publication date; a date
    needs all states of the reference. Members added later are left out. One row per (belt, state,
    member, date). The reference is one grouped minimum per member, so raw rows are shuffled by
    member and by (state, date) only.
    """
    known = df.withColumn(measure, null_if(measure))
    since = known.groupBy(belt, state, member).agg(F.min(date).alias("_since"))
    first = since.groupBy(belt).agg(F.min("_since").alias("_first"))
    ref = since.join(first, belt).filter(F.col("_since") == F.col("_first")).select(belt, state, member)
    per_state = ref.groupBy(belt, state).agg(F.count(F.lit(1)).alias("_ref"))
    states = per_state.groupBy(belt).agg(F.count(F.lit(1)).alias("_states"))
    days = known.join(ref, [belt, state, member], "left_semi").groupBy(belt, state, date).agg(
        F.avg(measure).alias(measure), F.count(F.lit(1)).alias("_n"), F.count(measure).alias("_v"), F.count(pub).alias("_p"), F.max(pub).alias(pub)
    )
    n = F.col("_ref")
    full = days.join(per_state, [belt, state]).filter((F.col("_n") == n) & (F.col("_v") == n) & (F.col("_p") == n))
    out = full.groupBy(belt, date).agg(F.avg(measure).alias(measure), F.max(pub).alias(pub), F.count(F.lit(1)).alias("_full"))
    return out.join(states, belt).filter(F.col("_full") == F.col("_states")).drop("_full", "_states")


def publication_audit(df: DataFrame, keys: Sequence[str], date: str, pub: str, member: str, expected: DataFrame, n: str) -> DataFrame:
    """Per date: rows, rows with a publication, members, and whether all members are there."""
    members = df.groupBy(*keys, date, member).agg(F.count(F.lit(1)).alias("_r"), F.count(pub).alias("_p"))
    days = members.groupBy(*keys, date).agg(
        F.sum("_r").alias("rows"), F.sum("_p").alias("published"), F.count(F.lit(1)).alias("members")
    )
    return days.join(expected, list(keys)).select(
        *keys, date, "rows", "published", "members",
        ((F.col("rows") == F.col("published")) & (F.col("members") == F.col(n))).alias("complete"),
    )


# ------------------------------------------------------------------ shape


def pivot_fixed(df: DataFrame, keys: Sequence[str], c: str, values: Mapping[str, str], measure: str) -> DataFrame:
    """Long to wide with a fixed column list; a value nobody reports is an all-NULL column."""
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(c) == v, F.col(measure))).alias(name) for v, name in values.items()]
    )


def rollup_intervals(
    df: DataFrame, keys: Sequence[str], interval: str, rules: Mapping[str, tuple[str, str]], n: int
) -> DataFrame:
    """Sub-daily rows to days, only where all n intervals exist. rules: out -> (column, max|min|sum)."""
    fn = {"max": F.max, "min": F.min, "sum": F.sum}
    out = df.groupBy(*keys).agg(
        *[fn[how](c).alias(name) for name, (c, how) in rules.items()], F.count_distinct(interval).alias("_n")
    )
    return out.filter(F.col("_n") == n).drop("_n")


def horizon_windows(
    df: DataFrame, keys: Sequence[str], day: str, windows: Sequence[tuple[int, int]], rules: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Lead-day windows to one wide row per run; a run missing any day of any window is dropped."""
    fn = {"avg": F.avg, "sum": F.sum}
    aggs, need = [], F.lit(True)
    for a, b in windows:
        inside = F.col(day).between(a, b)
        for name, (c, how) in rules.items():
            aggs.append(fn[how](F.when(inside, F.col(c))).alias(f"d{a}_{b}_{name}"))
        aggs.append(F.count_distinct(F.when(inside, F.col(day))).alias(f"_n{a}"))
        need = need & (F.col(f"_n{a}") == b - a + 1)
    out = df.groupBy(*keys).agg(*aggs)
    return out.filter(need).drop(*[f"_n{a}" for a, _ in windows])


# ------------------------------------------------------------------ seasons and years


def window_measures(
    df: DataFrame, keys: Sequence[str], date: str, calendar: Sequence[tuple[int, int]], *,
    tmax: str, tmin: str, rain: str, heat: float, frost: float, dry: float = 1.0, wet: float = 20.0, min_days: int = 28,
) -> DataFrame:
    """Measures of one crop-year window per key, only where the window is nearly covered."""
    from tidemark.functions.scalar import crop_year, excess

    from .windows import run_so_far

    rows = df.withColumn("crop_year", crop_year(date, calendar)).filter("crop_year IS NOT NULL")
    # Runs are counted inside one (key, crop year): at most 366 rows per window.
    rows = run_so_far(rows.withColumn("_dry", F.col(rain) < dry), [*keys, "crop_year"], date, "_dry", "_run")
    out = rows.groupBy(*keys, "crop_year").agg(
        F.sum(rain).alias("rain_sum"),
        F.sum((F.col(rain) < dry).cast("int")).alias("dry_days"),
        F.max("_run").alias("max_dry_spell"),
        F.sum((F.col(rain) > wet).cast("int")).alias("wet_days"),
        F.sum((F.col(tmax) > heat).cast("int")).alias("heat_days"),
        F.sum(excess(tmax, heat)).alias("heat_dd"),
        F.avg(tmax).alias("tmax_mean"),
        # No thermometer is not the same as no frost: both stay NULL without tmin.
        F.sum(F.when(F.col(tmin).isNotNull(), (F.col(tmin) < frost).cast("int"))).alias("frost_days"),
        F.min(tmin).alias("min_tmin"),
        F.count(F.lit(1)).alias("days"),
    )
    return out.filter(F.col("days") >= len(calendar) * min_days)


# How each measure combines over the points of one region.
POINT_RULES = {
    "min_tmin": "min", "frost_days": "max", "max_dry_spell": "max", "heat_dd": "avg", "heat_days": "avg", "tmax_mean": "avg",
    "rain_sum": "avg", "dry_days": "avg", "wet_days": "avg", "days": "avg",
}


def combine_points(df: DataFrame, keys: Sequence[str], year: str, rules: Mapping[str, str], expected: DataFrame, n: str) -> DataFrame:
    """Per-point windows to one regional row per year, only if every point covers it."""
    fn = {"min": F.min, "max": F.max, "avg": F.avg}
    out = df.groupBy(*keys, year).agg(
        *[fn[how](c).cast("double").alias(c) for c, how in rules.items()], F.count(F.lit(1)).alias("points")
    )
    return out.join(expected, list(keys)).filter(F.col("points") == F.col(n)).drop(n)


def annual_weather(
    df: DataFrame, keys: Sequence[str], date: str, tmax: str, rain: str, *, heat: float,
    season: Sequence[int], peak: int, summer: Sequence[int],
) -> DataFrame:
    from tidemark.functions.scalar import excess

    m = F.month(date)
    hot = excess(tmax, heat)
    return df.groupBy(*keys, F.year(date).alias("year")).agg(
        F.sum(F.when(m.isin(*season), hot)).alias("heat_season"),
        F.sum(F.when(m == peak, hot)).alias("heat_peak"),
        F.avg(F.when(m == peak, F.col(tmax))).alias("tmax_peak"),
        F.sum(F.when(m.isin(*summer), F.col(rain))).alias("rain_summer"),
        F.sum(m.isin(*season).cast("int")).alias("days"),
    )


def annual_peak(df: DataFrame, keys: Sequence[str], date: str, c: str, season: Sequence[int]) -> DataFrame:
    inside = df.filter(F.month(date).isin(*season))
    return inside.groupBy(*keys, F.year(date).alias("year")).agg(
        F.max(c).alias("peak"), F.avg(c).alias("mean"), F.count(F.lit(1)).alias("maps")
    )


def annual_table(weather: DataFrame, drought: DataFrame, yields: DataFrame, on: Sequence[str], min_days: int, min_maps: int) -> DataFrame:
    """Weather, drought and yield per year, only for nearly complete years."""
    return (
        weather.filter(F.col("days") >= min_days).join(drought.filter(F.col("maps") >= min_maps), list(on)).join(yields, list(on))
    )


# ------------------------------------------------------------------ ratios and weights


def ratio_of_sums(df: DataFrame, keys: Sequence[str], num: str, rate: str, member: str, n: int) -> DataFrame:
    """Bloc rate = total / total of (total / rate), only with all members present."""
    out = df.groupBy(*keys).agg(
        F.sum(num).alias("_p"), F.sum(div(num, rate)).alias("_a"), F.count_distinct(member).alias("members")
    )
    return out.filter(F.col("members") == n).withColumn("rate", div("_p", "_a")).drop("_p", "_a")


def weighted_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str], w: str) -> DataFrame:
    """Share-weighted means; weights count only where the measure is present."""
    return df.groupBy(*keys).agg(
        *[
            div(F.sum(F.col(m) * F.col(w)), F.sum(F.when(F.col(m).isNotNull(), F.col(w)))).alias(m)
            for m in measures
        ]
    )


def share_of_total(df: DataFrame, keys: Sequence[str], c: str, out: str) -> DataFrame:
    """Value over its group's total: one total per group, joined back with hot groups spread."""
    total = df.groupBy(*keys).agg(F.sum(c).alias("_t"))
    return spread_join(df, total, keys).withColumn(out, div(c, "_t")).drop("_t")


def balanced_daily(
    df: DataFrame, keys: Sequence[str], country: str, date: str, tmax: str, rain: str, pub: str, *, dry: float, wet: float, heat: float
) -> DataFrame:
    """Countries first, then the region: shares of countries dry or wet, mean heat excess."""
    from tidemark.functions.scalar import excess

    c = df.groupBy(*keys, country, date).agg(
        F.round(F.avg(tmax), 9).alias("_t"), F.round(F.avg(rain), 9).alias("_r"), F.max(pub).alias("_p")
    )
    return c.groupBy(*keys, date).agg(
        F.avg("_t").alias("tmax"), F.avg("_r").alias("rain"),
        F.avg((F.col("_r") < dry).cast("double")).alias("dry_share"),
        F.avg((F.col("_r") > wet).cast("double")).alias("wet_share"),
        F.avg(excess("_t", heat)).alias("heat_excess"),
        F.max("_p").alias("pub"), F.count(F.lit(1)).alias("countries"),
    )


def worst_point_daily(df: DataFrame, keys: Sequence[str], date: str, tmin: str, tmax: str, rain: str, pub: str) -> DataFrame:
    """Coldest point for frost, mean for the rest."""
    return df.groupBy(*keys, date).agg(
        F.min(tmin).alias("tmin"), F.avg(tmax).alias("tmax"), F.avg(rain).alias("rain"), F.max(pub).alias("pub"),
        F.count(F.lit(1)).alias("points"),
    )


# ------------------------------------------------------------------ releases


def single_value(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One value per column and release; a release with several is marked as an error."""
    out = df.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in cols],
        # min = max says "one value" without collecting the distinct set.
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"_ok_{c}") for c in cols],
    )
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(f"_ok_{c}")
    return out.withColumn("consistent", ok).drop(*[f"_ok_{c}" for c in cols])


def release_features(df: DataFrame, keys: Sequence[str], comparison: str, category: str, value: str,
                     good: Sequence[str], poor: Sequence[str], against: Mapping[str, str], now: str) -> DataFrame:
    """Bucket sums per comparison and their change: good, poor, balance now and versus each reference."""
    def bucket(cmp: str, cats: Sequence[str]) -> Column:
        return F.sum(F.when((F.col(comparison) == cmp) & F.col(category).isin(*cats), F.col(value)))

    names = {"now": now, **against}
    wide = df.groupBy(*keys).agg(
        *[bucket(v, good).alias(f"_g_{k}") for k, v in names.items()],
        *[bucket(v, poor).alias(f"_p_{k}") for k, v in names.items()],
    )
    out = [F.col("_g_now").alias("good"), F.col("_p_now").alias("poor"), (F.col("_g_now") - F.col("_p_now")).alias("balance")]
    for k in against:
        out.append((F.col("_g_now") - F.col(f"_g_{k}")).alias(f"good_vs_{k}"))
        out.append((F.col("_p_now") - F.col(f"_p_{k}")).alias(f"poor_vs_{k}"))
    return wide.select(*keys, *out)


# ------------------------------------------------------------------ profiles


def rate_summary(df: DataFrame, keys: Sequence[str], date: str, rate: str) -> DataFrame:
    """Dates, distinct rates, min / median / max per group."""
    # One row per (group, rate) carries the counts, so the median works on folded rows.
    folded = df.groupBy(*keys, rate).agg(F.count(F.lit(1)).alias("_f"))
    dates = df.groupBy(*keys, date).agg(F.lit(1).alias("_1")).groupBy(*keys).agg(F.count(F.lit(1)).alias("dates"))
    out = folded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rates"), F.min(rate).alias("min_rate"),
        F.percentile(rate, F.lit(0.5), F.col("_f")).alias("median_rate"), F.max(rate).alias("max_rate"),
    )
    return out.join(dates, list(keys))


def resample_month(df: DataFrame, keys: Sequence[str], date: str, total: str, level: str) -> DataFrame:
    return df.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(
        F.sum(total).alias(total), F.max_by(level, date).alias(level)
    )


def panel_profile(df: DataFrame, keys: Sequence[str], date: str, contract: str) -> DataFrame:
    """Rows, span, years and the delivery letters seen per root."""
    letter = F.substring(contract, 2, 1)
    # Fold to one row per (root, year, letter) first: the code list is at most twelve letters.
    f = df.groupBy(*keys, F.year(date).alias("_y"), letter.alias("_l")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(date).alias("_a"), F.max(date).alias("_b")
    )
    return f.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.min("_a").alias("first"), F.max("_b").alias("last"),
        F.count_distinct("_y").alias("years"), F.array_join(F.sort_array(F.collect_set("_l")), "").alias("codes"),
    )


def index_to_base(df: DataFrame, keys: Sequence[str], date: str, c: str, base: tuple[int, int]) -> DataFrame:
    """Yearly mean as a multiple of the mean over a base period."""
    y = df.groupBy(*keys, F.year(date).alias("year")).agg(F.sum(c).alias("_s"), F.count(c).alias("_n"))
    inside = F.col("year").between(*base)
    w = W.partitionBy(*keys)
    ref = div(F.sum(F.when(inside, F.col("_s"))).over(w), F.sum(F.when(inside, F.col("_n"))).over(w))
    return y.withColumn("_ref", ref).select(*keys, "year", div(div("_s", "_n"), "_ref").alias("index"))
