"""Event studies: candidates, spacing, windows around events, and null distributions.

Series are at (key, date) grain. Windows around events are long rows (event, offset, value);
null distributions draw from per-day window sums computed once, so a draw touches one number
per pseudo-event instead of a whole window.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by, in_turn
from .pit import snap_forward

# ------------------------------------------------------------------ selection


def event_candidates(df: DataFrame, keys: Sequence[str], c: str, q: float) -> DataFrame:
    """Positive jumps at or above the q-quantile of positive jumps, per key."""
    up = df.filter(F.col(c) > 0)
    edge = up.groupBy(*keys).agg(F.percentile(c, F.lit(q)).alias("threshold"))
    return up.join(edge, list(keys)).filter(F.col(c) >= F.col("threshold"))


def decluster(df: DataFrame, keys: Sequence[str], date: str, mag: str, spacing: int) -> DataFrame:
    """Largest first, discarding everything within `spacing` days of a kept event.

    Candidates further apart than the spacing cannot discard each other, so the fold runs per
    island of close candidates; one candidate per (key, date).
    """
    keys = list(keys)
    w = by(keys, date)
    near = F.datediff(F.col(date), F.lag(date).over(w)) < spacing
    cut = df.withColumn("_i", F.sum(F.when(near, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.withColumn("_m", -F.col(mag))

    def keep() -> Callable:
        taken: list[int] = []  # days kept so far, in order of time

        def decide(date) -> bool:
            day = date.toordinal()
            at = bisect.bisect(taken, day)
            free = (at == 0 or day - taken[at - 1] >= spacing) and (at == len(taken) or taken[at] - day >= spacing)
            if free:
                taken.insert(at, day)
            return free

        return decide

    return in_turn(cut, [*keys, "_i"], ["_m", date], [date], keep, "_keep", T.BooleanType()).filter("_keep").select(*df.columns)


def episodes(df: DataFrame, keys: Sequence[str], date: str, gap: int, by_col: str, payload: Sequence[str]) -> DataFrame:
    """Chains of rows at most `gap` days apart, each reduced to its lowest row."""
    keys = list(keys)
    w = by(keys, date)
    far = F.datediff(F.col(date), F.lag(date).over(w)) > gap
    run = df.withColumn("episode", F.sum(F.when(far, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = F.struct(date, by_col, *payload)
    return run.groupBy(*keys, "episode").agg(F.min_by(s, F.struct(by_col, date)).alias("_s"), F.count(F.lit(1)).alias("days")).select(
        *keys, "episode", "_s.*", "days"
    )


# ------------------------------------------------------------------ windows


def indexed(series: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return series.withColumn("idx", F.row_number().over(by(keys, date)))


def event_windows(
    events: DataFrame, series: DataFrame, keys: Sequence[str], event_date: str, date: str, value: str, pre: int, post: int
) -> DataFrame:
    """(key, event, offset, value) around the first session on or after each event.

    An event whose window does not fit keeps its rows with NULL values, so it can be counted.
    """
    keys = list(keys)
    s = indexed(series, keys, date)
    snapped = snap_forward(events.select(*keys, event_date).distinct(), series, keys, event_date, date, grid=True)
    at = snapped.join(s.select(*keys, F.col(date).alias("session_date"), F.col("idx").alias("_at")), [*keys, "session_date"], "left")
    length = s.groupBy(*keys).agg(F.max("idx").alias("_len"))
    fits = (F.col("_at") - pre >= 1) & (F.col("_at") + post <= F.col("_len"))
    rows = at.join(length, keys, "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    rows = rows.select(*keys, event_date, "_at", "_fits", F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("offset"))
    values = s.select(*keys, F.col("idx").alias("_j"), F.col(value).alias("value"))
    rows = rows.withColumn("_j", F.when(F.col("_fits"), F.col("_at") + F.col("offset")))
    return rows.join(values, [*keys, "_j"], "left").select(*keys, event_date, "offset", "value")


def window_sum(ev: DataFrame, keys: Sequence[str], event_date: str, a: int, b: int, out: str) -> DataFrame:
    """Sum over offsets [a, b] per event; nothing observed is NULL, not zero."""
    return ev.filter(F.col("offset").between(a, b)).groupBy(*keys, event_date).agg(F.sum("value").alias(out))


def forward_change(events: DataFrame, timeline: DataFrame, keys: Sequence[str], date: str, c: str, k: int) -> DataFrame:
    """How the level moved in the k maps after an event's map; NULL past the end."""
    ahead = timeline.select(*keys, date, (F.lead(c, k).over(by(keys, date)) - F.col(c)).alias("forward_change"))
    return events.join(ahead, [*keys, date], "left")


def day_sums(series: DataFrame, keys: Sequence[str], date: str, value: str, a: int, b: int, pre: int, post: int) -> DataFrame:
    """Window sum around every session that has room for a whole window."""
    w = by(keys, date)
    room = W.partitionBy(*keys)
    s = indexed(series, keys, date)
    frame = w.rowsBetween(a, b)
    total = F.sum(value).over(frame)
    return (
        s.withColumn("_len", F.count(F.lit(1)).over(room)).withColumn("window_sum", total)
        .filter((F.col("idx") - pre >= 1) & (F.col("idx") + post <= F.col("_len"))).drop("_len")
    )


# ------------------------------------------------------------------ nulls


def sample_without(seed: int, what: str, size: int, n: int) -> list[int]:
    """n different places of 0 ... size - 1, each set equally likely: Floyd's method on digests.

    For j from size - n to size - 1 a place up to j is drawn, or j itself if that one is taken. A place
    comes from md5 of (seed, what, j) as text, so any engine repeats it, in n steps whatever the size.
    """
    taken: set[int] = set()
    for j in range(size - n, size):
        t = int(hashlib.md5(f"{seed}:{what}:{j}".encode()).hexdigest()[:8], 16) % (j + 1)
        taken.add(j if t in taken else t)
    return sorted(taken)


def _drawn(packed: DataFrame, keys: Sequence[str], draws: int, seed: int, name: str | None) -> DataFrame:
    """Sum and count of the values of each draw from packed pools (_a: values, _n: how many to draw)."""
    names = [*keys, *([name] if name else [])]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values, n = np.array([np.nan if v is None else v for v in row[-2]], float), int(row[-1])
                mark = f":{row[len(names) - 1]}" if name else ""
                chosen = [values[sample_without(seed, f"{d}{mark}", len(values), n)] for d in range(1, draws + 1)]
                out = pd.DataFrame([row[: len(keys)]] * draws, columns=list(keys))
                out["draw"] = range(1, draws + 1)
                out["total"] = [float(np.nansum(c)) for c in chosen]
                out["n"] = [int((~np.isnan(c)).sum()) for c in chosen]
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema.fields)
    schema = ", ".join(filter(None, [fields, "draw int, total double, n bigint"]))
    return packed.select(*names, "_a", "_n").mapInPandas(run, schema)


def _pools(pool: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    packed = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(item, value))).alias("_a"))
    return packed.select(*keys, F.col("_a").getField(value).cast("array<double>").alias("_a"))


def placebo(pool: DataFrame, sizes: DataFrame, keys: Sequence[str], item: str, value: str, n: str, draws: int, seed: int) -> DataFrame:
    """Mean value of n pseudo-events per draw, picked without replacement from each key's pool.

    The pool has one row per eligible day, so a key's pool is one array bounded by the calendar; a
    draw reads n of its places. A pool smaller than n gives no draws.
    """
    keys = list(keys)
    packed = _pools(pool, keys, item, value).join(sizes.select(*keys, F.col(n).alias("_n")), keys)
    out = _drawn(packed.filter((F.col("_n") > 0) & (F.size("_a") >= F.col("_n"))), keys, draws, seed, None)
    return out.select(*keys, "draw", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "n")


def quantile_of(observed: DataFrame, dist: DataFrame, keys: Sequence[str], obs: str, value: str) -> DataFrame:
    """Share of the distribution at or below the observed value, and the one-sided p."""
    j = dist.join(observed.select(*keys, obs), list(keys))
    out = j.groupBy(*keys, obs).agg(F.avg((F.col(value) <= F.col(obs)).cast("double")).alias("quantile"), F.count(value).alias("draws"))
    return out.withColumn("p_value", F.lit(1.0) - F.col("quantile"))


def matched_pool(days: DataFrame, events: DataFrame, keys: Sequence[str], date: str, exclusion: int) -> DataFrame:
    """Days further than `exclusion` days from every event: event days are spread to their
    neighbourhood and removed by an equi anti-join, never by pairing days with events."""
    around = events.select(
        *keys, F.explode(F.sequence(F.date_sub(F.col(date), exclusion), F.date_add(F.col(date), exclusion))).alias(date)
    ).distinct()
    return days.join(around, [*keys, date], "left_anti")


def matched_null(
    pool: DataFrame, sizes: DataFrame, keys: Sequence[str], stratum: str, item: str, value: str, n: str, draws: int, seed: int
) -> DataFrame:
    """Like `placebo`, drawing each stratum's (year's) own number of days; the mean is over all of them.

    A stratum with fewer pool days than events cannot be matched: the job fails and names it.
    """
    keys = list(keys)
    known = pool.filter(F.col(value).isNotNull())
    packed = sizes.select(*keys, stratum, F.col(n).alias("_n")).join(_pools(known, [*keys, stratum], item, value), [*keys, stratum], "left")
    have = F.coalesce(F.size("_a"), F.lit(0))
    name = F.concat_ws(" ", *[F.col(c).cast("string") for c in (*keys, stratum)])
    few = F.raise_error(F.concat(F.lit("too few days to match the events of "), name)).cast("boolean")
    checked = packed.filter(F.when(F.greatest(have, F.lit(0)) >= F.col("_n"), F.lit(True)).otherwise(few)).filter("_n > 0")
    drawn = _drawn(checked, keys, draws, seed, stratum).groupBy(*keys, "draw").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return drawn.select(*keys, "draw", (F.col("total") / F.col("n")).alias("mean"), "n")


# ------------------------------------------------------------------ reports


def event_report(sums: DataFrame, keys: Sequence[str], cuts: Mapping[str, Column], windows: Sequence[str]) -> DataFrame:
    """n, mean, median and share positive per cut and window. Events are few; each is copied per cut it is in."""
    cut = F.explode(F.filter(F.array(*[F.when(c, name) for name, c in cuts.items()]), lambda x: x.isNotNull()))
    rows = sums.withColumn("cut", cut)
    stack = ", ".join(f"'{w}', `{w}`" for w in windows)
    rows = rows.select(*keys, "cut", F.expr(f"stack({len(windows)}, {stack}) as (window, total)"))
    return rows.groupBy(*keys, "cut", "window").agg(
        F.count(F.lit(1)).alias("events"), F.count("total").alias("n"), F.avg("total").alias("mean"),
        F.percentile("total", F.lit(0.5)).alias("median"), F.avg((F.col("total") > 0).cast("double")).alias("positive"),
    )


def event_outcomes(
    events: DataFrame, outcomes: Mapping[int, DataFrame], keys: Sequence[str], pub: str, date: str, payload: Sequence[str]
) -> DataFrame:
    """First decision on or after each event's publication, one block per horizon."""
    from functools import reduce

    from .pit import asof_join

    parts = []
    for h, o in outcomes.items():
        span = o.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
        inside = events.join(span, list(keys)).filter(F.col(pub).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
        right = o.select(*keys, F.col(date).alias("_on"), date, *payload)
        parts.append(asof_join(inside, right, keys, pub, "_on", [date, *payload], direction="forward", grid=True).withColumn("horizon", F.lit(h)))
    return reduce(DataFrame.unionByName, parts)


def event_metrics(ledger: DataFrame, keys: Sequence[str], net: str) -> DataFrame:
    x = ledger.filter(F.col(net).isNotNull())
    return x.groupBy(*keys).agg(
        F.count(net).alias("events"), F.avg(net).alias("mean_net"), F.percentile(net, F.lit(0.5)).alias("median_net"),
        F.sum((F.col(net) > 0).cast("long")).alias("positive"), F.avg((F.col(net) > 0).cast("double")).alias("positive_share"),
    )
