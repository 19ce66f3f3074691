"""Point-in-time operators: what was knowable when.

Windows here never run over raw rows of one key. The as-of join first folds each side to
one row per (key, instant) with map-side partial aggregation, and then works per
(key, time bucket), with one carried row per bucket; a key that holds a third of all rows
is spread over its buckets like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import col

from .common import spread_join


# ------------------------------------------------------------------ filters


def as_of(df: DataFrame, pub: str, horizon: Column | str) -> DataFrame:
    """Rows published at or before a horizon; a missing publication date is never visible."""
    return df.filter(F.col(pub).isNotNull() & (F.col(pub) <= (F.lit(horizon) if isinstance(horizon, str) else horizon)))


def from_first_coverage(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str]) -> DataFrame:
    """Drop rows before the first date on which any column of the family is filled."""
    filled = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    start = df.filter(filled).groupBy(*keys).agg(F.min(date).alias("_start"))
    return spread_join(df, start, keys).filter(F.col(date) >= F.col("_start")).drop("_start")


def completed_rows(rows: DataFrame, end: str, decisions: DataFrame, decision: str, keys: Sequence[str]) -> DataFrame:
    """Per decision, how much training history had a finished outcome (target end < decision).

    The inequality is answered by counting outcomes per end date and accumulating,
    not by pairing every decision with every earlier row.
    """
    keys = list(keys)
    ends = rows.filter(F.col(end).isNotNull()).groupBy(*keys, F.col(end).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    asks = decisions.select(*keys, F.col(decision).alias("_t")).distinct()
    w = W.partitionBy(*keys).orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    both = ends.withColumn("_ask", F.lit(1)).unionByName(
        asks.withColumn("_n", F.lit(0).cast("long")).withColumn("_ask", F.lit(0))
    )
    done = both.withColumn("train_rows", F.sum("_n").over(w)).filter("_ask = 0")
    return done.select(*keys, F.col("_t").alias(decision), "train_rows")


# ------------------------------------------------------------------ publication dates


def publish_lag(date: str | Column, days: int) -> Column:
    return F.date_add(col(date), days)


def publish_weekly(date: str | Column, dow: int, lag: int) -> Column:
    """Release date of a weekly map; NULL (an error row) when the map is on the wrong weekday.

    `dow` follows Spark's dayofweek: Sunday = 1, Tuesday = 3.
    """
    return F.when(F.dayofweek(col(date)) == dow, F.date_add(col(date), lag))


def month_available(date: str | Column, day: int = 7) -> Column:
    """A month is final on the given day of the next month."""
    return F.date_add(F.to_date(F.add_months(F.trunc(col(date), "month"), 1)), day - 1)


def expected_status(date: str | Column, asked: str | Column, day: int = 7) -> Column:
    return F.when(col(asked) >= month_available(date, day), "scaled").otherwise("prelim")


def monotone_pub(keys: Sequence[str], order: str, pub: str) -> Column:
    """Running maximum of publication along a per-(key, date) timeline."""
    return F.max(pub).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


# ------------------------------------------------------------------ as-of join


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    cutoff: str,
    pub: str,
    payload: Sequence[str],
    tiebreak: Sequence[str] = (),
    *,
    strict: bool = False,
    direction: str = "backward",
    peek_days: int = 0,
    bucket: str = "quarter",
    grid: bool = False,
) -> DataFrame:
    """Last (or, forward, first) right row at or before (after) each left cutoff, per key.

    Right rows without a publication date are dropped. Equal publication instants are
    settled by `tiebreak` (last wins backward, first wins forward). `strict` refuses an
    equal instant; `peek_days` shifts the cutoff forward as a control experiment.

    `grid` says that both sides are calendars: at most a few rows per (key, day). One window per
    key then answers everything in a single shuffle, and its size is bounded by the calendar.
    Otherwise distinct cutoffs are answered per (key, time bucket), with one carried row per
    bucket, and the raw rows join the answers, so any number of rows may share a key.
    """
    if peek_days < 0:
        raise ValueError("peek_days must be >= 0")
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    keys, payload = list(keys), list(payload)
    back = direction == "backward"
    ask = F.date_add(F.col(cutoff), peek_days) if peek_days else F.col(cutoff)
    tie = F.struct(*[F.col(c) for c in (tiebreak or payload)])
    pick = F.max_by if back else F.min_by
    hits = (
        right.filter(F.col(pub).isNotNull())
        .groupBy(*keys, F.col(pub).alias("_t"))
        .agg(pick(F.struct(*payload), tie).alias("_hit"))
        .withColumn("_ask", F.lit(False))
    )
    rest = [c for c in left.columns if c not in keys]
    if grid:
        asks = left.select(*keys, ask.alias("_t"), F.struct(*rest).alias("_row"))
        hits = hits.withColumn("_row", F.lit(None).cast(asks.schema["_row"].dataType))
    else:
        asks = left.filter(F.col(cutoff).isNotNull()).select(*keys, ask.alias("_t")).distinct()
    asks = asks.withColumn("_hit", F.lit(None).cast(hits.schema["_hit"].dataType)).withColumn("_ask", F.lit(True))
    both = hits.unionByName(asks)
    # At equal instants an inclusive join must meet the right row before the question.
    side = F.col("_ask") if not strict else ~F.col("_ask")
    order = (F.col("_t").asc(), side.asc()) if back else (F.col("_t").desc(), side.asc())

    def latest(*part: str) -> Column:
        return F.last("_hit", ignorenulls=True).over(W.partitionBy(*keys, *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))

    if grid:
        got = F.when(F.col("_t").isNotNull(), F.col("_in")).alias("_got")
        out = both.withColumn("_in", latest()).filter("_ask").select(*keys, F.col("_row.*"), got)
    else:
        # The window and the carried rows below read the same partitioning.
        both = both.withColumn("_b", F.date_trunc(bucket, F.col("_t"))).repartition(*keys, "_b")
        only = F.when(~F.col("_ask"), F.col("_t"))
        edge = F.max_by("_hit", only) if back else F.min_by("_hit", only)
        step = F.col("_b").asc() if back else F.col("_b").desc()
        across = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
        carried = (
            both.groupBy(*keys, "_b").agg(edge.alias("_edge"))
            .withColumn("_carry", F.last("_edge", ignorenulls=True).over(across)).drop("_edge")
        )
        found = both.withColumn("_in", latest("_b")).filter("_ask").join(carried, [*keys, "_b"])
        answers = found.select(*keys, F.col("_t").alias("_at"), F.coalesce("_in", "_carry").alias("_got"))
        out = left.withColumn("_at", ask).join(answers, [*keys, "_at"], "left")
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in payload])


# ------------------------------------------------------------------ sessions


def snap_forward(dates: DataFrame, sessions: DataFrame, keys: Sequence[str], date: str, session: str, grid: bool = False) -> DataFrame:
    """First session on or after each date; NULL past the end of the calendar."""
    cal = sessions.select(*keys, F.col(session).alias("_pub"), F.col(session).alias("session_date")).distinct()
    return asof_join(dates, cal, keys, date, "_pub", ["session_date"], direction="forward", bucket="year", grid=grid)


def session_index(sessions: DataFrame, keys: Sequence[str], session: str) -> DataFrame:
    """Trading calendar per key with positions; one row per session, so bounded by the calendar."""
    cal = sessions.select(*keys, F.col(session)).distinct()
    return cal.withColumn("idx", F.row_number().over(W.partitionBy(*keys).orderBy(session)))


def entry_exit(
    decisions: DataFrame, sessions: DataFrame, keys: Sequence[str], date: str, session: str, hold: int, grid: bool = False
) -> DataFrame:
    """Next session strictly after a decision and the `hold`-th session after that."""
    keys = list(keys)
    cal = session_index(sessions, keys, session)
    nxt = W.partitionBy(*keys).orderBy("idx")
    plan = cal.select(
        *keys, F.col(session).alias("_pub"), F.col(session).alias("entry_date"),
        F.lead(session, hold).over(nxt).alias("exit_date"),
    )
    return asof_join(
        decisions, plan, keys, date, "_pub", ["entry_date", "exit_date"], strict=True, direction="forward", bucket="year", grid=grid,
    )


def lag_sessions(cols: Sequence[str], keys: Sequence[str], order: str, n: int = 1) -> list[Column]:
    """Delay inputs without a release time by n sessions."""
    w = W.partitionBy(*keys).orderBy(order)
    return [F.lag(c, n).over(w).alias(c) for c in cols]


def last_before_entry(df: DataFrame, keys: Sequence[str], entry: str, avail: str, payload: Sequence[str]) -> DataFrame:
    """Several runs mapping to one open keep the last available one (no window needed)."""
    s = F.struct(*[F.col(c) for c in (avail, *payload)])
    return (
        df.groupBy(*keys, entry).agg(F.max_by(s, F.struct(avail, *payload)).alias("_s"))
        .select(*keys, entry, "_s.*")
    )


def latest_decision(
    df: DataFrame, keys: Sequence[str], date: str, signal: str, as_of_date: Column, max_age: int
) -> DataFrame:
    """Newest decision at a date; a stale one becomes HOLD. Of several on one date the smallest signal counts."""
    from tidemark.functions.scalar import action

    seen = df.filter(F.col(date) <= as_of_date)
    out = seen.groupBy(*keys).agg(
        F.max_by(F.col(signal), F.struct(F.col(date), -F.col(signal))).alias("signal"), F.max(date).alias("decision_date")
    )
    age = F.datediff(as_of_date, F.col("decision_date"))
    return out.select(
        *keys, "decision_date", "signal", age.alias("age_days"), (age > max_age).alias("stale"),
        F.when(age > max_age, "HOLD").otherwise(action("signal")).alias("action"),
    )


# ------------------------------------------------------------------ issue tables and catalogues


def issue_table(
    obs: DataFrame, issues: DataFrame, keys: Sequence[str], date: str, pub: str, value: str
) -> DataFrame:
    """Features frozen at issue dates.

    `issues` has (year, issue_date, start, end): few rows per year. Each issue is spread over the days
    of its window, which may begin before New Year, so observations meet it by an equi-join on the
    day and a long history has as many join keys as days. Only rows observed inside the window and
    published by the issue date count; a window with a missing day gives NULL.
    """
    keys = list(keys)
    days = issues.select("year", "issue_date", "start", "end", F.explode(F.sequence("start", "end")).alias(date))
    # The audit counts all rows of the window, the feature only the published ones.
    j = obs.drop("year", "issue_date", "start", "end").join(days, date)
    seen = F.col(pub).isNotNull() & (F.col(pub) <= F.col("issue_date"))
    out = j.groupBy(*keys, "year", "issue_date").agg(
        F.max(F.datediff("end", "start") + 1).alias("expected_days"),
        F.count_distinct(F.when(seen, F.col(date))).alias("seen_days"),
        F.avg(F.when(seen, F.col(value))).alias("_v"),
        F.max(F.when(seen, F.col(pub))).alias("last_publication"),
        F.sum(F.when(~seen, 1).otherwise(0)).alias("late_rows"),
    )
    return out.withColumn("feature", F.when(F.col("seen_days") == F.col("expected_days"), F.col("_v"))).drop("_v")


def feature_catalog(panel: DataFrame, sources: dict[str, str], tradeable: Sequence[str]) -> DataFrame:
    """One row per feature: its source, fill counts and whether it can be traded on.

    A feature nothing fills is reported as unavailable, never left out.
    """
    n = len(sources)
    counts = panel.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in sources]
    )
    stack = ", ".join(f"'{c}', '{s}', {str(s in tradeable).lower()}, `{c}`" for c, s in sources.items())
    return counts.select(
        "_rows", F.expr(f"stack({n}, {stack}) as (feature, source, tradeable, filled)")
    ).select(
        "feature", "source", "tradeable", "filled", (F.col("_rows") - F.col("filled")).alias("unfilled"),
        (F.col("filled") == 0).alias("unavailable"),
    )
