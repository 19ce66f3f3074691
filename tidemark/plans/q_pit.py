"""Point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pit

from .base import BELT, DAILY, OBS, ORDK, belt, daily, grid, obs, ordk, with_sql
from .registry import query, shared

# Publication is missing where the belt reported no rain at all: the forced NULL of these tests.
TIMELINE = BELT + """, timeline AS (
  SELECT k, d AS map_date, tmax, rain, CASE WHEN rain > 0 THEN pub END AS pub FROM belt)"""


@shared
def timeline(t):
    return belt(t).select(
        "k", F.col("d").alias("map_date"), "tmax", "rain", F.when(F.col("rain") > 0, F.col("pub")).alias("pub")
    )


LAST = """last_pub AS (
  SELECT k, pub, max(map_date) AS map_date, arg_max(tmax, map_date) AS tmax
  FROM timeline WHERE pub IS NOT NULL GROUP BY k, pub)"""


@query(
    "pit1_as_of",
    with_sql(OBS) + """
    SELECT belt, state, count(*) AS n, max(pub) AS newest, sum(tmax) AS tmax
    FROM (SELECT belt, state, tmax, CASE WHEN rain > 0 THEN pub END AS pub FROM obs)
    WHERE pub IS NOT NULL AND pub <= DATE '1998-06-30' GROUP BY belt, state""",
    d="tmax",
)
def _(t):
    rows = obs(t).select("belt", "state", "tmax", F.when(F.col("rain") > 0, F.col("pub")).alias("pub"))
    seen = pit.as_of(rows, "pub", F.lit("1998-06-30").cast("date"))
    return seen.groupBy("belt", "state").agg(
        F.count(F.lit(1)).alias("n"), F.max("pub").alias("newest"), F.sum("tmax").alias("tmax")
    )


def _asof(t, **kw):
    back = kw.get("direction", "backward")
    return pit.asof_join(ordk(t).select("o_orderkey", "k", "d"), timeline(t), ["k"], "d", "pub",
                         ["tmax", "map_date"], ["map_date"], **kw)


def asof_sql(op: str, cutoff: str = "l.d", pick: str = "max") -> str:
    return with_sql(TIMELINE, ORDK, LAST.replace("arg_max", f"arg_{pick}").replace("max(map_date)", f"{pick}(map_date)")) + f"""
    SELECT l.o_orderkey, l.k, l.d, r.tmax, r.map_date
    FROM (SELECT *, {cutoff} AS cut FROM ordk l) l ASOF LEFT JOIN last_pub r ON l.k = r.k AND l.cut {op} r.pub"""


@query("pit2_asof_join", asof_sql(">="), d="tmax")
def _(t):
    return _asof(t)


@query("pit3_asof_strict", asof_sql(">"), d="tmax")
def _(t):
    return _asof(t, strict=True)


@query("pit4_asof_forward", asof_sql("<=", pick="min"), d="tmax")
def _(t):
    return _asof(t, direction="forward")


@query("pit5_peek", asof_sql(">=", "l.d + 3"), d="tmax")
def _(t):
    return _asof(t, peek_days=3)


@query(
    "pit6_publish_lag",
    """SELECT CAST(l_shipdate AS DATE) + 5 AS pub, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(t):
    return t.lineitem.groupBy(pit.publish_lag(F.col("l_shipdate").cast("date"), 5).alias("pub")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "pit7_publish_weekly",
    """SELECT d, CASE WHEN dayofweek(d) = 2 THEN d + 2 END AS pub, dayofweek(d) <> 2 AS rejected, n
    FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    out = days.withColumn("pub", pit.publish_weekly("d", 3, 2))
    return out.select("d", "pub", F.col("pub").isNull().alias("rejected"), "n")


@query(
    "pit8_month_available",
    """SELECT month_start, available, CASE WHEN DATE '1999-03-07' >= available THEN 'scaled' ELSE 'prelim' END AS status, n
    FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
                 CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH + INTERVAL 6 DAY AS DATE) AS available, count(*) AS n
          FROM lineitem GROUP BY 1, 2)""",
)
def _(t):
    m = t.lineitem.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return m.select(
        "month_start", pit.month_available("month_start").alias("available"),
        pit.expected_status("month_start", F.lit("1999-03-07").cast("date")).alias("status"), "n",
    )


@query(
    "pit9_publication_max",
    with_sql(OBS) + """
    SELECT belt, d, avg(tmax) AS tmax, CASE WHEN count(pub) = count(*) THEN max(pub) END AS pub, count(*) AS members
    FROM (SELECT belt, d, tmax, CASE WHEN rain > 0 THEN pub END AS pub FROM obs) GROUP BY belt, d""",
    d="tmax",
)
def _(t):
    rows = obs(t).select("belt", "d", "tmax", F.when(F.col("rain") > 0, F.col("pub")).alias("pub"))
    n = F.count(F.lit(1))
    return rows.groupBy("belt", "d").agg(
        F.avg("tmax").alias("tmax"), F.when(F.count("pub") == n, F.max("pub")).alias("pub"), n.alias("members")
    )


@query(
    "pit10_monotone_pub",
    with_sql(TIMELINE) + """
    SELECT k, map_date, pub, max(pub) OVER (PARTITION BY k ORDER BY map_date) AS running FROM timeline""",
)
def _(t):
    return timeline(t).select("k", "map_date", "pub", pit.monotone_pub(["k"], "map_date", "pub").alias("running"))


@query(
    "pit11_snap_forward",
    with_sql(DAILY) + """, dates AS (SELECT DISTINCT CAST(l_shipdate AS DATE) + 60 AS event_date FROM lineitem),
    ev AS (SELECT k, event_date FROM (SELECT DISTINCT k FROM daily) a, dates)
    SELECT ev.k, ev.event_date, s.d AS session_date FROM ev
    ASOF LEFT JOIN daily s ON ev.k = s.k AND ev.event_date <= s.d""",
)
def _(t):
    cal = daily(t).select("k", "d")
    dates = t.lineitem.select(F.date_add(F.col("l_shipdate").cast("date"), 60).alias("event_date")).distinct()
    # Five priorities by calendar days: both sides are bounded by the calendar, not by the data.
    prios = t.orders.groupBy().agg(F.collect_set("o_orderpriority").alias("_k"))
    events = dates.crossJoin(F.broadcast(prios)).select(F.explode("_k").alias("k"), "event_date")
    return pit.snap_forward(events, cal, ["k"], "event_date", "d", grid=True).select("k", "event_date", "session_date")


@query(
    "pit12_entry_exit",
    with_sql(DAILY) + """, cal AS (SELECT k, d, lead(d, 5) OVER (PARTITION BY k ORDER BY d) AS exit_date FROM daily)
    SELECT l.k, l.d, r.d AS entry_date, r.exit_date FROM daily l ASOF LEFT JOIN cal r ON l.k = r.k AND l.d < r.d""",
)
def _(t):
    cal = daily(t).select("k", "d")
    return pit.entry_exit(cal, cal, ["k"], "d", "d", 5, grid=True)


@query(
    "pit13_session_delay",
    with_sql(DAILY) + """
    SELECT k, d, lag(px) OVER w AS px, lag(n) OVER w AS n FROM daily WINDOW w AS (PARTITION BY k ORDER BY d)""",
    d="px",
)
def _(t):
    return daily(t).select("k", "d", *pit.lag_sessions(["px", "n"], ["k"], "d"))


ISSUES = """issues AS (
  SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year, m,
    make_date(CAST(year(l_shipdate) AS INTEGER), m, 5) AS issue_date,
    CASE m WHEN 2 THEN make_date(CAST(year(l_shipdate) AS INTEGER) - 1, 11, 1) ELSE make_date(CAST(year(l_shipdate) AS INTEGER), 5, 1) END AS s,
    make_date(CAST(year(l_shipdate) AS INTEGER), m, 1) - 1 AS e
  FROM lineitem, (VALUES (2), (7), (8), (9)) v(m))"""


@shared
def issues(t):
    return (
        t.lineitem.select(F.year("l_shipdate").alias("year")).distinct()
        .select("year", F.explode(F.array(*[F.lit(m) for m in (2, 7, 8, 9)])).alias("m"))
        .select(
            "year", F.make_date("year", "m", F.lit(5)).alias("issue_date"),
            # the February issue looks back over New Year
            F.when(F.col("m") == 2, F.make_date(F.col("year") - 1, F.lit(11), F.lit(1))).otherwise(F.make_date("year", F.lit(5), F.lit(1))).alias("start"),
            F.date_sub(F.make_date("year", "m", F.lit(1)), 1).alias("end"),
        )
    )


@query(
    "pit14_issue_table",
    with_sql(TIMELINE, ISSUES) + """, j AS (
      SELECT t.k, i.year, i.issue_date, t.map_date, t.tmax, t.pub, i.e - i.s + 1 AS expected,
             t.pub IS NOT NULL AND t.pub <= i.issue_date AS seen
      FROM timeline t JOIN issues i ON t.map_date BETWEEN i.s AND i.e)
    SELECT k, year, issue_date, max(expected) AS expected_days, count(DISTINCT map_date) FILTER (seen) AS seen_days,
           max(pub) FILTER (seen) AS last_publication, count(*) FILTER (NOT seen) AS late_rows,
           CASE WHEN count(DISTINCT map_date) FILTER (seen) = max(expected) THEN avg(tmax) FILTER (seen) END AS feature
    FROM j GROUP BY k, year, issue_date""",
    d="feature", i="expected_days year",
)
def _(t):
    return pit.issue_table(timeline(t), issues(t), ["k"], "map_date", "pub", "tmax")


@query(
    "pit15_completed_rows",
    with_sql(DAILY) + """, o AS (SELECT k, d, lead(d, 20) OVER (PARTITION BY k ORDER BY d) AS target_end FROM daily)
    SELECT a.k, a.d, count(b.d) AS train_rows FROM o a LEFT JOIN o b ON a.k = b.k AND b.target_end < a.d GROUP BY a.k, a.d""",
)
def _(t):
    from pyspark.sql import Window as W

    o = daily(t).select("k", "d", F.lead("d", 20).over(W.partitionBy("k").orderBy("d")).alias("target_end"))
    return pit.completed_rows(o, "target_end", o, "d", ["k"])


FAMILY = """, fam AS (
      SELECT k, d, CASE WHEN tmax > 45 THEN tmax END AS a, CASE WHEN rain > 9 THEN rain END AS b FROM belt)"""


def family(t):
    return belt(t).select(
        "k", "d", F.when(F.col("tmax") > 45, F.col("tmax")).alias("a"), F.when(F.col("rain") > 9, F.col("rain")).alias("b")
    )


@query(
    "pit16_first_coverage",
    with_sql(BELT) + FAMILY + """, s AS (SELECT k, min(d) AS start FROM fam WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY k)
    SELECT fam.k, fam.d, fam.a, fam.b FROM fam JOIN s ON fam.k = s.k AND fam.d >= s.start""",
    d="a b",
)
def _(t):
    return pit.from_first_coverage(family(t), ["k"], "d", ["a", "b"]).select("k", "d", "a", "b")


CATALOG = {"tmax": "station", "rain": "station", "a": "forecast", "b": "forecast", "never": "archive"}


@query(
    "pit17_feature_catalog",
    with_sql(BELT) + """, p AS (
      SELECT tmax, rain, CASE WHEN tmax > 45 THEN tmax END AS a, CASE WHEN rain > 9 THEN rain END AS b FROM belt),
    c AS (SELECT 'tmax' AS feature, 'station' AS source, false AS tradeable, count(tmax) AS filled, count(*) AS n FROM p
      UNION ALL SELECT 'rain', 'station', false, count(rain), count(*) FROM p
      UNION ALL SELECT 'a', 'forecast', true, count(a), count(*) FROM p
      UNION ALL SELECT 'b', 'forecast', true, count(b), count(*) FROM p
      UNION ALL SELECT 'never', 'archive', false, 0, count(*) FROM p)
    SELECT feature, source, tradeable, filled, n - filled AS unfilled, filled = 0 AS unavailable FROM c""",
    i="filled unfilled",
)
def _(t):
    p = belt(t).select(
        "tmax", "rain", F.when(F.col("tmax") > 45, F.col("tmax")).alias("a"),
        F.when(F.col("rain") > 9, F.col("rain")).alias("b"), F.lit(None).cast("double").alias("never"),
    )
    return pit.feature_catalog(p, CATALOG, ["forecast"])


@query(
    "pit18_latest_decision",
    with_sql(DAILY) + """, s AS (
      SELECT k, d, CASE WHEN px > 200000 THEN 1 WHEN px > 120000 THEN 0 ELSE -1 END AS signal FROM daily
      UNION ALL SELECT k, d, 1 FROM daily WHERE day(d) % 2 = 1),
    l AS (SELECT k, max(d) AS decision_date, max(d) FILTER (signal <> 0) AS last_active FROM s WHERE d <= DATE '1999-06-30' GROUP BY k),
    o AS (SELECT l.k, decision_date, (SELECT min(signal) FROM s WHERE s.k = l.k AND s.d = l.decision_date) AS signal FROM l)
    SELECT k, decision_date, signal, DATE '1999-06-30' - decision_date AS age_days,
      DATE '1999-06-30' - decision_date > 7 AS stale,
      CASE WHEN DATE '1999-06-30' - decision_date > 7 THEN 'HOLD' WHEN signal > 0 THEN 'BUY' WHEN signal < 0 THEN 'SELL' ELSE 'HOLD' END AS action FROM o""",
    i="signal age_days",
)
def _(t):
    px = F.col("px")
    s = daily(t).select("k", "d", F.when(px > 200000, 1).when(px > 120000, 0).otherwise(-1).alias("signal"))
    # every odd day has a second decision
    twice = s.filter(F.dayofmonth("d") % 2 == 1).withColumn("signal", F.lit(1))
    return pit.latest_decision(s.union(twice), ["k"], "d", "signal", F.lit("1999-06-30").cast("date"), 7)


@query(
    "pit19_last_before_entry",
    with_sql(DAILY) + """, cal AS (SELECT k, d FROM daily),
    runs AS (SELECT k, CAST(l_shipdate AS DATE) AS run_date, count(*) AS rows FROM lineitem, (SELECT DISTINCT k FROM daily) GROUP BY 1, 2),
    e AS (SELECT r.k, r.run_date, r.rows, c.d AS entry_date FROM runs r ASOF JOIN cal c ON r.k = c.k AND r.run_date < c.d)
    SELECT k, entry_date, max(run_date) AS run_date, arg_max(rows, run_date) AS rows FROM e GROUP BY k, entry_date""",
)
def _(t):
    cal = daily(t).select("k", "d")
    prios = t.orders.groupBy().agg(F.collect_set("o_orderpriority").alias("_k"))
    runs = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("run_date")).agg(F.count(F.lit(1)).alias("rows"))
    runs = runs.crossJoin(F.broadcast(prios)).select(F.explode("_k").alias("k"), "run_date", "rows")
    e = pit.entry_exit(runs, cal, ["k"], "run_date", "d", 0, grid=True).filter(F.col("entry_date").isNotNull())
    return pit.last_before_entry(e, ["k"], "entry_date", "run_date", ["rows"])


FLAG = TIMELINE + """, lvl AS (
  SELECT k, map_date, tmax, tmax - lag(tmax) OVER (PARTITION BY k ORDER BY map_date) AS delta1,
         max(pub) OVER (PARTITION BY k ORDER BY map_date) AS pub FROM timeline),
lvl_last AS (SELECT k, pub, max(map_date) AS map_date, arg_max(tmax, map_date) AS level, arg_max_null(delta1, map_date) AS delta1
  FROM lvl WHERE pub IS NOT NULL GROUP BY k, pub)"""


@query(
    "panel_minimum_slice",
    with_sql(FLAG, ORDK) + """
    SELECT g.k, g.d, g.px, r.level, r.delta1, r.map_date,
           lead(g.px, 5) OVER (PARTITION BY g.k ORDER BY g.d) / g.px - 1 AS fwd5
    FROM grid g ASOF LEFT JOIN lvl_last r ON g.k = r.k AND g.d >= r.pub""",
    d="px level delta1 fwd5",
)
def minimum_slice(t):
    """Per decision day: the level last published by that day, its change, and the 5-day forward return."""
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("map_date")
    lvl = timeline(t).select(
        "k", "map_date", F.col("tmax").alias("level"), (F.col("tmax") - F.lag("tmax").over(w)).alias("delta1"),
        pit.monotone_pub(["k"], "map_date", "pub").alias("pub"),
    )
    g = grid(t)
    out = pit.asof_join(g, lvl, ["k"], "d", "pub", ["level", "delta1", "map_date"], ["map_date"], grid=True)
    fwd = F.lead("px", 5).over(W.partitionBy("k").orderBy("d")) / F.col("px") - 1
    return out.withColumn("fwd5", fwd)
