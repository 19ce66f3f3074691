"""Event-study queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import events as EV
from tidemark.operators import windows as WN

from .base import BELT, DAILY, ORDK, belt, grid, mean, with_sql
from .registry import query, shared

FRI = "CAST(date_trunc('week', d + 2) AS DATE) + 4"
WEEK = BELT + f""", wk AS (SELECT k, {FRI} AS map_date, round(avg(tmax), 9) AS lvl FROM belt GROUP BY 1, 2),
maps AS (SELECT k, map_date, map_date + 2 AS pub, lvl, lvl - lag(lvl) OVER (PARTITION BY k ORDER BY map_date) AS jump FROM wk),
edge AS (SELECT k, quantile_cont(jump, 0.83) AS threshold FROM maps WHERE jump > 0 GROUP BY k),
cand AS (SELECT maps.*, threshold FROM maps JOIN edge USING (k) WHERE jump > 0 AND jump >= threshold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY jump DESC, pub) AS rn FROM cand),
greedy AS (SELECT k, rn, [pub] AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT c.k, c.rn, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - c.pub) < 42)) = 0 THEN list_append(g.kept, c.pub) ELSE g.kept END
  FROM greedy g JOIN ranked c ON c.k = g.k AND c.rn = g.rn + 1),
picked AS (SELECT k, unnest(arg_max(kept, rn)) AS pub FROM greedy GROUP BY k),
ev AS (SELECT c.* EXCLUDE (rn) FROM ranked c JOIN picked p ON c.k = p.k AND c.pub = p.pub)"""


@shared
def maps(t):
    wk = belt(t).groupBy("k", S.week_fri("d").alias("map_date")).agg(F.round(F.avg("tmax"), 9).alias("lvl"))
    return wk.select("k", "map_date", F.date_add("map_date", 2).alias("pub"), "lvl", WN.diff(["k"], "map_date", "lvl").alias("jump"))


@shared
def candidates(t):
    return EV.event_candidates(maps(t), ["k"], "jump", 0.83)


@shared
def picked(t):
    return EV.decluster(candidates(t), ["k"], "pub", "jump", 42)


def rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


@query("ev1_event_candidates", rec(WEEK) + "SELECT k, map_date, pub, jump, threshold FROM cand", d="jump threshold")
def _(t):
    return candidates(t).select("k", "map_date", "pub", "jump", "threshold")


@query("ev2_decluster", rec(WEEK) + "SELECT k, map_date, pub, jump FROM ev", d="jump")
def _(t):
    return picked(t).select("k", "map_date", "pub", "jump")


@query(
    "ev2_decluster_users",
    """WITH RECURSIVE day AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, max(value) AS mag FROM events GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mag DESC, d) AS rn FROM day),
    greedy AS (SELECT k, rn, [d] AS kept FROM ranked WHERE rn = 1
      UNION ALL SELECT c.k, c.rn, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - c.d) < 4)) = 0 THEN list_append(g.kept, c.d) ELSE g.kept END
      FROM greedy g JOIN ranked c ON c.k = g.k AND c.rn = g.rn + 1),
    p AS (SELECT k, unnest(arg_max(kept, rn)) AS d FROM greedy GROUP BY k)
    SELECT day.k, day.d, day.mag FROM day JOIN p ON p.k = day.k AND p.d = day.d""",
    d="mag",
)
def _(t):
    day = t.events.groupBy(F.col("user_id").alias("k"), F.col("ts").cast("date").alias("d")).agg(F.max("value").alias("mag"))
    return EV.decluster(day, ["k"], "d", "mag", 4)


@query(
    "ev3_episodes",
    with_sql(BELT) + """, cold AS (SELECT k, d, tmin, rain FROM belt WHERE tmin < 2.5 AND month(d) IN (6, 7, 8)),
    f AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY k ORDER BY d) > 3 THEN 1 ELSE 0 END AS nw FROM cold),
    g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY k ORDER BY d) AS BIGINT) AS episode FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY k, episode ORDER BY tmin, d) AS rn, count(*) OVER (PARTITION BY k, episode) AS days FROM g)
    SELECT k, episode, d, tmin, rain, days FROM r WHERE rn = 1""",
    d="tmin rain",
)
def _(t):
    cold = belt(t).filter((F.col("tmin") < 2.5) & F.month("d").isin(6, 7, 8))
    return EV.episodes(cold, ["k"], "d", 3, "tmin", ["rain"])


SERIES = """ser AS (SELECT k, d, px / lag(px) OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM grid),
sidx AS (SELECT k, d, r, row_number() OVER (PARTITION BY k ORDER BY d) AS idx, count(*) OVER (PARTITION BY k) AS n FROM ser)"""
WINDOWS = """, anchor AS (SELECT e.k, e.pub, s.idx, s.n FROM (SELECT DISTINCT k, pub FROM ev) e ASOF LEFT JOIN sidx s ON e.k = s.k AND e.pub <= s.d),
win AS (SELECT a.k, a.pub, o.o AS "offset", s.r AS value FROM anchor a CROSS JOIN generate_series(-10, 10) o(o)
  LEFT JOIN sidx s ON s.k = a.k AND s.idx = a.idx + o.o AND a.idx - 10 >= 1 AND a.idx + 10 <= a.n),
sums AS (SELECT k, pub, sum(value) FILTER ("offset" BETWEEN -10 AND -1) AS before, sum(value) FILTER ("offset" BETWEEN 1 AND 10) AS after FROM win GROUP BY 1, 2)"""


@shared
def series(t):
    return grid(t).select("k", "d", WN.pct_change(["k"], "d", "px").alias("r"))


@shared
def windows(t):
    return EV.event_windows(picked(t), series(t), ["k"], "pub", "d", "r", 10, 10)


@shared
def sums(t):
    w = windows(t)
    return EV.window_sum(w, ["k"], "pub", -10, -1, "before").join(EV.window_sum(w, ["k"], "pub", 1, 10, "after"), ["k", "pub"])


@query("ev4_event_windows", rec(WEEK, ORDK, SERIES) + WINDOWS + "SELECT * FROM win", d="value")
def _(t):
    return windows(t)


@query("ev5_window_sum", rec(WEEK, ORDK, SERIES) + WINDOWS + "SELECT * FROM sums", d="before after")
def _(t):
    return sums(t)


@query(
    "ev6_forward_change",
    rec(WEEK) + """, a AS (SELECT k, map_date, lead(lvl, 2) OVER (PARTITION BY k ORDER BY map_date) - lvl AS forward_change FROM maps)
    SELECT ev.k, ev.map_date, ev.jump, a.forward_change FROM ev JOIN a ON a.k = ev.k AND a.map_date = ev.map_date""",
    d="jump forward_change",
)
def _(t):
    return EV.forward_change(picked(t).select("k", "map_date", "jump"), maps(t), ["k"], "map_date", "lvl", 2)


POOL = """, pool AS (SELECT k, d, idx, window_sum FROM (SELECT k, d, idx, n, sum(r) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS window_sum FROM sidx)
  WHERE idx - 10 >= 1 AND idx + 10 <= n AND month(d) BETWEEN 4 AND 9),
size AS (SELECT k, count(*) AS n FROM ev GROUP BY 1),
packed AS (SELECT p.k, list(window_sum ORDER BY idx) AS a, any_value(size.n) AS n FROM pool p JOIN size ON size.k = p.k GROUP BY 1 HAVING count(*) >= any_value(size.n)),
"""


def floyd_sql(seed: int, what: str, n: str, size: str) -> str:
    """Places of a draw without replacement, from 0: for j from size - n, a digest's place up to j, or j if that is taken."""
    steps = f"list_transform(range(CAST({size} - {n} AS BIGINT), CAST({size} AS BIGINT)), lambda j: [CAST('0x' || substr(md5('{seed}:' || {what} || ':' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) % (j + 1), j])"
    return f"list_reduce({steps}, lambda acc, x: list_append(acc, CASE WHEN list_contains(acc, x[1]) THEN x[2] ELSE x[1] END), []::BIGINT[])"


POOL += f"""picks AS (SELECT k, draw, a, {floyd_sql(11, 'CAST(draw AS VARCHAR)', 'n', 'len(a)')} AS i FROM packed CROSS JOIN generate_series(1, 2000) g(draw)),
vals AS (SELECT k, draw, list_filter(list_transform(i, lambda x: a[x + 1]), lambda x: x IS NOT NULL) AS v FROM picks),
dist AS (SELECT k, draw, list_sum(v) / len(v) AS mean, len(v) AS n FROM vals)"""


def placebo(t):
    pool = EV.day_sums(series(t), ["k"], "d", "r", 1, 10, 10, 10).filter(F.month("d").between(4, 9))
    size = picked(t).groupBy("k").agg(F.count(F.lit(1)).alias("n_events"))
    return EV.placebo(pool.select("k", "idx", "window_sum"), size, ["k"], "idx", "window_sum", "n_events", 2000, 11)


@query("ev7_placebo", rec(WEEK, ORDK, SERIES) + POOL + "SELECT * FROM dist", d="mean")
def _(t):
    return placebo(t)


@query(
    "ev8_quantile_of",
    rec(WEEK, ORDK, SERIES) + WINDOWS + POOL + """, o AS (SELECT k, avg(after) AS observed FROM sums GROUP BY 1)
    SELECT o.k, o.observed, avg(CASE WHEN mean <= observed THEN 1.0 ELSE 0.0 END) AS quantile, count(mean) AS draws,
      1.0 - avg(CASE WHEN mean <= observed THEN 1.0 ELSE 0.0 END) AS p_value FROM dist JOIN o USING (k) GROUP BY 1, 2""",
    d="observed quantile p_value",
)
def _(t):
    observed = sums(t).groupBy("k").agg(F.avg("after").alias("observed"))
    return EV.quantile_of(observed, placebo(t), ["k"], "observed", "mean")


@query(
    "ev9_event_report",
    rec(WEEK, ORDK, SERIES) + WINDOWS + """, fc AS (SELECT k, map_date, lead(lvl, 2) OVER (PARTITION BY k ORDER BY map_date) - lvl AS fwd FROM maps),
    x AS (SELECT s.*, fc.fwd FROM sums s JOIN ev ON ev.k = s.k AND ev.pub = s.pub JOIN fc ON fc.k = ev.k AND fc.map_date = ev.map_date),
    c AS (SELECT k, 'all' AS cut, before, after FROM x UNION ALL SELECT k, 'continued', before, after FROM x WHERE fwd > 0
      UNION ALL SELECT k, 'peaked', before, after FROM x WHERE fwd <= 0 UNION ALL SELECT k, 'summer', before, after FROM x WHERE month(pub) BETWEEN 6 AND 8
      UNION ALL SELECT k, 'ex1998', before, after FROM x WHERE year(pub) <> 1998),
    w AS (SELECT k, cut, 'before' AS "window", before AS total FROM c UNION ALL SELECT k, cut, 'after', after FROM c)
    SELECT k, cut, "window", count(*) AS events, count(total) AS n, avg(total) AS mean, median(total) AS median, avg(CASE WHEN total > 0 THEN 1.0 WHEN total <= 0 THEN 0.0 END) AS positive FROM w GROUP BY 1, 2, 3""",
    d="mean median positive",
)
def _(t):
    ahead = EV.forward_change(picked(t).select("k", "map_date", "pub"), maps(t), ["k"], "map_date", "lvl", 2)
    x = sums(t).join(ahead, ["k", "pub"])
    cuts = {
        "all": F.lit(True), "continued": F.col("forward_change") > 0, "peaked": F.col("forward_change") <= 0,
        "summer": F.month("pub").between(6, 8), "ex1998": F.year("pub") != 1998,
    }
    return EV.event_report(x, ["k"], cuts, ["before", "after"])


OUT = """, o20 AS (SELECT k, d, lead(px, 20) OVER (PARTITION BY k ORDER BY d) / px - 1 AS ret FROM grid QUALIFY ret IS NOT NULL),
o60 AS (SELECT k, d, lead(px, 60) OVER (PARTITION BY k ORDER BY d) / px - 1 AS ret FROM grid QUALIFY ret IS NOT NULL),
e AS (SELECT k, pub FROM ev)"""


@query(
    "ev10_event_outcomes",
    rec(WEEK, ORDK) + OUT + """
    SELECT e.k, e.pub, o.d, o.ret, CAST(20 AS BIGINT) AS horizon FROM e ASOF JOIN o20 o ON e.k = o.k AND e.pub <= o.d WHERE e.pub >= (SELECT min(d) FROM o20 x WHERE x.k = e.k)
    UNION ALL SELECT e.k, e.pub, o.d, o.ret, 60 FROM e ASOF JOIN o60 o ON e.k = o.k AND e.pub <= o.d WHERE e.pub >= (SELECT min(d) FROM o60 x WHERE x.k = e.k)""",
    d="ret",
)
def _(t):
    def outcome(h):
        return grid(t).select("k", "d", WN.forward_return(["k"], "d", "px", h).alias("ret")).filter("ret IS NOT NULL")

    return EV.event_outcomes(picked(t).select("k", "pub"), {20: outcome(20), 60: outcome(60)}, ["k"], "pub", "d", ["ret"])


MATCH = """, pool AS (SELECT g.k, year(g.d) AS year, g.d, g.r FROM ser g WHERE month(g.d) IN (6, 7, 8) AND g.r IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.k = g.k AND abs(ev.pub - g.d) <= 10)),
size AS (SELECT k, year(pub) AS year, count(*) AS n FROM ev WHERE month(pub) IN (6, 7, 8) GROUP BY 1, 2),
packed AS (SELECT s.k, s.year, s.n, list(p.r ORDER BY p.d) AS a FROM size s JOIN pool p ON p.k = s.k AND p.year = s.year GROUP BY 1, 2, 3),
drawn AS (SELECT k, draw, list_sum(list_transform(""" + floyd_sql(590, "CAST(draw AS VARCHAR) || ':' || CAST(year AS VARCHAR)", "n", "len(a)") + """, lambda x: a[x + 1])) AS total, n
  FROM packed CROSS JOIN generate_series(1, 10000) g(draw))"""


@query(
    "ev11_matched_null",
    rec(WEEK, ORDK, SERIES) + MATCH + "SELECT k, draw, sum(total) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n FROM drawn GROUP BY 1, 2",
    d="mean",
)
def _(t):
    ev = picked(t).select("k", F.col("pub").alias("d"))
    days = series(t).filter(F.month("d").isin(6, 7, 8) & F.col("r").isNotNull())
    pool = EV.matched_pool(days, ev, ["k"], "d", 10).withColumn("year", F.year("d"))
    sizes = ev.filter(F.month("d").isin(6, 7, 8)).groupBy("k", F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))
    return EV.matched_null(pool, sizes, ["k"], "year", "d", "r", "n_events", 10000, 590)


@query(
    "ev12_event_metrics",
    rec(WEEK, ORDK, SERIES) + WINDOWS + """
    SELECT k, CASE WHEN year(pub) <= 1997 THEN 'extension' WHEN year(pub) <= 1999 THEN 'development' ELSE 'consumed' END AS sample,
      count(after) AS events, avg(after) AS mean_net, median(after) AS median_net, count(*) FILTER (after > 0) AS positive, avg(CASE WHEN after > 0 THEN 1.0 ELSE 0.0 END) AS positive_share
    FROM sums WHERE after IS NOT NULL GROUP BY 1, 2""",
    d="mean_net median_net positive_share",
)
def _(t):
    y = F.year("pub")
    x = sums(t).withColumn("sample", F.when(y <= 1997, "extension").when(y <= 1999, "development").otherwise("consumed"))
    return EV.event_metrics(x, ["k", "sample"], "after")
