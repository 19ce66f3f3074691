"""Window queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import pit
from tidemark.operators import windows as WN

from .base import ANNUAL, BELT, DAILY, ORDK, PANEL, annual, belt, daily, grid, panel, with_sql
from .registry import query

BUSDAY = """(5 * floor((({b}) - DATE '1970-01-01' + 3) / 7.0) + least(((({b}) - DATE '1970-01-01' + 3) % 7 + 7) % 7, 5)
 - 5 * floor((({a}) - DATE '1970-01-01' + 3) / 7.0) - least(((({a}) - DATE '1970-01-01' + 3) % 7 + 7) % 7, 5))"""


def busday_sql(a: str, b: str) -> str:
    return BUSDAY.format(a=a, b=b)


@query(
    "wn1_rolling_days",
    with_sql(BELT) + """
    SELECT k, d, CASE WHEN count(rain) OVER w >= 7 THEN sum(rain) OVER w END AS rain7,
      CASE WHEN count(tmax) OVER v >= 30 THEN sum(greatest(tmax - 29.0, 0.0)) OVER v END AS heat30
    FROM belt WINDOW w AS (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
      v AS (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
    d="rain7 heat30",
)
def _(t):
    b = belt(t).withColumn("hot", S.excess("tmax", 29.0))
    return b.select(
        "k", "d", WN.rolling_days(["k"], "d", "rain", 7).alias("rain7"), WN.rolling_days(["k"], "d", "hot", 30).alias("heat30")
    )


@query(
    "wn2_rolling_rows",
    with_sql(BELT) + """
    SELECT k, d, CASE WHEN count(*) OVER w >= 30 THEN sum(rain) OVER w END AS rain30,
      CASE WHEN count(*) OVER v >= 7 THEN min(tmin) OVER v END AS tmin7,
      CASE WHEN count(*) OVER w >= 15 THEN avg(tmax) OVER w END AS tmax30
    FROM belt WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
      v AS (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    d="rain30 tmin7 tmax30",
)
def _(t):
    return belt(t).select(
        "k", "d", WN.rolling_rows(["k"], ["d"], "rain", 30, 30).alias("rain30"),
        WN.rolling_rows(["k"], ["d"], "tmin", 7, 7, "min").alias("tmin7"),
        WN.rolling_rows(["k"], ["d"], "tmax", 30, 15, "avg").alias("tmax30"),
    )


RUNS = """, f AS (SELECT k, d, rain < 4.5 AS dry, row_number() OVER (PARTITION BY k ORDER BY d) AS pos FROM belt),
    g AS (SELECT *, pos - coalesce(max(CASE WHEN NOT dry THEN pos END) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS run FROM f)"""


@query(
    "wn3_rolling_longest_run",
    with_sql(BELT) + RUNS + """
    SELECT a.k, a.d, CASE WHEN a.pos >= 30 THEN max(least(b.run, b.pos - a.pos + 30)) END AS spell30
    FROM g a JOIN g b ON a.k = b.k AND b.pos BETWEEN a.pos - 29 AND a.pos GROUP BY a.k, a.d, a.pos""",
    i="spell30",
)
def _(t):
    b = belt(t).select("k", "d", (F.col("rain") < 4.5).alias("dry"))
    return WN.rolling_longest_run(b, ["k"], "d", "dry", 30, "spell30").select("k", "d", "spell30")


@query(
    "wn4_longest_run",
    with_sql(BELT) + """, f AS (SELECT k, CAST(year(d) AS BIGINT) AS year, d, rain < 4.5 AS dry,
        row_number() OVER (PARTITION BY k, year(d) ORDER BY d) AS pos FROM belt),
      i AS (SELECT k, year, dry, pos - row_number() OVER (PARTITION BY k, year, dry ORDER BY pos) AS island FROM f),
      r AS (SELECT k, year, island, count(*) AS n FROM i WHERE dry GROUP BY 1, 2, 3),
      y AS (SELECT DISTINCT k, year FROM f)
    SELECT y.k, y.year, coalesce(max(n), 0) AS spell FROM y LEFT JOIN r ON y.k = r.k AND y.year = r.year GROUP BY 1, 2""",
)
def _(t):
    b = belt(t).select("k", "d", F.year("d").alias("year"), (F.col("rain") < 4.5).alias("dry"))
    return WN.longest_run(b, ["k"], ["year"], "d", "dry", "spell")


PRIOR = "(PARTITION BY k, month(d), day(d) ORDER BY year(d) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "wn5_prior_year_z",
    with_sql(DAILY) + f"""
    SELECT k, d, (px - avg(px) OVER w) / nullif(stddev_samp(px) OVER w, 0) AS z FROM daily WINDOW w AS {PRIOR}""",
    d="z",
)
def _(t):
    return daily(t).select("k", "d", WN.prior_year_z(["k"], "d", "px").alias("z"))


@query(
    "wn6_prior_year_anomaly",
    with_sql(DAILY) + f"SELECT k, d, px - avg(px) OVER w AS anomaly FROM daily WINDOW w AS {PRIOR}",
    d="anomaly",
)
def _(t):
    return daily(t).select("k", "d", WN.prior_year_anomaly(["k"], "d", "px").alias("anomaly"))


K = "(PARTITION BY k ORDER BY d)"


@query("wn7_diff", with_sql(BELT) + f"SELECT k, d, tmax - lag(tmax) OVER {K} AS d1, tmax - lag(tmax, 4) OVER {K} AS d4 FROM belt", d="d1 d4")
def _(t):
    return belt(t).select("k", "d", WN.diff(["k"], "d", "tmax").alias("d1"), WN.diff(["k"], "d", "tmax", 4).alias("d4"))


WIDE = """, wide AS (
      SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS k,
        avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent,
        avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1, 2)"""


@query(
    "wn8_revision",
    with_sql(DAILY) + WIDE + f"""
    SELECT k, d, urgent, low, urgent - lag(urgent) OVER {K} AS urgent_rev, low - lag(low) OVER {K} AS low_rev FROM wide""",
    d="urgent low urgent_rev low_rev",
)
def _(t):
    def of(p):
        return F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))

    wide = t.orders.groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").cast("date").alias("d")).agg(
        of("1-URGENT").alias("urgent"), of("5-LOW").alias("low")
    )
    return wide.select(
        "k", "d", "urgent", "low", WN.diff(["k"], "d", "urgent").alias("urgent_rev"), WN.diff(["k"], "d", "low").alias("low_rev")
    )


@query(
    "wn9_consecutive_revision",
    with_sql(DAILY) + f"""
    SELECT k, d, CASE WHEN d - lag(d) OVER {K} = 1 THEN px - lag(px) OVER {K} END AS rev,
      coalesce(d - lag(d) OVER {K} = 1, false) AS has_prior FROM daily""",
    d="rev",
)
def _(t):
    rev, ok = WN.consecutive_revision(["k"], "d", "px")
    return daily(t).select("k", "d", rev.alias("rev"), ok.alias("has_prior"))


@query(
    "wn10_pct_change",
    with_sql(DAILY) + f"SELECT k, d, px / lag(px, 5) OVER {K} - 1 AS mom5, px / lag(px, 20) OVER {K} - 1 AS mom20 FROM daily",
    d="mom5 mom20",
)
def _(t):
    return daily(t).select(
        "k", "d", WN.pct_change(["k"], "d", "px", 5).alias("mom5"), WN.pct_change(["k"], "d", "px", 20).alias("mom20")
    )


RET = f"""rets AS (SELECT k, d, px, n, px / lag(px) OVER {K} - 1 AS r FROM daily)"""


def rets(t):
    return daily(t).withColumn("r", WN.pct_change(["k"], "d", "px"))


@query(
    "wn11_rolling_vol",
    with_sql(DAILY, RET) + """
    SELECT k, d, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w END * sqrt(252.0) AS vol20
    FROM rets WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    d="vol20",
)
def _(t):
    return rets(t).select("k", "d", WN.rolling_vol(["k"], "d", "r", 20, 15).alias("vol20"))


@query(
    "wn12_rolling_beta",
    with_sql(DAILY, RET) + """, b AS (SELECT k, d, r, avg(r) OVER (PARTITION BY d) AS basket FROM rets),
    c AS (SELECT k, d, CASE WHEN count(r) OVER w >= 60 THEN covar_samp(r, basket) OVER w END
       / nullif(CASE WHEN count(basket) OVER w >= 60 THEN var_samp(basket) OVER w END, 0) AS beta
      FROM b WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
    SELECT k, d, CASE WHEN beta IS NOT NULL THEN least(greatest(beta, -3.0), 3.0) END AS beta FROM c""",
    d="beta",
)
def _(t):
    r = rets(t)
    basket = r.groupBy("d").agg(F.avg("r").alias("basket"))
    return r.join(basket, "d").select("k", "d", WN.rolling_beta(["k"], "d", "r", "basket", 126, 60).alias("beta"))


@query(
    "wn13_rolling_log_z",
    with_sql(DAILY) + """
    SELECT k, d, CASE WHEN count(n) OVER w >= 15 THEN (ln(1 + n) - avg(ln(1 + n)) OVER w) / nullif(stddev_samp(ln(1 + n)) OVER w, 0) END AS z
    FROM daily WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    d="z",
)
def _(t):
    return daily(t).select("k", "d", WN.rolling_log_z(["k"], "d", "n", 20, 15).alias("z"))


@query(
    "wn14_forward_window",
    with_sql(BELT) + """
    SELECT k, d, CASE WHEN count(tmax) OVER w >= 5 THEN avg(tmax) OVER w END AS realised_tmax,
      CASE WHEN count(tmax) OVER w >= 5 THEN sum(greatest(tmax - 29.0, 0.0)) OVER w END AS realised_dd
    FROM belt WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    d="realised_tmax realised_dd",
)
def _(t):
    b = belt(t).withColumn("hot", S.excess("tmax", 29.0))
    return b.select(
        "k", "d", WN.forward_window(["k"], "d", "tmax", 5).alias("realised_tmax"),
        WN.forward_window(["k"], "d", "hot", 5, "sum").alias("realised_dd"),
    )


@query(
    "wn15_forward_return",
    with_sql(DAILY) + f"SELECT k, d, lead(px, 5) OVER {K} / px - 1 AS fwd5, lead(d, 5) OVER {K} AS target_end FROM daily",
    d="fwd5",
)
def _(t):
    return daily(t).select(
        "k", "d", WN.forward_return(["k"], "d", "px", 5).alias("fwd5"), WN.target_end(["k"], "d", 5).alias("target_end")
    )


TRIO = """, trio AS (
      SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS k,
        avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a,
        avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b,
        avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS c FROM orders GROUP BY 1, 2),
    f AS (SELECT k, d, lead(a, 5) OVER w / a - 1 AS ra, lead(b, 5) OVER w / b - 1 AS rb, lead(c, 5) OVER w / c - 1 AS rc,
      a / lag(a) OVER w - 1 AS beta FROM trio WINDOW w AS (PARTITION BY k ORDER BY d))"""


def trio(t):
    def of(p):
        return F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))

    return t.orders.groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").cast("date").alias("d")).agg(
        of("1-URGENT").alias("a"), of("2-HIGH").alias("b"), of("3-MEDIUM").alias("c")
    )


@query(
    "wn16_relative_targets",
    with_sql(DAILY) + TRIO + "SELECT k, d, ra - rc AS spread, ra - beta * (rb + rc) / 2.0 AS neutral FROM f",
    d="spread neutral",
)
def _(t):
    f = trio(t).select(
        "k", "d", *[WN.forward_return(["k"], "d", c, 5).alias(f"r{c}") for c in "abc"],
        WN.pct_change(["k"], "d", "a").alias("beta"),
    )
    spread, neutral = WN.relative_targets("ra", ["rb", "rc"], "beta")
    return f.select("k", "d", spread.alias("spread"), neutral.alias("neutral"))


@query(
    "wn17_deseasonalise",
    with_sql(DAILY, RET) + """, s AS (SELECT k, d, r, sum(r) OVER w - sum(r) OVER y AS so, count(r) OVER w - count(r) OVER y AS no FROM rets
      WINDOW w AS (PARTITION BY k, week(d)), y AS (PARTITION BY k, week(d), year(d)))
    SELECT k, d, r - coalesce(so / nullif(no, 0), 0.0) AS adj FROM s""",
    d="adj",
)
def _(t):
    return WN.deseasonalise(rets(t).select("k", "d", "r"), ["k"], "d", "r", "adj").select("k", "d", "adj")


@query(
    "wn18_cumulate",
    with_sql(DAILY, RET) + """
    SELECT k, CAST(year(d) AS BIGINT) AS year, d, sum(coalesce(r, 0.0)) OVER (PARTITION BY k, year(d) ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM rets""",
    d="cum",
)
def _(t):
    r = rets(t).withColumn("year", F.year("d"))
    return r.select("k", "year", "d", WN.cumulate(["k", "year"], "d", "r").alias("cum"))


@query(
    "wn19_equity_drawdown",
    with_sql(DAILY, RET) + """, nn AS (SELECT k, d, r / 500.0 - 0.002 AS net FROM rets),
    e AS (SELECT k, d, exp(sum(ln(1 + coalesce(net, 0.0))) OVER w) AS equity FROM nn
      WINDOW w AS (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT k, d, equity, max(equity) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM e)
    SELECT k, d, equity, equity / peak - 1 AS drawdown FROM p""",
    d="equity drawdown",
)
def _(t):
    n = rets(t).select("k", "d", (F.col("r") / 500.0 - 0.002).alias("net"))
    return WN.drawdown(n, ["k"], ["d"], "net").select("k", "d", "equity", "drawdown")


ELIG = f"""elig AS (SELECT *, {busday_sql('d', 'expiry')} AS days_left,
   row_number() OVER (PARTITION BY root, d ORDER BY expiry, contract) AS rk FROM panel WHERE {busday_sql('d', 'expiry')} > 10)"""


@query(
    "wn20_front_contract",
    with_sql(PANEL, ELIG) + "SELECT root, d, expiry, contract, settle_cents FROM elig WHERE rk = 1",
    d="settle_cents",
)
def _(t):
    return WN.front_contract(panel(t), ["root"], "d", "expiry", "contract", 10, ["settle_cents"])


@query(
    "wn21_curve",
    with_sql(PANEL, ELIG) + """, two AS (
      SELECT a.root, a.d, a.contract AS near, b.contract AS far, b.settle_cents / a.settle_cents - 1 AS slope
      FROM elig a JOIN elig b ON a.root = b.root AND a.d = b.d AND a.rk = 1 AND b.rk = 2),
    s AS (SELECT *, slope - lag(slope) OVER (PARTITION BY root ORDER BY d) AS d1, slope - lag(slope, 20) OVER (PARTITION BY root ORDER BY d) AS slope_mom20 FROM two)
    SELECT root, d, near, far, slope, slope_mom20, CASE WHEN count(d1) OVER w >= 15 THEN stddev_samp(d1) OVER w END * sqrt(252.0) AS slope_vol20
    FROM s WINDOW w AS (PARTITION BY root ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    d="slope slope_mom20 slope_vol20",
)
def _(t):
    return WN.curve(panel(t), ["root"], "d", "expiry", "contract", "settle_cents", 10).select(
        "root", "d", "near", "far", "slope", "slope_mom20", "slope_vol20"
    )


@query(
    "wn22_within_contract",
    with_sql(PANEL) + """, r AS (SELECT root, contract, expiry, d, settle_cents / lag(settle_cents) OVER w - 1 AS r,
       settle_cents / lag(settle_cents, 5) OVER w - 1 AS mom5 FROM panel WINDOW w AS (PARTITION BY root, contract ORDER BY d)),
    v AS (SELECT root, contract, expiry, d, mom5, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w END * sqrt(252.0) AS vol20
      FROM r WINDOW w AS (PARTITION BY root, contract ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, row_number() OVER (PARTITION BY root, d ORDER BY expiry, contract) AS rk FROM v WHERE """ + busday_sql("d", "expiry") + """ > 10)
    SELECT root, d, contract, mom5, vol20 FROM e WHERE rk = 1""",
    d="mom5 vol20",
)
def _(t):
    p = panel(t).withColumn("r", WN.pct_change(["root", "contract"], "d", "settle_cents"))
    p = p.withColumn("mom5", WN.pct_change(["root", "contract"], "d", "settle_cents", 5))
    p = p.withColumn("vol20", WN.rolling_vol(["root", "contract"], "d", "r", 20, 15))
    # Features are measured inside each contract before the front one is chosen.
    return WN.front_contract(p, ["root"], "d", "expiry", "contract", 10, ["mom5", "vol20"]).select(
        "root", "d", "contract", "mom5", "vol20"
    )


@query(
    "wn23_shift_within",
    with_sql(DAILY) + """
    SELECT k, d, lag(px) OVER w AS later, lead(px) OVER w AS earlier FROM daily WINDOW w AS (PARTITION BY k, year(d) ORDER BY d)""",
    d="later earlier",
)
def _(t):
    x = daily(t).withColumn("year", F.year("d"))
    return x.select(
        "k", "d", WN.shift_within(["k", "year"], "d", "px", 1).alias("later"),
        WN.shift_within(["k", "year"], "d", "px", -1).alias("earlier"),
    )


@query(
    "wn24_rank_gap",
    with_sql(ANNUAL) + """
    SELECT k, year, rank() OVER (PARTITION BY k ORDER BY heat DESC) AS rank_a, rank() OVER (PARTITION BY k ORDER BY yield DESC) AS rank_b,
      (yield - avg(yield) OVER w) / stddev_samp(yield) OVER w - (heat - avg(heat) OVER w) / stddev_samp(heat) OVER w AS gap
    FROM annual WINDOW w AS (PARTITION BY k)""",
    d="gap",
)
def _(t):
    return WN.rank_gap(annual(t), ["k"], "heat", "yield").select("k", "year", "rank_a", "rank_b", "gap")


@query(
    "wn25_quantile_bucket",
    with_sql(BELT) + """, q AS (SELECT k, quantile_cont(rain, 1/3.0) AS lo, quantile_cont(rain, 2/3.0) AS hi, count(rain) AS n FROM belt GROUP BY k)
    SELECT b.k, b.d, CASE WHEN n < 9 OR lo >= hi THEN NULL WHEN rain <= lo THEN 'low' WHEN rain <= hi THEN 'mid' ELSE 'high' END AS bucket
    FROM belt b JOIN q USING (k)""",
)
def _(t):
    return WN.quantile_bucket(
        belt(t), ["k"], "rain", [1 / 3, 2 / 3], ["low", "mid", "high"], 9, "bucket"
    ).select("k", "d", "bucket")


@query(
    "wn26_median_split",
    with_sql(ANNUAL) + """, m AS (SELECT k, median(year) AS mid FROM annual GROUP BY k)
    SELECT a.k, a.year, CASE WHEN a.year <= m.mid THEN 'early' ELSE 'late' END AS era FROM annual a JOIN m USING (k)""",
)
def _(t):
    a = annual(t).select("k", "year")
    return WN.quantile_bucket(a, ["k"], "year", [0.5], ["early", "late"], 1, "era").select("k", "year", "era")


@query(
    "wn27_autocorr",
    with_sql(DAILY, RET) + """, l AS (SELECT k, r, lag(r, 5) OVER (PARTITION BY k ORDER BY d) AS l FROM rets)
    SELECT k, corr(r, l) AS autocorr, count(r) FILTER (l IS NOT NULL) AS pairs FROM l GROUP BY k""",
    d="autocorr",
)
def _(t):
    return WN.autocorr(rets(t), ["k"], "d", "r", 5)


FRI = "CAST(date_trunc('week', d + 2) AS DATE) + 4"


@query(
    "wn28_last_of_week",
    with_sql(DAILY) + f"SELECT k, {FRI} AS period, max(d) AS d, arg_max(px, d) AS px FROM daily GROUP BY 1, 2",
    d="px",
)
def _(t):
    return WN.last_of_period(daily(t), ["k"], S.week_fri("d"), "d", ["px"])


@query(
    "wn29_fill_at_release",
    with_sql(BELT, ORDK) + """
    SELECT e.k, e.pub, g.d AS priced_on, g.px FROM (SELECT DISTINCT k, pub FROM belt) e ASOF LEFT JOIN grid g ON e.k = g.k AND e.pub >= g.d""",
    d="px",
)
def _(t):
    g = grid(t).select("k", F.col("d").alias("_d"), F.col("d").alias("priced_on"), "px")
    return pit.asof_join(belt(t).select("k", "pub").distinct(), g, ["k"], "pub", "_d", ["priced_on", "px"], grid=True)


@query(
    "wn30_lead_lag",
    with_sql(BELT, ORDK) + """, w AS (
      SELECT g.k, CAST((CAST(date_trunc('week', g.d) AS DATE) - DATE '1995-01-02') // 7 AS BIGINT) AS wk, avg(px) AS y, avg(rain) AS x
      FROM grid g JOIN belt b ON g.k = b.k AND g.d = b.d GROUP BY 1, 2)
    SELECT a.k, CAST(v.lag AS BIGINT) AS lag, corr(a.x, b.y) AS r, count(*) AS n
    FROM w a, (VALUES (-4), (-3), (-2), (-1), (0), (1), (2), (3), (4)) v(lag) JOIN w b ON b.k = a.k AND b.wk = a.wk + v.lag GROUP BY 1, 2""",
    d="r",
)
def _(t):
    monday = F.to_date(F.date_trunc("week", "d"))
    w = grid(t).join(belt(t), ["k", "d"]).groupBy(
        "k", F.floor(F.datediff(monday, F.lit("1995-01-02").cast("date")) / F.lit(7)).alias("wk")
    ).agg(F.avg("px").alias("y"), F.avg("rain").alias("x"))
    w = w.withColumnRenamed("k", "belt")
    return WN.lead_lag_frame(w, ["belt"], "wk", "x", "y", range(-4, 5)).select(
        F.col("belt").alias("k"), F.col("k").alias("lag"), "r", "n"
    )


@query(
    "wn31_pct_rank",
    with_sql(BELT) + """, x AS (SELECT k, d, CASE WHEN day(d) % 5 <> 0 THEN round(rain) END AS rain FROM belt)
    SELECT a.k, a.d, CASE WHEN a.rain IS NOT NULL THEN (b.below + (b.same + 1) / 2.0) / n.n END AS pr FROM x a
    LEFT JOIN (SELECT k, rain, same, sum(same) OVER (PARTITION BY k ORDER BY rain) - same AS below FROM (SELECT k, rain, count(*) AS same FROM x WHERE rain IS NOT NULL GROUP BY 1, 2)) b
      ON a.k = b.k AND a.rain = b.rain
    JOIN (SELECT k, count(rain) AS n FROM x GROUP BY 1) n ON n.k = a.k""",
    d="pr",
)
def _(t):
    x = belt(t).withColumn("rain", F.when(F.dayofmonth("d") % 5 != 0, F.floor(F.col("rain") + 0.5).cast("double")))
    return WN.pct_rank(x, ["k"], "rain", "pr").select("k", "d", "pr")
