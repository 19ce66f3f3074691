"""Statistics queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import stats as ST
from tidemark.operators import windows as WN

from .base import BELT, DAILY, ORDK, PANEL, belt, daily, grid, panel, with_sql
from .harvests import HARV, harvests
from .q_windows import ELIG
from .registry import query

# The published rational approximation of erfc used on both sides.
P_SQL = """((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x})"""


def p_sql(tstat: str) -> str:
    x = f"(abs({tstat}) / sqrt(2.0))"
    return P_SQL.format(t=f"(1.0 / (1.0 + 0.3275911 * {x}))", x=x)


def corr_sql(src: str, keys: str, x: str, y: str, extra: str = "") -> str:
    return f"""SELECT {keys}{extra}, r, n, {p_sql('t')} AS p, CASE WHEN {p_sql('t')} < 0.01 THEN '***' WHEN {p_sql('t')} < 0.05 THEN '**' WHEN {p_sql('t')} < 0.1 THEN '*' ELSE '' END AS stars FROM (
      SELECT *, r * sqrt((n - 2) / greatest(1e-12, 1 - r * r)) AS t FROM (SELECT {keys}, CASE WHEN count(*) >= 8 THEN corr({x}, {y}) END AS r, count(*) AS n FROM {src} GROUP BY {keys}))"""


@query("st1_correlate", with_sql(HARV) + corr_sql("harv", "k", "heat", "yield"), d="r p")
def _(t):
    return ST.correlate(harvests(t), ["k"], "heat", "yield").select("k", "r", "n", "p", "stars")


@query(
    "st2_corr_matrix",
    with_sql(HARV) + """, l AS (SELECT k, h, 'heat' AS measure, heat AS x FROM harv UNION ALL SELECT k, h, 'rain', rain FROM harv UNION ALL SELECT k, h, 'peak', peak FROM harv),
    s AS (SELECT l.k, measure, 'same' AS alignment, x, yield FROM l JOIN harv USING (k, h) UNION ALL
      SELECT l.k, measure, 'lagged', x, yield FROM l JOIN harv ON harv.k = l.k AND harv.h = l.h + 1) """
    + corr_sql("s", "k, measure, alignment", "x", "yield", ", CAST(6 AS BIGINT) AS tests"),
    d="r p",
)
def _(t):
    hv = harvests(t)
    return ST.corr_matrix(hv, hv, ["k"], "h", ["heat", "rain", "peak"], "yield").select(
        "k", "measure", "alignment", "tests", "r", "n", "p", "stars"
    )


@query(
    "st3_detrend",
    with_sql(HARV) + """, tr AS (SELECT k, regr_slope(yield, h) FILTER (h <= 20) AS b, regr_intercept(yield, h) FILTER (h <= 20) AS a FROM harv GROUP BY k)
    SELECT k, h, a + b * h AS trend, yield / (a + b * h) - 1 AS shortfall FROM harv JOIN tr USING (k)""",
    d="trend shortfall",
)
def _(t):
    return ST.detrend(harvests(t), ["k"], "h", "yield", F.col("h") <= 20, "shortfall").select("k", "h", "trend", "shortfall")


OLS2 = """, m AS (SELECT k, count(*) AS n, avg(yield) AS my, avg(heat) AS m0, avg(rain) AS m1, var_pop(yield) AS syy, var_pop(heat) AS s00, var_pop(rain) AS s11,
  covar_pop(heat, rain) AS s01, covar_pop(heat, yield) AS c0, covar_pop(rain, yield) AS c1 FROM harv GROUP BY k),
b AS (SELECT *, s00 * s11 - s01 * s01 AS det, (c0 * s11 - c1 * s01) / (s00 * s11 - s01 * s01) AS b0, (c1 * s00 - c0 * s01) / (s00 * s11 - s01 * s01) AS b1 FROM m),
e AS (SELECT *, (syy - b0 * c0 - b1 * c1) * n AS sse FROM b)"""


@query(
    "st4_ols",
    with_sql(HARV) + OLS2 + """
    SELECT k, n, my - b0 * m0 - b1 * m1 AS intercept, b0 AS b_heat, sqrt(sse / (n - 3) * s11 / (det * n)) AS se_heat, b0 / sqrt(sse / (n - 3) * s11 / (det * n)) AS t_heat,
      b1 AS b_rain, sqrt(sse / (n - 3) * s00 / (det * n)) AS se_rain, b1 / sqrt(sse / (n - 3) * s00 / (det * n)) AS t_rain,
      1 - sse / (syy * n) AS r2, 1 - sse / (syy * n) * (n - 1) / (n - 3) AS adjusted_r2 FROM e""",
    d="intercept b_heat se_heat t_heat b_rain se_rain t_rain r2 adjusted_r2",
)
def _(t):
    return ST.ols(harvests(t), ["k"], "yield", ["heat", "rain"])


@query(
    "st4_ols_wide",
    """WITH x AS (SELECT l_returnflag AS k, l_quantity AS q, l_discount AS disc, l_tax AS tax, l_extendedprice / 1000.0 AS y FROM lineitem),
    s AS (SELECT k, count(*) AS n, avg(y) AS my, avg(q) AS mq, avg(disc) AS md, avg(tax) AS mt, var_pop(y) AS syy, var_pop(q) AS qq, var_pop(disc) AS dd, var_pop(tax) AS tt,
      covar_pop(q, disc) AS qd, covar_pop(q, tax) AS qt, covar_pop(disc, tax) AS dt, covar_pop(q, y) AS cq, covar_pop(disc, y) AS cd, covar_pop(tax, y) AS ct FROM x GROUP BY k),
    det AS (SELECT *, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det FROM s),
    b AS (SELECT *, (cq * (dd * tt - dt * dt) - qd * (cd * tt - dt * ct) + qt * (cd * dt - dd * ct)) / det AS b_q,
      (qq * (cd * tt - dt * ct) - cq * (qd * tt - dt * qt) + qt * (qd * ct - cd * qt)) / det AS b_disc,
      (qq * (dd * ct - cd * dt) - qd * (qd * ct - cd * qt) + cq * (qd * dt - dd * qt)) / det AS b_tax FROM det)
    SELECT k, n, my - b_q * mq - b_disc * md - b_tax * mt AS intercept, b_q, b_disc, b_tax, (b_q * cq + b_disc * cd + b_tax * ct) / syy AS r2 FROM b""",
    d="intercept b_q b_disc b_tax r2",
)
def _(t):
    x = t.lineitem.select(
        F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
    )
    return ST.ols(x, ["k"], "y", ["q", "disc", "tax"]).select("k", "n", "intercept", "b_q", "b_disc", "b_tax", "r2")


@query(
    "st5_horse_race",
    with_sql(HARV) + """, f AS (SELECT a.k, a.h AS drop_h, b.* EXCLUDE (k) FROM (SELECT k, h FROM harv UNION ALL SELECT DISTINCT k, -1 FROM harv) a JOIN harv b ON a.k = b.k AND b.h <> a.h),
    m AS (SELECT k, drop_h, count(*) AS n, var_pop(yield) AS syy, var_pop(heat) AS s00, var_pop(rain) AS s11, covar_pop(heat, rain) AS s01, covar_pop(heat, yield) AS c0, covar_pop(rain, yield) AS c1 FROM f GROUP BY k, drop_h),
    r AS (SELECT *, c0 * c0 / (s00 * syy) AS fr, c1 * c1 / (s11 * syy) AS pr, (c0 * s11 - c1 * s01) / (s00 * s11 - s01 * s01) AS b0, (c1 * s00 - c0 * s01) / (s00 * s11 - s01 * s01) AS b1 FROM m),
    j AS (SELECT *, (b0 * c0 + b1 * c1) / syy AS jr FROM r),
    s AS (SELECT k, min(jr - pr) AS incremental_min, max(jr - pr) AS incremental_max, arg_min(drop_h, jr - pr) AS load_bearing_year, min(drop_h) AS first_year, max(drop_h) AS last_year FROM j WHERE drop_h > 0 GROUP BY k)
    SELECT j.k, n AS harvests, fr AS forecast_r2, pr AS price_r2, jr AS joint_r2, c0 / s00 AS beta_alone, b0 AS beta_joint, b1 AS price_beta_joint, b0 / (c0 / s00) AS beta_retained, jr - pr AS incremental_r2,
      s.* EXCLUDE (k) FROM j JOIN s USING (k) WHERE drop_h = -1""",
    d="forecast_r2 price_r2 joint_r2 beta_alone beta_joint price_beta_joint beta_retained incremental_r2 incremental_min incremental_max",
)
def _(t):
    return ST.horse_race(harvests(t), ["k"], "yield", "heat", "rain", "h")


@query(
    "st6_price_signal",
    with_sql(ORDK) + """, iss AS (SELECT k, y, make_date(CAST(y AS INTEGER), 4, 1) AS base_day, make_date(CAST(y AS INTEGER), m, 1) AS issue FROM (SELECT DISTINCT k, year(d) AS y FROM grid), (VALUES (8), (9), (10)) v(m)),
    a AS (SELECT i.*, g.d AS baseline_date, g.px AS p0 FROM iss i ASOF LEFT JOIN grid g ON i.k = g.k AND i.base_day >= g.d),
    b AS (SELECT a.*, g.d AS signal_date, g.px AS p1 FROM a ASOF LEFT JOIN grid g ON a.k = g.k AND a.issue > g.d)
    SELECT k, issue, baseline_date, signal_date, ln(p1 / p0) AS price_change FROM b WHERE p0 IS NOT NULL AND signal_date >= base_day""",
    d="price_change",
)
def _(t):
    g = grid(t)
    y = g.select("k", F.year("d").alias("y")).distinct()
    iss = y.select("k", F.make_date("y", F.lit(4), F.lit(1)).alias("base_day"), F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(1)) for m in (8, 9, 10)])).alias("issue"))
    return ST.price_signal(g, ["k"], "d", "px", iss, "base_day", "issue").select("k", "issue", "baseline_date", "signal_date", "price_change")


MOM = """, l AS (SELECT k, d, ln(px) AS l FROM daily),
r AS (SELECT k, d, 1 AS horizon, l - lag(l, 1) OVER w AS r FROM l WINDOW w AS (PARTITION BY k ORDER BY d) UNION ALL SELECT k, d, 5, l - lag(l, 5) OVER w FROM l WINDOW w AS (PARTITION BY k ORDER BY d)
  UNION ALL SELECT k, d, 10, l - lag(l, 10) OVER w FROM l WINDOW w AS (PARTITION BY k ORDER BY d)),
mom AS (SELECT k, CAST(horizon AS BIGINT) AS horizon, stddev_samp(r) AS return_sd, count(*) AS overlapping, min(d) AS first_date, max(d) AS last_date, count(*) // any_value(horizon) AS independent
  FROM r WHERE r IS NOT NULL AND month(d) BETWEEN 4 AND 10 GROUP BY 1, 2 HAVING count(*) >= any_value(horizon) * 2)"""


def return_moments(t):
    return ST.return_moments(daily(t), ["k"], "d", "px", (1, 5, 10), range(4, 11))


@query("st7_return_moments", with_sql(DAILY) + MOM + "SELECT * FROM mom", d="return_sd")
def _(t):
    return return_moments(t)


Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


@query(
    "st8_power_budget",
    with_sql(DAILY) + MOM + f""", c AS (SELECT k, horizon, independent, cost_bps, cost_bps / 10000.0 / (return_sd * sqrt(2.0 / pi())) AS break_even, {Z!r} / sqrt(independent) AS detectable FROM mom, (VALUES (10.0), (24.0), (50.0)) v(cost_bps))
    SELECT k, horizon, cost_bps, break_even, detectable, CAST(ceil(pow({Z!r} / break_even, 2)) AS BIGINT) AS observations_needed, ceil(pow({Z!r} / break_even, 2)) / independent AS shortfall, break_even < detectable AS blind FROM c""",
    d="cost_bps break_even detectable shortfall",
)
def _(t):
    return ST.power_budget(return_moments(t), (10.0, 24.0, 50.0)).select(
        "k", "horizon", "cost_bps", "break_even", "detectable", "observations_needed", "shortfall", "blind"
    )


@query(
    "st9_stress_index",
    with_sql(HARV) + """, s AS (SELECT k, h, yield, ((heat - avg(heat) OVER w) / stddev_samp(heat) OVER w - (rain - avg(rain) OVER w) / stddev_samp(rain) OVER w + (peak - avg(peak) OVER w) / stddev_samp(peak) OVER w) / 3.0 AS stress FROM harv WINDOW w AS (PARTITION BY k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stress DESC, h) AS rank FROM s)
    SELECT k, h, stress, rank, avg(yield) FILTER (rank <= 5) OVER (PARTITION BY k) AS mean_top, avg(yield) FILTER (rank > 5) OVER (PARTITION BY k) AS mean_rest FROM r""",
    d="stress mean_top mean_rest",
)
def _(t):
    return ST.stress_index(harvests(t), ["k"], {"heat": 1, "rain": -1, "peak": 1}, "yield", 5, "h").select(
        "k", "h", "stress", "rank", "mean_top", "mean_rest"
    )


@query(
    "st10_pair_comovement",
    with_sql(HARV) + """, tr AS (SELECT k, regr_slope(yield, h) AS b, regr_intercept(yield, h) AS a FROM harv GROUP BY k), s AS (SELECT k, h, yield / (a + b * h) - 1 AS s FROM harv JOIN tr USING (k))
    SELECT x.k AS a, y.k AS b, corr(x.s, y.s) AS r, count(*) AS n, count(*) FILTER (x.s * y.s < 0) AS opposite FROM s x JOIN s y ON x.h = y.h AND x.k < y.k
    WHERE x.s IS NOT NULL AND y.s IS NOT NULL GROUP BY 1, 2""",
    d="r",
)
def _(t):
    s = ST.detrend(harvests(t), ["k"], "h", "yield", F.lit(True), "s")
    return ST.pair_comovement(s, ["h"], "k", "s")


@query(
    "st11_compare_returns",
    with_sql(PANEL, ELIG) + """, f AS (SELECT root, d, settle_cents FROM elig WHERE rk = 1),
    c AS (SELECT root, d, CAST(sum(settle_cents * oi) AS DOUBLE) / sum(oi) AS px FROM panel GROUP BY 1, 2),
    j AS (SELECT root, d, settle_cents / lag(settle_cents) OVER w - 1 AS x, px / lag(px) OVER w - 1 AS y FROM f JOIN c USING (root, d) WINDOW w AS (PARTITION BY root ORDER BY d))
    SELECT root, count(*) AS observations, corr(x, y) AS correlation, median(abs(x - y)) AS median_gap, max(abs(x - y)) AS max_gap FROM j WHERE x IS NOT NULL GROUP BY 1""",
    d="correlation median_gap max_gap",
)
def _(t):
    p = panel(t)
    front = WN.front_contract(p, ["root"], "d", "expiry", "contract", 10, ["settle_cents"])
    cont = p.groupBy("root", "d").agg((F.sum(F.col("settle_cents") * F.col("oi")) / F.sum("oi")).alias("px"))
    return ST.compare_returns(front, cont, ["root"], "d", "settle_cents", "px")


@query(
    "st12_agreement",
    with_sql(PANEL) + """, r AS (SELECT root, contract, d, open_cents / lag(open_cents) OVER w - 1 AS x, settle_cents / lag(settle_cents) OVER w - 1 AS y FROM panel WINDOW w AS (PARTITION BY root, contract ORDER BY d))
    SELECT root, count(*) AS n, avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) AS same_sign, corr(x, y) AS r, avg(abs(x - y)) AS mean_gap FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
    d="same_sign r mean_gap",
)
def _(t):
    p = panel(t)
    r = p.select(
        "root", WN.pct_change(["root", "contract"], "d", "open_cents").alias("x"), WN.pct_change(["root", "contract"], "d", "settle_cents").alias("y")
    )
    return ST.agreement(r, ["root"], "x", "y")
