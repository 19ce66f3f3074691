"""Aggregation and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregate as AG
from tidemark.operators import sets as SO

from .base import ANNUAL, BELT, DAILY, OBS, PANEL, annual, belt, belt_state, cents, daily, obs, ordk, panel, small_places, states, with_sql
from .q_windows import busday_sql
from .registry import query


@query(
    "ag1_belt_mean",
    with_sql(OBS) + """SELECT belt, d, avg(tmax) AS tmax, avg(rain) AS rain, max(pub) AS pub, count(DISTINCT point) AS members FROM obs GROUP BY 1, 2""",
    d="tmax rain",
)
def _(t):
    return AG.belt_mean(obs(t), ["belt"], "d", ["tmax", "rain"], "point", "pub")


@query(
    "ag2_nested_mean",
    with_sql(OBS) + """, s AS (SELECT belt, state, d, avg(tmax) AS tmax, avg(rain) AS rain, max(pub) AS pub FROM obs GROUP BY 1, 2, 3)
    SELECT belt, d, avg(tmax) AS tmax, avg(rain) AS rain, max(pub) AS pub, count(*) AS groups FROM s GROUP BY 1, 2""",
    d="tmax rain",
)
def _(t):
    return AG.nested_mean(obs(t), ["belt", "state", "d"], ["belt", "d"], ["tmax", "rain"], "pub")


# A state that reported no rain has no publication date: the forced NULL of the strict rules.
SPARSE = BELT + """, sparse AS (SELECT belt, state, d, tmax, rain, CASE WHEN rain > 0 THEN pub END AS pub FROM belt_state),
    size AS (SELECT r_name AS belt, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""


def sparse(t):
    return belt_state(t).withColumn("pub", F.when(F.col("rain") > 0, F.col("pub")))


def size(t):
    return states(t).groupBy("belt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag3_strict_belt_mean",
    with_sql(SPARSE) + """
    SELECT belt, d, avg(tmax) AS tmax, avg(rain) AS rain, max(pub) AS pub FROM sparse JOIN size USING (belt)
    GROUP BY belt, d, n HAVING count(*) FILTER (tmax IS NOT NULL AND rain IS NOT NULL AND pub IS NOT NULL) = n""",
    d="tmax rain",
)
def _(t):
    return AG.strict_belt_mean(sparse(t), ["belt"], "d", ["tmax", "rain"], "pub", F.broadcast(size(t)), "n").select(
        "belt", "d", "tmax", "rain", "pub"
    )


AG4_HOLES = "CASE WHEN (point + month(month)) % 37 = 0 THEN NULL ELSE rain END AS rain, CASE WHEN (point + year(month)) % 41 = 0 AND month > DATE '1995-06-01' THEN NULL ELSE month + 40 END AS pub"


@query(
    "ag4_strict_nested_mean",
    with_sql(OBS) + f""", m0 AS (SELECT belt, state, point, CAST(date_trunc('month', d) AS DATE) AS month, avg(rain) AS rain FROM obs GROUP BY 1, 2, 3, 4),
    m AS (SELECT belt, state, point, month, {AG4_HOLES} FROM m0),
    ref AS (SELECT belt, state, point FROM m WHERE (belt, month) IN (SELECT (belt, min(month)) FROM m GROUP BY belt)),
    n AS (SELECT belt, state, count(*) AS n FROM ref GROUP BY 1, 2),
    c AS (SELECT m.belt, m.state, m.month, avg(rain) AS rain, max(pub) AS pub, n.n FROM m JOIN ref USING (belt, state, point) JOIN n ON n.belt = m.belt AND n.state = m.state
      GROUP BY 1, 2, 3, n.n HAVING count(*) = n.n AND count(rain) = n.n AND count(pub) = n.n)
    SELECT belt, month, avg(rain) AS rain, max(pub) AS pub FROM c GROUP BY belt, month
    HAVING count(*) = (SELECT count(*) FROM n WHERE n.belt = c.belt)""",
    d="rain",
)
def _(t):
    m = obs(t).groupBy("belt", "state", "point", F.trunc("d", "month").alias("month")).agg(F.avg("rain").alias("rain"))
    # some values and some publication dates are taken away, by place and month
    rain = F.when((F.col("point") + F.month("month")) % 37 != 0, F.col("rain"))
    late = ((F.col("point") + F.year("month")) % 41 == 0) & (F.col("month") > F.lit("1995-06-01").cast("date"))
    m = m.select("belt", "state", "point", "month", rain.alias("rain"), F.when(~late, F.date_add("month", 40)).alias("pub"))
    return AG.strict_nested_mean(m, "belt", "state", "point", "month", "rain", "pub").select("belt", "month", "rain", "pub")


@query(
    "ag5_publication_audit",
    with_sql(SPARSE) + """
    SELECT belt, d, count(*) AS rows, count(pub) AS published, count(DISTINCT state) AS members,
      count(*) = count(pub) AND count(DISTINCT state) = n AS complete FROM sparse JOIN size USING (belt) GROUP BY belt, d, n""",
)
def _(t):
    return AG.publication_audit(sparse(t), ["belt"], "d", "pub", "state", F.broadcast(size(t)), "n")


@query(
    "ag6_pivot_fixed",
    """SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent,
      avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low, CAST(NULL AS DOUBLE) AS never FROM orders GROUP BY 1""",
    d="urgent low never",
)
def _(t):
    o = t.orders.select(F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority", "o_totalprice")
    return AG.pivot_fixed(o, ["d"], "o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low", "6-NEVER": "never"}, "o_totalprice")


# A forecast run per belt and day: leads are line numbers, sub-daily steps are quantity quarters.
RUNS = """runs AS (
  SELECT r_name AS belt, CAST(date_trunc('week', l_shipdate) AS DATE) AS run, CAST(l_linenumber AS BIGINT) AS lead_day,
    CAST(floor((l_quantity - 1) / 12.5) AS BIGINT) AS step, l_suppkey AS point,
    CAST(round(l_discount * 100) AS BIGINT) AS tmax, CAST(round(l_tax * 100) AS BIGINT) AS tmin, CAST(l_quantity AS BIGINT) AS rain
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def runs(t):
    return t.lineitem.withColumnRenamed("l_suppkey", "point").join(small_places(t), "point").select(
        "belt", F.to_date(F.date_trunc("week", "l_shipdate")).alias("run"), F.col("l_linenumber").cast("long").alias("lead_day"),
        F.floor((F.col("l_quantity") - 1) / 12.5).alias("step"), "point",
        cents("l_discount").alias("tmax"), cents("l_tax").alias("tmin"), F.col("l_quantity").cast("long").alias("rain"),
    )


ROLL = """, days AS (SELECT belt, run, lead_day, max(tmax) AS tmax, min(tmin) AS tmin, CAST(sum(rain) AS BIGINT) AS rain
      FROM runs GROUP BY 1, 2, 3 HAVING count(DISTINCT step) = 4)"""


def lead_days(t):
    return AG.rollup_intervals(
        runs(t), ["belt", "run", "lead_day"], "step",
        {"tmax": ("tmax", "max"), "tmin": ("tmin", "min"), "rain": ("rain", "sum")}, 4,
    )


@query("ag7_rollup_intervals", with_sql(RUNS) + ROLL + "SELECT * FROM days", i="tmax tmin")
def _(t):
    return lead_days(t)


@query(
    "ag8_horizon_windows",
    with_sql(RUNS) + ROLL + """
    SELECT belt, run, avg(tmax) FILTER (lead_day BETWEEN 1 AND 3) AS d1_3_tmax_mean, CAST(sum(rain) FILTER (lead_day BETWEEN 1 AND 3) AS BIGINT) AS d1_3_rain_sum,
      avg(tmax) FILTER (lead_day BETWEEN 4 AND 7) AS d4_7_tmax_mean, CAST(sum(rain) FILTER (lead_day BETWEEN 4 AND 7) AS BIGINT) AS d4_7_rain_sum
    FROM days GROUP BY 1, 2 HAVING count(DISTINCT lead_day) FILTER (lead_day BETWEEN 1 AND 3) = 3
      AND count(DISTINCT lead_day) FILTER (lead_day BETWEEN 4 AND 7) = 4""",
    d="d1_3_tmax_mean d4_7_tmax_mean",
)
def _(t):
    return AG.horizon_windows(
        lead_days(t), ["belt", "run"], "lead_day", [(1, 3), (4, 7)], {"tmax_mean": ("tmax", "avg"), "rain_sum": ("rain", "sum")}
    )


# Crop year October..September; tmin is missing for one belt.
CAL = [(m, -1) for m in (10, 11, 12)] + [(m, 0) for m in range(1, 10)]
WINDOW = BELT + """, w0 AS (SELECT *, CAST(CASE WHEN month(d) >= 10 THEN year(d) + 1 ELSE year(d) END AS BIGINT) AS crop_year,
      CASE WHEN belt <> 'EUROPE' THEN tmin END AS tn FROM belt_state),
    w1 AS (SELECT *, row_number() OVER (PARTITION BY belt, state, crop_year ORDER BY d) AS pos FROM w0),
    w AS (SELECT *, pos - coalesce(max(CASE WHEN NOT rain < 1.0 THEN pos END) OVER (PARTITION BY belt, state, crop_year ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS run FROM w1),
    meas AS (SELECT belt, state, crop_year, sum(rain) AS rain_sum, count(*) FILTER (rain < 1.0) AS dry_days, max(run) AS max_dry_spell, count(*) FILTER (rain > 8.0) AS wet_days,
      count(*) FILTER (tmax > 29.0) AS heat_days, sum(greatest(tmax - 29.0, 0.0)) AS heat_dd, avg(tmax) AS tmax_mean,
      CASE WHEN count(tn) > 0 THEN count(*) FILTER (tn < 2.0) END AS frost_days, min(tn) AS min_tmin, count(*) AS days
    FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 12 * 10)"""


def measures(t):
    rows = belt_state(t).withColumn("tn", F.when(F.col("belt") != "EUROPE", F.col("tmin")))
    return AG.window_measures(
        rows, ["belt", "state"], "d", CAL, tmax="tmax", tmin="tn", rain="rain", heat=29.0, frost=2.0, dry=1.0, wet=8.0, min_days=10
    )


@query("ag9_window_measures", with_sql(WINDOW) + "SELECT * FROM meas", d="rain_sum heat_dd tmax_mean min_tmin")
def _(t):
    return measures(t)


@query(
    "ag10_combine_points",
    with_sql(WINDOW) + """, size AS (SELECT r_name AS belt, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT belt, crop_year, min(min_tmin) AS min_tmin, CAST(max(frost_days) AS DOUBLE) AS frost_days, max(max_dry_spell) AS max_dry_spell, avg(heat_dd) AS heat_dd, avg(heat_days) AS heat_days,
      avg(tmax_mean) AS tmax_mean, avg(rain_sum) AS rain_sum, avg(dry_days) AS dry_days, avg(wet_days) AS wet_days, avg(days) AS days, count(*) AS points
    FROM meas JOIN size USING (belt) GROUP BY belt, crop_year, n HAVING count(*) = n""",
    d="min_tmin frost_days max_dry_spell heat_dd heat_days tmax_mean rain_sum dry_days wet_days days",
)
def _(t):
    return AG.combine_points(measures(t), ["belt"], "crop_year", AG.POINT_RULES, F.broadcast(size(t)), "n")


YEARLY = """, aw AS (SELECT k, CAST(year(d) AS BIGINT) AS year, sum(greatest(tmax - 29.0, 0.0)) FILTER (month(d) BETWEEN 4 AND 10) AS heat_season,
      sum(greatest(tmax - 29.0, 0.0)) FILTER (month(d) = 7) AS heat_peak, avg(tmax) FILTER (month(d) = 7) AS tmax_peak,
      sum(rain) FILTER (month(d) BETWEEN 6 AND 8) AS rain_summer, count(*) FILTER (month(d) BETWEEN 4 AND 10) AS days FROM belt GROUP BY 1, 2),
    ad AS (SELECT k, CAST(year(d) AS BIGINT) AS year, max(tmin) AS peak, avg(tmin) AS mean, count(*) AS maps FROM belt WHERE month(d) BETWEEN 4 AND 10 GROUP BY 1, 2)"""


def yearly_weather(t):
    return AG.annual_weather(
        belt(t), ["k"], "d", "tmax", "rain", heat=29.0, season=range(4, 11), peak=7, summer=(6, 7, 8)
    )


def yearly_drought(t):
    return AG.annual_peak(belt(t), ["k"], "d", "tmin", range(4, 11))


@query("ag11_annual_weather", with_sql(BELT) + YEARLY + "SELECT * FROM aw", d="heat_season heat_peak tmax_peak rain_summer")
def _(t):
    return yearly_weather(t)


@query("ag12_annual_peak", with_sql(BELT) + YEARLY + "SELECT * FROM ad", d="peak mean")
def _(t):
    return yearly_drought(t)


@query(
    "ag13_annual_table",
    with_sql(ANNUAL) + YEARLY + """
    SELECT aw.k, aw.year, heat_season, rain_summer, ad.peak AS drought, yield_year.yield FROM aw JOIN ad ON aw.k = ad.k AND aw.year = ad.year
    JOIN yield_year ON yield_year.k = aw.k AND yield_year.year = aw.year WHERE aw.days >= 180 AND ad.maps >= 25""",
    d="heat_season rain_summer drought yield",
)
def _(t):
    y = annual_yield(t)
    return AG.annual_table(yearly_weather(t), yearly_drought(t), y, ["k", "year"], 180, 25).select(
        "k", "year", "heat_season", "rain_summer", F.col("peak").alias("drought"), "yield"
    )


def annual_yield(t):
    return ordk(t).groupBy("k", F.year("d").alias("year")).agg(
        (F.sum(cents("price")).cast("double") / (F.lit(100000.0) * F.count(F.lit(1)))).alias("yield")
    )


SHARES = """prod AS (SELECT o_orderpriority AS member, CAST(year(o_orderdate) AS BIGINT) AS year,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS production,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS rate FROM orders GROUP BY 1, 2)"""


def prod(t):
    c = F.sum(cents("o_totalprice")).cast("double")
    return t.orders.groupBy(F.col("o_orderpriority").alias("member"), F.year("o_orderdate").alias("year")).agg(
        (c / 100.0).alias("production"), (c / (F.lit(100.0) * F.count(F.lit(1)))).alias("rate")
    )


@query(
    "ag14_ratio_of_sums",
    with_sql(SHARES) + """SELECT year, count(DISTINCT member) AS members, sum(production) / sum(production / rate) AS rate
    FROM prod GROUP BY 1 HAVING count(DISTINCT member) = 5""",
    d="rate",
)
def _(t):
    return AG.ratio_of_sums(prod(t), ["year"], "production", "rate", "member", 5)


@query(
    "ag15_weighted_measures",
    with_sql(BELT) + """, w AS (SELECT n_name AS state, sum(s_acctbal + 1000.0) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT belt, d, sum(tmax * w) / sum(w) AS tmax, sum(wet * w) / nullif(sum(w) FILTER (wet IS NOT NULL), 0) AS wet
    FROM (SELECT *, CASE WHEN rain > 0 THEN rain END AS wet FROM belt_state) JOIN w USING (state) GROUP BY 1, 2""",
    d="tmax wet",
)
def _(t):
    w = t.supplier.groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal") + 1000.0).alias("w"))
    w = states(t).join(w, "s_nationkey").select("state", "w")
    rows = belt_state(t).withColumn("wet", F.when(F.col("rain") > 0, F.col("rain"))).join(F.broadcast(w), "state")
    return AG.weighted_measures(rows, ["belt", "d"], ["tmax", "wet"], "w")


@query(
    "ag16_share_of_total",
    with_sql(SHARES) + "SELECT member, year, production / sum(production) OVER (PARTITION BY year) AS share FROM prod",
    d="share",
)
def _(t):
    return AG.share_of_total(prod(t), ["year"], "production", "share").select("member", "year", "share")


@query(
    "ag17_balanced_daily",
    with_sql(OBS) + """, c AS (SELECT belt, state, d, round(avg(tmax), 9) AS tmax, round(avg(rain), 9) AS rain, max(pub) AS pub FROM obs GROUP BY 1, 2, 3)
    SELECT belt, d, avg(tmax) AS tmax, avg(rain) AS rain, avg(CASE WHEN rain < 2 THEN 1.0 ELSE 0.0 END) AS dry_share,
      avg(CASE WHEN rain > 8 THEN 1.0 ELSE 0.0 END) AS wet_share, avg(greatest(tmax - 29.0, 0.0)) AS heat_excess, max(pub) AS pub, count(*) AS countries
    FROM c GROUP BY 1, 2""",
    d="tmax rain dry_share wet_share heat_excess",
)
def _(t):
    return AG.balanced_daily(obs(t), ["belt"], "state", "d", "tmax", "rain", "pub", dry=2.0, wet=8.0, heat=29.0)


@query(
    "ag18_worst_point_daily",
    with_sql(OBS) + "SELECT belt, d, min(tmin) AS tmin, avg(tmax) AS tmax, avg(rain) AS rain, max(pub) AS pub, count(*) AS points FROM obs GROUP BY 1, 2",
    d="tmin tmax rain",
)
def _(t):
    return AG.worst_point_daily(obs(t), ["belt"], "d", "tmin", "tmax", "rain", "pub")


@query(
    "ag19_single_value",
    """SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus,
      count(DISTINCT l_returnflag) <= 1 AND count(DISTINCT l_linestatus) <= 1 AS consistent FROM lineitem GROUP BY 1""",
)
def _(t):
    return AG.single_value(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(
    "ag20_release_features",
    """SELECT release, good, poor, good - poor AS balance, good - g1 AS good_vs_week, poor - p1 AS poor_vs_week, good - g2 AS good_vs_year, poor - p2 AS poor_vs_year FROM (
      SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS release,
        sum(1) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS good,
        sum(1) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS poor,
        sum(1) FILTER (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS g1,
        sum(1) FILTER (o_orderstatus = 'O' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS p1,
        sum(1) FILTER (o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS g2,
        sum(1) FILTER (o_orderstatus = 'P' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS p2
      FROM orders GROUP BY 1)""",
    i="good poor balance good_vs_week poor_vs_week good_vs_year poor_vs_year",
)
def _(t):
    o = t.orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("release"), "o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )
    f = AG.release_features(
        o, ["release"], "o_orderstatus", "o_orderpriority", "n", ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"],
        {"week": "O", "year": "P"}, "F",
    )
    return f


@query(
    "ag21_rate_summary",
    """SELECT l_returnflag AS root, CAST(year(l_shipdate) AS BIGINT) AS year, count(DISTINCT l_shipdate) AS dates, count(DISTINCT l_tax) AS rates,
      min(l_tax) AS min_rate, median(l_tax) AS median_rate, max(l_tax) AS max_rate FROM lineitem GROUP BY 1, 2""",
    d="min_rate median_rate max_rate",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("root"), F.year("l_shipdate").alias("year"), F.col("l_shipdate").cast("date").alias("d"), "l_tax"
    )
    return AG.rate_summary(rows, ["root", "year"], "d", "l_tax")


@query(
    "ag22_resample_month",
    with_sql(DAILY) + "SELECT k, CAST(date_trunc('month', d) AS DATE) AS month, CAST(sum(n) AS BIGINT) AS n, arg_max(px, d) AS px FROM daily GROUP BY 1, 2",
    d="px",
)
def _(t):
    return AG.resample_month(daily(t), ["k"], "d", "n", "px")


@query(
    "ag23_panel_profile",
    with_sql(PANEL) + """SELECT root, count(*) AS rows, min(d) AS first, max(d) AS last, count(DISTINCT year(d)) AS years,
      string_agg(DISTINCT substr(contract, 2, 1), '' ORDER BY substr(contract, 2, 1)) AS codes FROM panel GROUP BY 1""",
)
def _(t):
    return AG.panel_profile(panel(t), ["root"], "d", "contract")


@query(
    "ag24_index_to_base",
    with_sql(DAILY) + """, b AS (SELECT k, avg(px) AS base FROM daily WHERE year(d) BETWEEN 1995 AND 1997 GROUP BY 1)
    SELECT k, CAST(year(d) AS BIGINT) AS year, avg(px) / any_value(base) AS index FROM daily JOIN b USING (k) GROUP BY 1, 2""",
    d="index",
)
def _(t):
    return AG.index_to_base(daily(t), ["k"], "d", "px", (1995, 1997))


# ------------------------------------------------------------------ set operations


@query(
    "so1_stack",
    """SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(NULL AS BIGINT) AS qty, 'ordered' AS sample FROM orders GROUP BY 1
    UNION ALL SELECT CAST(l_shipdate AS DATE), NULL, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 'shipped' FROM lineitem GROUP BY 1""",
)
def _(t):
    a = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum(cents("o_totalprice")).alias("cents"))
    b = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return SO.stack({"ordered": a, "shipped": b}, "sample")


@query(
    "so2_set_check",
    """SELECT d, 'unknown' AS problem FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)
    UNION ALL SELECT d, 'missing' FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem)""",
)
def _(t):
    seen = t.lineitem.select(F.col("l_shipdate").cast("date").alias("d"))
    return SO.set_check(seen, "d", t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct())


@query("so3_distinct_sorted", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem ORDER BY 1")
def _(t):
    return SO.distinct_sorted(t.lineitem.select(F.col("l_shipdate").cast("date").alias("d")), "d")


@query(
    "so4_common_cohort",
    with_sql(BELT) + """, m AS (SELECT k, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, count(*) AS days FROM belt GROUP BY 1, 2, 3)
    SELECT m.* FROM m WHERE (k, year) IN (SELECT (k, year) FROM m WHERE days >= 22 GROUP BY k, year HAVING count(*) = 12)""",
)
def _(t):
    m = belt(t).groupBy("k", F.year("d").alias("year"), F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("days"))
    m = m.withColumn("complete", F.col("days") >= 22)
    return SO.common_cohort(m, ["k", "year"], "month", "complete", 12).drop("complete")


@query(
    "so5_overlap_counts",
    with_sql(BELT) + """, x AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(DISTINCT k) AS members FROM belt WHERE tmax > 35 GROUP BY 1)
    SELECT members, count(*) AS items FROM x GROUP BY 1""",
)
def _(t):
    hot = belt(t).filter("tmax > 35").select("k", F.to_date(F.date_trunc("week", "d")).alias("week"))
    return SO.overlap_counts(hot, "k", "week")
