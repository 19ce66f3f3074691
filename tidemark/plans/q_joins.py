"""Join and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import joins as JN
from tidemark.operators import spatial
from tidemark.operators import windows as WN

from .base import ANNUAL, BELT, DAILY, LOG, OBS, ORDK, PANEL, annual, belt, belt_state, daily, grid, log, obs, ordk, panel, small_places, states, with_sql
from .q_windows import busday_sql
from .registry import query


@query(
    "jn1_checked_join",
    """SELECT l_orderkey, l_linenumber, count(*) AS n, min(o_orderpriority) AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    i="l_linenumber",
)
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    j = JN.checked_join(t.lineitem.select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("priority"))


@query(
    "jn2_optional_measure",
    """SELECT o_orderkey, o_orderpriority, q.qty FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1) q ON o_orderkey = l_orderkey""",
)
def _(t):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return JN.checked_join(t.orders.select("o_orderkey", "o_orderpriority"), q, ["o_orderkey"], "left")


# Contours are diamonds (some with a diamond hole) around a reading; places are the 25 nations.
POLY = """iss AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS issued, l_quantity * 2 AS cx, round(l_discount * 1000) AS cy, round(l_tax * 200) + 3 AS r,
    l_returnflag = 'R' AS hole, 33.0 + 10 * (l_linenumber % 4) AS probability,
    CASE WHEN l_partkey % 2 = 0 THEN 'Above' ELSE 'Below' END AS category, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS contour FROM lineitem),
pts AS (SELECT n_name AS point, n_nationkey * 4 + 0.5 AS lon, (n_nationkey * 17) % 100 + 0.3 AS lat FROM nation)"""


def contours(t):
    cx, cy = F.col("l_quantity") * 2, S.col(F.floor(F.col("l_discount") * 1000 + 0.5).cast("double"))
    r = F.floor(F.col("l_tax") * 200 + 0.5).cast("double") + 3

    def ring(k):
        return F.array(*[
            F.struct((F.col("cx") + a * F.col("r") * k).alias("lon"), (F.col("cy") + b * F.col("r") * k).alias("lat"))
            for a, b in ((-1, 0), (0, -1), (1, 0), (0, 1))
        ])

    p = t.lineitem.select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("issued"), cx.alias("cx"), cy.alias("cy"), r.alias("r"),
        "l_returnflag", (F.lit(33.0) + 10 * (F.col("l_linenumber") % 4)).alias("probability"),
        # probabilities repeat within an issue, with either category
        F.when(F.col("l_partkey") % 2 == 0, "Above").otherwise("Below").alias("category"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("contour"),
    )
    rings = F.when(F.col("l_returnflag") == "R", F.array(ring(1.0), ring(0.5))).otherwise(F.array(ring(1.0)))
    r = F.col("r")
    box = {"x0": F.col("cx") - r, "x1": F.col("cx") + r, "y0": F.col("cy") - r, "y1": F.col("cy") + r}
    return p.select("issued", "contour", rings.alias("rings"), "probability", "category", *[c.alias(n) for n, c in box.items()])


@query(
    "jn3_point_in_polygon",
    with_sql(POLY) + """, hit AS (
      SELECT issued, point, probability, category, row_number() OVER (PARTITION BY issued, point ORDER BY probability DESC, contour) AS place FROM iss, pts
      WHERE abs(lon - cx) + abs(lat - cy) < r AND NOT (hole AND abs(lon - cx) + abs(lat - cy) < r / 2)),
    asked AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS issued, n_name AS point FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT a.issued, a.point, h.probability, coalesce(h.category, 'Normal') AS category, h.category IS NOT NULL AS covered
    FROM asked a LEFT JOIN hit h ON h.issued = a.issued AND h.point = a.point AND h.place = 1""",
    d="probability",
)
def _(t):
    pts = t.nation.select(
        F.col("n_name").alias("point"), (F.col("n_nationkey") * 4 + 0.5).alias("lon"), ((F.col("n_nationkey") * 17) % 100 + 0.3).alias("lat")
    )
    # asked for: the places that shipped something in the week of the issue
    homes = small_places(t).select(F.col("point").alias("l_suppkey"), F.col("state").alias("point"))
    asked = t.lineitem.select("l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("issued")).distinct().join(homes, "l_suppkey")
    covered = spatial.point_in_polygon(pts, contours(t), ["issued"], "contour", cell=2.0)
    return spatial.fill_normal(covered, asked.select("issued", "point").distinct(), ["issued"])


@query(
    "jn4_common_sessions",
    """SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""",
)
def _(t):
    p = t.lineitem.select(F.col("l_shipdate").cast("date").alias("d"), F.col("l_returnflag").alias("root"))
    return JN.common_sessions(p, [], "d", "root", ["A", "N", "R"])


RATES = """rates AS (SELECT l_returnflag AS root, CAST(l_shipdate AS DATE) AS d, CAST(l_linenumber AS BIGINT) AS roll, sum(CAST(round(l_tax * 100) AS BIGINT)) + 500.0 AS rate
  FROM lineitem GROUP BY 1, 2, 3)"""


def rates(t):
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("root"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_linenumber").alias("roll")
    ).agg((F.sum(F.floor(F.col("l_tax") * 100 + 0.5).cast("long")) + 500.0).alias("rate"))


@query(
    "jn5_attach_by_rank",
    with_sql(PANEL, RATES) + """, r AS (SELECT root, d, contract, row_number() OVER (PARTITION BY root, d ORDER BY expiry, contract) AS roll FROM panel)
    SELECT r.root, r.d, r.contract, r.roll, rates.rate FROM r LEFT JOIN rates ON r.root = rates.root AND r.d = rates.d AND r.roll = rates.roll""",
    d="rate",
)
def _(t):
    return JN.attach_by_rank(panel(t), rates(t), ["root"], "d", "expiry", "contract", "roll").select("root", "d", "contract", "roll", "rate")


@query(
    "jn5_match_counters",
    with_sql(PANEL, RATES) + """, r AS (SELECT root, d, contract, row_number() OVER (PARTITION BY root, d ORDER BY expiry, contract) AS roll FROM panel)
    SELECT root, count(*) AS input_rows, count(rate) AS matched_rows, count(*) - count(rate) AS unmatched_rows FROM r LEFT JOIN rates USING (root, d, roll) GROUP BY 1""",
)
def _(t):
    return JN.match_counters(JN.attach_by_rank(panel(t), rates(t), ["root"], "d", "expiry", "contract", "roll"), ["root"], "rate")


@query(
    "jn6_complete_groups",
    with_sql(BELT) + """, size AS (SELECT r_name AS belt, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
    ok AS (SELECT belt, d FROM belt_state JOIN size USING (belt) GROUP BY belt, d, n HAVING count(DISTINCT state) = n)
    SELECT b.belt, b.state, b.d, b.tmax FROM belt_state b JOIN ok ON b.belt = ok.belt AND b.d = ok.d""",
    d="tmax",
)
def _(t):
    size = states(t).groupBy("belt").agg(F.count(F.lit(1)).alias("n"))
    return JN.complete_groups(belt_state(t), ["belt", "d"], "state", F.broadcast(size), ["belt"], "n").select("belt", "state", "d", "tmax")


@query(
    "jn7_verify_forecasts",
    with_sql(BELT, ORDK) + """, r AS (SELECT k, d AS valid_start, CASE WHEN count(tmax) OVER w >= 5 THEN avg(tmax) OVER w END AS realised
      FROM belt WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT g.k, g.d AS issued, g.d + 6 AS valid_start, g.px AS anomaly, r.realised FROM grid g LEFT JOIN r ON g.k = r.k AND g.d + 6 = r.valid_start""",
    d="anomaly realised",
)
def _(t):
    fc = grid(t).select("k", F.col("d").alias("issued"), F.date_add("d", 6).alias("valid_start"), F.col("px").alias("anomaly"))
    realised = belt(t).select("k", F.col("d").alias("valid_start"), WN.forward_window(["k"], "d", "tmax", 5).alias("realised"))
    return JN.verify_forecasts(fc, realised, ["k"], "valid_start").select("k", "issued", "valid_start", "anomaly", "realised")


@query(
    "jn8_select_contract",
    with_sql(PANEL) + f""", s AS (SELECT root, d, lead(d, 5) OVER (PARTITION BY root ORDER BY d) AS x FROM (SELECT DISTINCT root, d FROM panel)),
    j AS (SELECT s.root, s.d AS entry_date, s.x AS exit_date, a.contract, a.expiry, a.open_cents AS entry_price, b.open_cents AS exit_price,
        row_number() OVER (PARTITION BY s.root, s.d ORDER BY a.expiry, a.contract) AS rk
      FROM s JOIN panel a ON a.root = s.root AND a.d = s.d JOIN panel b ON b.root = s.root AND b.d = s.x AND b.contract = a.contract
      WHERE {busday_sql('s.x', 'a.expiry')} > 10)
    SELECT root, entry_date, exit_date, contract, expiry, entry_price, exit_price FROM j WHERE rk = 1""",
    d="entry_price exit_price",
)
def _(t):
    from pyspark.sql import Window as W

    p = panel(t)
    s = p.select("root", "d").distinct()
    s = s.select("root", F.col("d").alias("entry_date"), F.lead("d", 5).over(W.partitionBy("root").orderBy("d")).alias("exit_date"))
    return JN.select_contract(p, s, [], "root", "d", "contract", "expiry", "open_cents", "entry_date", "exit_date", 10)


@query(
    "jn9_label_years",
    with_sql(ANNUAL, ORDK) + """, lab AS (SELECT k, year, CASE WHEN heat > 2 THEN 'hot' ELSE 'mild' END AS season FROM annual)
    SELECT g.k, g.d, g.px, lab.season FROM grid g LEFT JOIN lab ON lab.k = g.k AND lab.year = year(g.d)""",
    d="px",
)
def _(t):
    lab = annual(t).select("k", "year", F.when(F.col("heat") > 2, "hot").otherwise("mild").alias("season"))
    pred = grid(t).withColumn("year", F.year("d").cast("long"))
    return JN.label_years(pred, lab, ["k", "year"]).select("k", "d", "px", "season")


@query(
    "jn10_pair_signals",
    with_sql(BELT, ORDK) + """, p AS (SELECT k, year(d) AS year, month(d) AS issue, avg(px) AS predicted FROM grid GROUP BY 1, 2, 3),
    s AS (SELECT k, year(d) AS year, month(d) AS issue, avg(tmax) AS price FROM belt WHERE month(d) BETWEEN 5 AND 9 GROUP BY 1, 2, 3)
    SELECT k, CAST(year AS BIGINT) AS year, CAST(issue AS BIGINT) AS issue, predicted, price FROM p JOIN s USING (k, year, issue)""",
    d="predicted price",
)
def _(t):
    p = grid(t).groupBy("k", F.year("d").alias("year"), F.month("d").alias("issue")).agg(F.avg("px").alias("predicted"))
    s = belt(t).filter(F.month("d").between(5, 9)).groupBy("k", F.year("d").alias("year"), F.month("d").alias("issue")).agg(F.avg("tmax").alias("price"))
    return JN.pair_signals(p, s, ["k", "year", "issue"])


@query(
    "jn11_ledger_status",
    """WITH i AS (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2), o AS (SELECT DISTINCT user_id FROM events)
    SELECT o_orderstatus, count(*) AS decisions, count(*) FILTER (user_id IS NULL) AS pending, count(*) FILTER (user_id IS NOT NULL) AS resolved,
      count(*) FILTER (c > 1) AS duplicated FROM i LEFT JOIN o ON o_custkey = user_id GROUP BY 1""",
)
def _(t):
    dec = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderstatus")
    return JN.ledger_status(dec, t.events.select("user_id"), "user_id", [], "o_orderstatus")


@query(
    "jn11_pending",
    "SELECT o_orderkey, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)",
)
def _(t):
    return JN.pending(t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id")), t.events.select("user_id"), "user_id").select("o_orderkey", "user_id")
