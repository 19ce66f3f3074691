"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as AU
from tidemark.operators import windows as WN
from tidemark.operators.common import dealt_by_rows

from .base import BELT, ORDK, PANEL, belt, grid, panel, with_sql
from .q_folds import WFRAME, frame
from .q_windows import busday_sql
from .registry import query

TICKS, LETTERS = {"A": 25.0, "N": 1.0}, {"A": "MNQUVXZ", "N": "MNUZ"}

# Single-trade sessions lack a margin.
AUD = PANEL + """, ap AS (SELECT *, CASE WHEN oi > 1 THEN 1500.0 END AS margin, coalesce(CAST(d AS VARCHAR), '?') || ' | ' || root || ' | ' || contract AS e, CASE root WHEN 'A' THEN 25.0 WHEN 'N' THEN 1.0 END AS tick FROM panel),
ff AS (SELECT *, high_cents < open_cents OR low_cents > open_cents OR low_cents > high_cents AS bad FROM ap),
v AS (SELECT 'ERROR' AS severity, 'UNKNOWN_ROOT' AS code, e FROM ff WHERE tick IS NULL
  UNION ALL SELECT 'ERROR', 'INVALID_OHLC', e FROM ff WHERE bad
  UNION ALL SELECT 'INFO', 'SETTLEMENT_OUTSIDE_RANGE', e FROM ff WHERE NOT bad AND (settle_cents > high_cents OR settle_cents < low_cents)
  UNION ALL SELECT 'ERROR', 'AFTER_LAST_TRADE', e FROM ff WHERE d > expiry
  UNION ALL SELECT 'ERROR', 'INVALID_CONTRACT_CODE', e FROM ff WHERE root = 'N' AND substr(contract, 2, 1) NOT IN ('M', 'N', 'U', 'Z')
  UNION ALL SELECT 'WARNING', 'OFF_TICK_PRICE', e FROM ff WHERE abs(open_cents / tick - round(open_cents / tick)) > 1e-6 OR abs(high_cents / tick - round(high_cents / tick)) > 1e-6
    OR abs(low_cents / tick - round(low_cents / tick)) > 1e-6 OR abs(settle_cents / tick - round(settle_cents / tick)) > 1e-6
  UNION ALL SELECT 'BLOCKER', 'INVALID_MARGIN', e FROM ff WHERE margin IS NULL),
c AS (SELECT severity, code, count(*) AS rows FROM v GROUP BY 1, 2),
x AS (SELECT code, string_agg(e, ' ; ' ORDER BY e) AS examples FROM (SELECT code, e, row_number() OVER (PARTITION BY code ORDER BY e) AS r FROM v) WHERE r <= 3 GROUP BY 1)"""


@query(
    "au1_audit_panel",
    with_sql(AUD) + "SELECT severity, code, rows, examples FROM c JOIN x USING (code) UNION ALL SELECT 'ERROR', 'MISSING_ROOTS', 1, 'Z'",
)
def _(t):
    p = panel(t).withColumn("margin", F.when(F.col("oi") > 1, 1500.0))
    return AU.audit_panel(p, "root", ["d", "root", "contract"], AU.panel_rules("root", TICKS, LETTERS), ["A", "N", "R", "Z"])


@query(
    "au1_audit_without_columns",
    with_sql(AUD) + """SELECT severity, code, rows, examples FROM c JOIN x USING (code) WHERE code <> 'INVALID_MARGIN' UNION ALL SELECT 'ERROR', 'MISSING_ROOTS', 1, 'Z'
    UNION ALL SELECT 'BLOCKER', 'MISSING_MARGIN', count(*), NULL FROM panel UNION ALL SELECT 'WARNING', 'MISSING_VOLUME', count(*), NULL FROM panel
    UNION ALL SELECT 'WARNING', 'MISSING_OPEN_INTEREST', count(*), NULL FROM panel""",
)
def _(t):
    p = panel(t).drop("volume", "oi")
    return AU.audit_panel(p, "root", ["d", "root", "contract"], AU.panel_rules("root", TICKS, LETTERS), ["A", "N", "R", "Z"])


@query(
    "au2_session_gaps",
    with_sql(PANEL) + f""", g AS (SELECT root, contract, d, lag(d) OVER (PARTITION BY root, contract ORDER BY d) AS previous FROM panel),
    b AS (SELECT *, CAST({busday_sql('previous', 'd')} AS BIGINT) - 1 AS missing_days FROM g WHERE previous IS NOT NULL)
    SELECT * FROM b WHERE missing_days > 0""",
)
def _(t):
    return AU.session_gaps(panel(t), ["root", "contract"], "d")


@query(
    "au3_check_ladder",
    """WITH g AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (o_orderpriority > '2') AS a, count(*) FILTER (o_orderpriority > '3') AS b, count(*) FILTER (o_orderpriority >= '5') AS c FROM orders GROUP BY 1),
    l AS (SELECT d, floor(100.0 * (n - a) / n) AS none, floor(100.0 * a / n) AS d0, floor(100.0 * b / n) AS d1, floor(100.0 * c / n) AS d2 FROM g)
    SELECT * FROM l WHERE abs(none + d0 - 100) > 0.5 OR d1 > d0 + 0.5 OR d2 > d1 + 0.5""",
    d="none d0 d1 d2",
)
def _(t):
    p = F.col("o_orderpriority")
    g = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((p > "2").cast("int")).alias("a"), F.sum((p > "3").cast("int")).alias("b"), F.sum((p >= "5").cast("int")).alias("c")
    )
    share = lambda c: F.floor(F.lit(100.0) * c / F.col("n")).cast("double")
    rungs = g.select(
        "d", share(F.col("n") - F.col("a")).alias("none"), share(F.col("a")).alias("d0"), share(F.col("b")).alias("d1"), share(F.col("c")).alias("d2")
    )
    return AU.check_ladder(rungs, "none", ["d0", "d1", "d2"], 0.5)


@query(
    "au4_check_shares",
    """WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2, 3),
    f AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY m, s)) AS v FROM c),
    g AS (SELECT m, s, sum(v) AS total, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT m, s, total, CASE WHEN n = 5 AND abs(total - 100) > 0.01 THEN CASE WHEN s = 'F' THEN 'aggregate sum' ELSE 'source sum' END ELSE 'ok' END AS status FROM g""",
    d="total",
)
def _(t):
    c = t.orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("m", "s").agg(F.sum("n").alias("t"))
    f = c.join(total, ["m", "s"]).withColumn("v", F.round(F.lit(100.0) * F.col("n") / F.col("t")))
    return AU.check_shares(f, ["m", "s"], "v", 5, F.col("s") == "F")


@query(
    "au5_check_unique",
    """WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS rows, CAST(l_orderkey AS VARCHAR) || ' | ' || CAST(l_linenumber AS VARCHAR) AS e FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT count(*) AS identities, CAST(sum(rows) AS BIGINT) AS rows, (SELECT string_agg(e, ' ; ' ORDER BY e) FROM (SELECT e FROM d ORDER BY e LIMIT 3)) AS examples FROM d""",
)
def _(t):
    return AU.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("au5_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", i="l_linenumber")
def _(t):
    return AU.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "au6_check_frame",
    with_sql(WFRAME) + """SELECT k, count(*) AS rows, count(*) FILTER (d + 1 <= d) AS entry_not_after_decision, count(*) FILTER (exit_date <= d + 7) AS exit_not_after_entry, count(*) FILTER (abs(target) / 100 <= 0.001) AS cost_not_positive,
      2 AS missing_years FROM wf GROUP BY 1""",
    i="missing_years",
)
def _(t):
    x = frame(t).select(
        "k", "d", F.date_add("d", 1).alias("entry"), F.date_sub("exit_date", 6).alias("exit"), (F.abs(F.col("target")) / 100 - 0.001).alias("cost"), "year"
    )
    return AU.check_frame(x, ["k"], "d", "entry", "exit", "cost", "year", range(1994, 2003))


@query(
    "au7_check_leads",
    """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN '610' WHEN 'N' THEN '814' ELSE 'xxx' END AS product, l_shipdate::DATE - o_orderdate::DATE AS lead, l_shipdate::DATE - o_orderdate::DATE + CASE WHEN l_linenumber < 6 THEN CASE l_returnflag WHEN 'A' THEN 4 ELSE 6 END ELSE 1 END AS hi
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT product, CASE WHEN product = 'xxx' THEN 'unknown product' WHEN (product = '610' AND lead = 6 AND hi = 10) OR (product = '814' AND lead = 8 AND hi = 14) THEN 'ok' ELSE 'mislabelled' END AS verdict, count(*) AS rows FROM x GROUP BY 1, 2""",
)
def _(t):
    product = F.when(F.col("l_returnflag") == "A", "610").when(F.col("l_returnflag") == "N", "814").otherwise("xxx")
    length = F.when(F.col("l_linenumber") < 6, F.when(F.col("l_returnflag") == "A", 4).otherwise(6)).otherwise(1)
    start = F.col("l_shipdate").cast("date")
    lines, orders = dealt_by_rows(t.lineitem.count(), (t.lineitem, "l_orderkey"), (t.orders, "o_orderkey"))
    x = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        product.alias("product"), F.col("o_orderdate").cast("date").alias("issued"), start.alias("start"), F.date_add(start, length).alias("end")
    )
    return AU.check_leads(x, "product", "issued", "start", "end", {"610": (6, 10), "814": (8, 14)})


def cov_sql() -> str:
    cells = []
    for c, kind in (("tmax", "feature"), ("hot", "feature"), ("never", "feature"), ("fwd5", "target")):
        cells.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS filled, count(*) - count({c}) AS unfilled, min(CASE WHEN {c} IS NOT NULL THEN d END) AS first_date, max(CASE WHEN {c} IS NOT NULL THEN d END) AS last_date FROM p")
    return " UNION ALL ".join(cells)


@query(
    "au8_coverage_report",
    with_sql(BELT, ORDK) + """, p AS (SELECT g.d, b.tmax, CASE WHEN b.tmax > 40 THEN b.tmax END AS hot, CAST(NULL AS DOUBLE) AS never, lead(px, 5) OVER (PARTITION BY g.k ORDER BY g.d) / px - 1 AS fwd5 FROM grid g LEFT JOIN belt b ON b.k = g.k AND b.d = g.d) """ + cov_sql(),
)
def _(t):
    p = grid(t).join(belt(t).select("k", "d", "tmax"), ["k", "d"], "left")
    p = p.withColumn("hot", F.when(F.col("tmax") > 40, F.col("tmax"))).withColumn("never", F.lit(None).cast("double"))
    p = p.withColumn("fwd5", WN.forward_return(["k"], "d", "px", 5))
    return AU.coverage_report(p, "d", ["tmax", "hot", "never"], ["fwd5"])
