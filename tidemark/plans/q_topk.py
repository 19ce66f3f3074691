"""Top-n, thinning and choice queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import topk as TK
from tidemark.operators import windows as WN

from .base import DAILY, PANEL, daily, panel, with_sql
from .registry import query


@query(
    "tk1_top_n",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 5""",
    d="l_extendedprice", i="l_linenumber",
)
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return TK.top_n(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5)


WEEKLY = """idx AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS idx FROM daily),
dec AS (SELECT k, CAST(date_trunc('week', d + 2) AS DATE) + 4 AS wk, max(d) AS d, max(idx) AS idx FROM idx GROUP BY 1, 2)"""


def decisions(t):
    idx = daily(t).select("k", "d", F.row_number().over(W.partitionBy("k").orderBy("d")).alias("idx"))
    return WN.last_of_period(idx, ["k"], S.week_fri("d"), "d", ["idx"]).select("k", "d", "idx")


@query(
    "tk2_thin_rows",
    """WITH RECURSIVE """ + DAILY + ", " + WEEKLY + """,
    n AS (SELECT k, d, idx, row_number() OVER (PARTITION BY k ORDER BY idx) AS rn FROM dec),
    r AS (SELECT k, d, idx, rn, idx AS last, true AS keep FROM n WHERE rn = 1
      UNION ALL SELECT n.k, n.d, n.idx, n.rn, CASE WHEN n.idx >= r.last + 12 THEN n.idx ELSE r.last END, n.idx >= r.last + 12 FROM r JOIN n ON n.k = r.k AND n.rn = r.rn + 1)
    SELECT k, d, idx FROM r WHERE keep""",
)
def _(t):
    return TK.thin_rows(decisions(t), ["k"], "idx", 12)


LEDGER = """led AS (SELECT k, d AS entry, lead(d, 7) OVER (PARTITION BY k ORDER BY d) AS exit, CASE WHEN px > 280000 THEN 1 WHEN px < 220000 THEN -1 ELSE 0 END AS signal FROM daily)"""


def ledger(t):
    pos = F.when(F.col("px") > 280000, 1).when(F.col("px") < 220000, -1).otherwise(0)
    return daily(t).select("k", F.col("d").alias("entry"), F.lead("d", 7).over(W.partitionBy("k").orderBy("d")).alias("exit"), pos.alias("signal"))


@query(
    "tk3_no_overlap",
    "WITH RECURSIVE " + DAILY + ", " + LEDGER + """,
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY entry) AS rn FROM led WHERE exit IS NOT NULL),
    r AS (SELECT k, entry, exit, signal, rn, signal AS executed, CASE WHEN signal <> 0 THEN exit END AS last FROM n WHERE rn = 1
      UNION ALL SELECT n.k, n.entry, n.exit, n.signal, n.rn, CASE WHEN n.signal <> 0 AND (r.last IS NULL OR n.entry > r.last) THEN n.signal ELSE 0 END,
        CASE WHEN n.signal <> 0 AND (r.last IS NULL OR n.entry > r.last) THEN n.exit ELSE r.last END FROM r JOIN n ON n.k = r.k AND n.rn = r.rn + 1)
    SELECT k, entry, exit, CAST(signal AS BIGINT) AS signal, CAST(executed AS BIGINT) AS executed FROM r""",
)
def _(t):
    return TK.no_overlap(ledger(t).filter("exit IS NOT NULL"), ["k"], "entry", "exit", "signal")


@query(
    "tk4_pick_best",
    """WITH c AS (SELECT l_returnflag, l_suppkey, avg(l_discount - 0.05) / nullif(stddev_samp(l_discount), 0) AS sharpe, CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS net,
      count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY 1, 2),
    d AS (SELECT l_returnflag, l_suppkey, CASE WHEN n > 80 THEN round(sharpe, 9) END AS sharpe, net FROM c)
    SELECT l_returnflag, l_suppkey, sharpe, net FROM d QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY sharpe DESC NULLS LAST, net DESC, l_suppkey) = 1""",
    d="sharpe",
)
def _(t):
    c = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(
        S.div(F.avg(F.col("l_discount") - 0.05), F.stddev_samp("l_discount")).alias("s"),
        F.sum(F.floor(F.col("l_discount") * 100 + 0.5).cast("long") - 5).alias("net"),
        F.sum((F.col("l_linestatus") == "F").cast("int")).alias("n"),
    )
    c = c.withColumn("sharpe", F.when(F.col("n") > 80, F.round("s", 9)))
    return TK.pick_best(c, ["l_returnflag"], ["l_suppkey"], "sharpe", "net")


@query(
    "tk5_size_pairs",
    with_sql(PANEL) + """, prices AS (SELECT a.d, a.expiry, a.root AS near, b.root AS far, a.open_cents AS pa, b.open_cents AS pb FROM panel a JOIN panel b ON a.d = b.d AND a.expiry = b.expiry AND a.root < b.root),
    g AS (SELECT d, expiry, near, far, pa, pb, i, j, abs(pa * i - pb * j) / (pa * i + pb * j) AS imbalance FROM prices, generate_series(1, 8) x(i), generate_series(1, 8) y(j) WHERE i * 500.0 + j * 700.0 <= 6000)
    SELECT d, expiry, near, far, i AS qa, j AS qb, imbalance FROM g QUALIFY row_number() OVER (PARTITION BY d, expiry, near, far ORDER BY imbalance, i + j, i) = 1""",
    d="imbalance",
)
def _(t):
    p = panel(t)
    a = p.select("d", "expiry", F.col("root").alias("near"), F.col("open_cents").alias("pa"))
    b = p.select("d", "expiry", F.col("root").alias("far"), F.col("open_cents").alias("pb"))
    j = a.join(b, ["d", "expiry"]).filter("near < far").withColumn("ma", F.lit(500.0)).withColumn("mb", F.lit(700.0))
    size = TK.size_pairs("pa", "pb", 8, ("ma", "mb", 6000.0))
    return j.select("d", "expiry", "near", "far", size.alias("_s")).select("d", "expiry", "near", "far", "_s.qa", "_s.qb", "_s.imbalance")
