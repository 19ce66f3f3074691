"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import vendor
from tidemark.operators.common import dealt_by_rows

from .base import BELT, PANEL, belt, panel, with_sql
from .q_windows import busday_sql
from .registry import query

FOLD = "trim(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]+', '', 'g')))"
# Texts and names with decomposed accents, letters of the extended ranges and letters without a base.
NAMED = "SELECT {k}, {c} || CASE {k} % 4 WHEN 0 THEN ' Škoda Łódź' WHEN 1 THEN ' Co' || chr(770) || 'te d''Ivoire' WHEN 2 THEN ' Żižkův Ǻ ẞß' ELSE '' END AS {c} FROM {t}"


def named(df, key, c):
    tail = F.when(F.col(key) % 4 == 0, " Škoda Łódź").when(F.col(key) % 4 == 1, " Co\u0302te d'Ivoire").when(F.col(key) % 4 == 2, " Żižkův Ǻ ẞß")
    return df.withColumn(c, F.concat(c, F.coalesce(tail, F.lit(""))))


@query("fn1_fold", f"SELECT doc_id, md5({FOLD.format(c='text')}) AS folded FROM ({NAMED.format(k='doc_id', c='text', t='documents')})")
def _(t):
    return named(t.documents, "doc_id", "text").select("doc_id", F.md5(S.fold("text")).alias("folded"))


@query(
    "fn2_starts_with_any",
    f"""SELECT doc_id, starts_with(f, 'ea') OR starts_with(f, 'e') OR starts_with(f, 'th') AS hit
    FROM (SELECT doc_id, {FOLD.format(c='text')} AS f FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'E' || chr(769) || text WHEN 1 THEN 'ĘA' || text ELSE text END AS text FROM documents))""",
)
def _(t):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("E\u0301"), "text")).when(k == 1, F.concat(F.lit("ĘA"), "text")).otherwise(F.col("text"))
    return t.documents.withColumn("text", text).select("doc_id", S.starts_with_any("text", ["Êa", "É", "Th"]).alias("hit"))


@query(
    "fn3_slug",
    f"SELECT page_id, regexp_replace(regexp_replace({FOLD.format(c='url')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ({NAMED.format(k='page_id', c='url', t='pages')})",
)
def _(t):
    return named(t.pages, "page_id", "url").select("page_id", S.slug("url").alias("slug"))


IDS = """codes AS (SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code,
   CASE WHEN s_acctbal < 0 THEN 99 ELSE s_nationkey END AS claimed FROM supplier),
  scope AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS prefix, lpad(CAST(50 + n_nationkey AS VARCHAR), 2, '0') AS fips, n_nationkey FROM nation WHERE n_regionkey <> 2)"""


@query(
    "fn4_translate_ids",
    with_sql(IDS) + """
    SELECT s_suppkey, code, CASE WHEN claimed = n_nationkey THEN fips || substr(code, 3) END AS translated, CASE WHEN claimed <> n_nationkey THEN 'prefix mismatch' END AS problem
    FROM codes JOIN scope ON substr(code, 1, 2) = prefix""",
)
def _(t):
    codes = t.supplier.select(
        "s_suppkey", F.concat(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"),
        F.when(F.col("s_acctbal") < 0, 99).otherwise(F.col("s_nationkey")).alias("claimed"),
    )
    scope = t.nation.filter("n_regionkey <> 2").select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("prefix"),
        F.lpad((F.col("n_nationkey") + 50).cast("string"), 2, "0").alias("fips"), F.col("n_nationkey").alias("owner"),
    )
    return vendor.translate_ids(codes, "code", "claimed", F.broadcast(scope), "prefix", "fips", "owner", 2).select(
        "s_suppkey", "code", "translated", "problem"
    )


@query(
    "fn5_null_if",
    "SELECT l_orderkey, l_linenumber, count(nullif(l_discount, 0.0)) AS kept, sum(nullif(l_discount, 0.0)) AS total FROM lineitem GROUP BY 1, 2",
    d="total", i="l_linenumber",
)
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", S.null_if("l_discount", 0.0).alias("v"))
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count("v").alias("kept"), F.sum("v").alias("total"))


@query(
    "fn6_drop_unobserved",
    """SELECT count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS kept, count(*) FILTER (a IS NULL AND b IS NULL) AS dropped, l_returnflag FROM (
      SELECT l_returnflag, nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b FROM lineitem) GROUP BY l_returnflag""",
)
def _(t):
    x = t.lineitem.select("l_returnflag", S.null_if("l_discount", 0.0).alias("a"), S.null_if("l_tax", 0.0).alias("b"))
    return vendor.observed_counts(x, ["l_returnflag"], ["a", "b"])


@query(
    "fn7_weakest_status",
    """SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'prelim' ELSE 'scaled' END AS weakest, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS seen FROM lineitem GROUP BY 1""",
)
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linestatus", F.when(F.col("l_linestatus") == "O", "prelim").otherwise("scaled").alias("status"))
    return vendor.weakest_status(x, ["l_orderkey"], "status", "l_linestatus")


@query(
    "fn8_signed_anomaly",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN p - 100.0 / 3.0 WHEN 'O' THEN 100.0 / 3.0 - p ELSE 0.0 END AS anomaly FROM (SELECT o_orderkey, o_orderstatus, o_totalprice / 10000.0 AS p FROM orders)""",
    d="anomaly",
)
def _(t):
    cat = F.when(F.col("o_orderstatus") == "F", "Above").when(F.col("o_orderstatus") == "O", "Below").otherwise("Normal")
    return t.orders.select("o_orderkey", S.signed_anomaly(F.col("o_totalprice") / 10000.0, cat).alias("anomaly"))


@query(
    "fn9_in_bounds",
    """SELECT vec_id, lat, lon, lat BETWEEN -0.1 AND 0.1 AND lon BETWEEN -0.15 AND 0.05 AS inside FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings)""",
    d="lat lon",
)
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"))
    return e.withColumn("inside", S.in_bounds("lat", "lon", (-0.1, 0.1, -0.15, 0.05)))


@query(
    "fn10_in_months",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) FILTER (month(l_shipdate) BETWEEN 4 AND 10) AS season, count(*) FILTER (month(l_shipdate) >= 11 OR month(l_shipdate) <= 2) AS winter FROM lineitem GROUP BY 1""",
)
def _(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.sum(S.in_months("l_shipdate", 4, 10).cast("int")).alias("season"), F.sum(S.in_months("l_shipdate", 11, 2).cast("int")).alias("winter")
    )


@query(
    "fn11_crop_year",
    """SELECT CAST(CASE WHEN month(l_shipdate) >= 10 THEN year(l_shipdate) + 1 WHEN month(l_shipdate) <= 6 THEN year(l_shipdate) END AS BIGINT) AS crop_year, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(t):
    cal = [(m, -1) for m in (10, 11, 12)] + [(m, 0) for m in range(1, 7)]
    return t.lineitem.groupBy(S.crop_year("l_shipdate", cal).alias("crop_year")).agg(F.count(F.lit(1)).alias("n"))


@query("fn12_excess", with_sql(BELT) + "SELECT k, d, greatest(tmax - 29.0, 0.0) AS hot FROM belt", d="hot")
def _(t):
    return belt(t).select("k", "d", S.excess("tmax", 29.0).alias("hot"))


@query(
    "fn13_stage_features",
    with_sql(BELT) + """SELECT k, d, CASE WHEN month(d) IN (4, 5, 6) THEN 1.0 ELSE 0.0 END AS pre, CASE WHEN month(d) IN (7, 8) THEN 1.0 ELSE 0.0 END AS peak,
      CASE WHEN month(d) IN (7, 8) THEN tmax ELSE 0.0 END AS peak_tmax FROM belt""",
    d="pre peak peak_tmax",
)
def _(t):
    return vendor.stage_features(belt(t), "d", {"pre": (4, 5, 6), "peak": (7, 8)}, {"peak_tmax": ("peak", "tmax")}).select(
        "k", "d", "pre", "peak", "peak_tmax"
    )


@query(
    "fn14_month_cycle",
    """SELECT CAST(o_orderdate AS DATE) AS d, sin(2 * pi() * month(o_orderdate) / 12.0) AS s0, cos(2 * pi() * month(o_orderdate) / 12.0) AS c0,
      sin(2 * pi() * (month(o_orderdate) - 1) / 12.0) AS s1, cos(2 * pi() * (month(o_orderdate) - 1) / 12.0) AS c1, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4, 5""",
    d="s0 c0 s1 c1",
)
def _(t):
    (s0, c0), (s1, c1) = S.month_cycle("d", 0), S.month_cycle("d", 1)
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("d", s0.alias("s0"), c0.alias("c0"), s1.alias("s1"), c1.alias("c1"), "n")


@query(
    "fn15_busdays",
    f"""SELECT l_orderkey, l_linenumber, CAST(sum({busday_sql('CAST(o_orderdate AS DATE)', 'CAST(l_shipdate AS DATE)')}) AS BIGINT) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    i="l_linenumber",
)
def _(t):
    # the count reads the files' footers; grouping by (l_orderkey, l_linenumber) needs no further exchange
    lines, orders = dealt_by_rows(t.lineitem.count(), (t.lineitem, "l_orderkey"), (t.orders, "o_orderkey"))
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = S.busdays(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.sum(days).alias("days"))


@query(
    "fn16_prev_sunday",
    """SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST(CASE WHEN dayofweek(o_orderdate) = 0 THEN 7 ELSE dayofweek(o_orderdate) END AS INTEGER) AS sunday, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def _(t):
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("d", S.prev_sunday("d").alias("sunday"), "n")


@query(
    "fn17_week_fri",
    "SELECT CAST(date_trunc('week', CAST(l_shipdate AS DATE) + 2) AS DATE) + 4 AS week, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy(S.week_fri(F.col("l_shipdate").cast("date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn18_contract_parts",
    with_sql(PANEL) + """
    SELECT root, contract, substr(contract, 2, 1) IN ('M', 'N', 'U', 'Z') AS ok, CASE WHEN substr(contract, 2, 1) IN ('M', 'N', 'U', 'Z') THEN substr(contract, 2, 1) END AS letter,
      CASE WHEN substr(contract, 2, 1) IN ('M', 'N', 'U', 'Z') THEN 2000 + CAST(right(contract, 2) AS BIGINT) END AS delivery_year, count(*) AS rows FROM panel GROUP BY 1, 2""",
)
def _(t):
    p = panel(t).groupBy("root", "contract").agg(F.count(F.lit(1)).alias("rows"))
    parts = S.contract_parts("contract", "[ANR]", "MNUZ")
    return p.withColumn("_p", parts).select(
        "root", "contract", "_p.ok", F.col("_p.month_letter").alias("letter"), "_p.delivery_year", "rows"
    )


@query(
    "fn19_contract_requests",
    """WITH y AS (SELECT l_returnflag AS root, CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS rows FROM lineitem GROUP BY 1, 2),
    g AS (SELECT root, year, rows, unnest(['H', 'K', 'N', 'U', 'Z']) AS letter, unnest([3, 5, 7, 9, 12]) AS m FROM y)
    SELECT root, year, letter, root || letter || lpad(CAST(year % 100 AS VARCHAR), 2, '0') AS contract,
      root || letter || CASE WHEN year >= 1999 THEN lpad(CAST(year % 100 AS VARCHAR), 2, '0') ELSE CAST(year % 10 AS VARCHAR) END
        || CASE WHEN make_date(CAST(year AS INTEGER), m, 15) < DATE '2000-06-30' THEN '^' || CAST((year // 10) % 10 AS VARCHAR) ELSE '' END AS symbol, rows FROM g""",
)
def _(t):
    y = t.lineitem.groupBy(F.col("l_returnflag").alias("root"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return vendor.contract_requests(y, "root", "year", {"H": 3, "K": 5, "N": 7, "U": 9, "Z": 12}, F.lit("2000-06-30").cast("date"), 1999).select(
        "root", "year", "letter", "contract", "symbol", "rows"
    )


@query(
    "fn20_on_tick",
    "SELECT l_returnflag, count(*) FILTER (CAST(round(l_extendedprice * 100) AS BIGINT) % 25 = 0) AS aligned, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(t):
    ok = S.on_tick("l_extendedprice", 0.25)
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(ok.cast("int")).alias("aligned"), F.count(F.lit(1)).alias("n"))


SCORE = "(o_totalprice - 250000.0) / 250000.0"


@query(
    "fn21_position",
    f"SELECT o_orderkey, CAST(CASE WHEN {SCORE} > 0.4 THEN 1 WHEN {SCORE} < -0.4 THEN -1 ELSE 0 END AS BIGINT) AS pos FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", S.position((F.col("o_totalprice") - 250000.0) / 250000.0, 0.4).alias("pos"))


@query(
    "fn22_action_legs",
    f"""WITH p AS (SELECT o_orderkey, CASE WHEN {SCORE} > 0.4 THEN 1 WHEN {SCORE} < -0.4 THEN -1 ELSE 0 END AS pos FROM orders)
    SELECT o_orderkey, CASE pos WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS action, leg, CASE WHEN (pos = 1) = (leg = 'near') THEN 'BUY' ELSE 'SELL' END AS side
    FROM p, (VALUES ('near'), ('far')) l(leg) WHERE pos <> 0
    UNION ALL SELECT o_orderkey, 'HOLD', NULL, NULL FROM p WHERE pos = 0""",
)
def _(t):
    p = t.orders.select("o_orderkey", S.position((F.col("o_totalprice") - 250000.0) / 250000.0, 0.4).alias("pos"))
    return p.select("o_orderkey", S.action("pos").alias("action"), F.inline_outer(S.legs("pos")))
