"""Source queries: payload text is composed from the driver tables, then parsed back.

The SQL twins compute the expected rows straight from the tables, without the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.common import dealt_by_rows
from tidemark.sources import parse as P
from tidemark.sources.store import Store, read_results, write_results

from .base import BELT, DAILY, PANEL, belt_state, cents, daily, panel, small_places, with_sql
from .registry import query

# ------------------------------------------------------------------ JSON


def nested_bodies(t):
    """One body per priority and year; cheap days carry the fill value, one year is an error payload."""
    x = daily(t).withColumn("year", F.year("d"))
    px = F.map_from_entries(F.collect_list(F.struct(F.date_format("d", "yyyyMMdd"), F.when(F.col("px") < 60000, -999.0).otherwise(F.col("px")))))
    n = F.map_from_entries(F.collect_list(F.struct(F.date_format("d", "yyyyMMdd"), F.col("n").cast("double"))))
    # At most 366 days per body.
    bodies = x.groupBy("k", "year").agg(px.alias("px"), n.alias("n"))
    ok = F.to_json(F.struct(
        F.struct(F.lit(-999.0).alias("fill_value")).alias("header"),
        F.struct(F.create_map(F.lit("px"), F.col("px"), F.lit("n"), F.col("n")).alias("parameter")).alias("properties"),
    ))
    refused = F.lit('{"header":"refused","messages":["start is after the record"]}')
    return bodies.select("k", "year", F.when(F.col("year") == 2001, refused).otherwise(ok).alias("body"))


@query(
    "src1_nested_series",
    with_sql(DAILY) + """
    SELECT k, CAST(year(d) AS BIGINT) AS year, d, CASE WHEN px >= 60000 THEN px END AS px, CAST(n AS DOUBLE) AS n, NULL AS problem FROM daily WHERE year(d) <> 2001
    UNION ALL SELECT DISTINCT k, 2001, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE, 'no series' FROM daily WHERE year(d) = 2001""",
    d="px n",
)
def _(t):
    return P.parse_nested_series(nested_bodies(t), "body", ["px", "n"])


def record_bodies(t):
    x = daily(t).withColumn("month", F.trunc("d", "month"))
    rec = F.struct(
        F.lpad(F.col("n").cast("string"), 5, "0").alias("fips"), F.col("d").cast("string").alias("mapDate"),
        F.col("px").alias("d2"), F.lit(1).alias("statisticFormatID"),
    )
    body = F.to_json(F.collect_list(rec))  # at most 31 records per body
    m = x.groupBy("k", "month").agg(body.alias("body"))
    bad = (
        F.when(F.month("month") == 2, '"start date is after end date"')
        .when(F.month("month") == 3, '{"errors":["aoi"]}')
        .when(F.month("month") == 4, "[]")
        .when(F.month("month") == 5, F.regexp_replace("body", '"statisticFormatID":1', '"statisticFormatID":2'))
        .when(F.month("month") == 6, F.regexp_replace("body", '"fips":"[0-9]+",', ""))
    )
    return m.select("k", "month", F.coalesce(bad, F.col("body")).alias("body"))


@query(
    "src2_records",
    with_sql(DAILY) + """, x AS (SELECT *, CAST(date_trunc('month', d) AS DATE) AS month FROM daily)
    SELECT k, month, lpad(CAST(n AS VARCHAR), 5, '0') AS fips, CAST(d AS VARCHAR) AS map_date, px AS d2, NULL AS problem FROM x WHERE month(d) NOT BETWEEN 2 AND 6
    UNION ALL SELECT DISTINCT k, month, NULL, NULL, NULL::DOUBLE,
      CASE month(d) WHEN 2 THEN 'error string' WHEN 3 THEN 'error object' WHEN 4 THEN 'zero rows' WHEN 5 THEN 'wrong statistic type' ELSE 'missing field' END
    FROM x WHERE month(d) BETWEEN 2 AND 6""",
    d="d2",
)
def _(t):
    rows = P.parse_records(
        record_bodies(t), "body", "fips:string,mapDate:string,d2:double,statisticFormatID:int",
        ["fips", "mapDate", "d2"], "statisticFormatID", 1,
    )
    return rows.drop("statisticFormatID").withColumnRenamed("mapDate", "map_date")


def bar_bodies(t):
    """Evening sessions stamped in UTC of the following day: only the offset gives the right date."""
    x = daily(t).withColumn("month", F.trunc("d", "month"))
    stamp = (F.unix_date("d").cast("long") * 86400) + 86400 + 3600
    bars = F.sort_array(F.collect_list(F.struct(
        stamp.alias("ts"), F.when(F.col("px") >= 60000, F.col("px")).alias("close"), F.col("n").cast("double").alias("volume")
    )))
    m = x.groupBy("k", "month").agg(bars.alias("b"))  # at most 31 bars per body
    gran = F.when(F.year("month") == 2000, "1mo").otherwise("1d")
    volume = F.when(F.year("month") == 1999, F.slice("b.volume", 2, 31)).otherwise(F.col("b.volume"))
    body = F.to_json(
        F.struct(
            F.struct(gran.alias("dataGranularity"), F.lit(-10800).alias("gmtoffset")).alias("meta"),
            F.col("b.ts").alias("timestamp"), F.struct(F.col("b.close").alias("close"), volume.alias("volume")).alias("quote"),
        ),
        {"ignoreNullFields": "false"},
    )
    return m.select("k", "month", body.alias("body"))


@query(
    "src3_parallel_arrays",
    with_sql(DAILY) + """, x AS (SELECT *, CAST(date_trunc('month', d) AS DATE) AS month FROM daily)
    SELECT k, month, d, px AS close, CAST(n AS DOUBLE) AS volume, NULL AS problem FROM x WHERE px >= 60000 AND year(d) NOT IN (1999, 2000)
    UNION ALL SELECT DISTINCT k, month, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE, CASE year(d) WHEN 2000 THEN 'wrong granularity' ELSE 'arrays of unequal length' END
    FROM x WHERE year(d) IN (1999, 2000)""",
    d="close volume",
)
def _(t):
    return P.parse_parallel_arrays(bar_bodies(t), "body", "1d", ["close", "volume"], "close")


# ------------------------------------------------------------------ month files


def month_lines(t):
    """One 31-slot line per state and month; absent days hold the sentinel, one state's lines are cut short."""
    x = belt_state(t).select("state", F.trunc("d", "month").alias("m"), F.dayofmonth("d").alias("day"), "tmax")
    days = F.map_from_entries(F.collect_list(F.struct("day", "tmax")))
    m = x.groupBy("state", "m").agg(days.alias("v"))
    slots = F.transform(
        F.sequence(F.lit(1), F.lit(31)), lambda i: F.coalesce(F.try_element_at("v", i), F.lit(-999.99)).cast("string")
    )
    keep = F.when(F.col("state") == "NATION_3", F.slice(slots, 1, 30)).otherwise(slots)
    code = F.lpad(F.regexp_extract("state", r"(\d+)$", 1), 5, "0")
    line = F.concat_ws(",", F.lit("cty"), code, F.lit("x"), F.year("m").cast("string"), F.month("m").cast("string"), F.lit("TMAX"), F.array_join(keep, ","))
    return m.select("state", "m", line.alias("line"))


@query(
    "src4_month_slots",
    with_sql(BELT) + """, s AS (SELECT DISTINCT state, CAST(date_trunc('month', d) AS DATE) AS m FROM belt_state),
    g AS (SELECT state, m, CAST(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM s WHERE state <> 'NATION_3')
    SELECT g.state, lpad(replace(g.state, 'NATION_', ''), 5, '0') AS area, 'tmax' AS measure, g.d, b.tmax AS value, NULL AS problem
    FROM g LEFT JOIN belt_state b ON b.state = g.state AND b.d = g.d
    UNION ALL SELECT state, NULL, NULL, NULL::DATE, NULL::DOUBLE, 'wrong number of fields' FROM s WHERE state = 'NATION_3'""",
    d="value",
)
def _(t):
    return P.unpivot_month_slots(month_lines(t), "line", -999.99).drop("m")


@query(
    "src5_version_text",
    """WITH x AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS n, month(l_shipdate) = 12 AS torn, year(l_shipdate) <= 1994 AS old FROM lineitem GROUP BY 1, 3, 4)
    SELECT CASE WHEN NOT torn THEN m END AS covers_start, CASE WHEN NOT torn THEN CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) END AS covers_end,
      CASE WHEN NOT torn THEN CASE WHEN n % 2 = 0 THEN 'complete' ELSE 'prelim' END END AS state,
      CASE WHEN NOT old THEN CAST(m + INTERVAL 1 MONTH + INTERVAL 6 DAY AS DATE) END AS created_on, 'v' || n AS software,
      CASE WHEN NOT old THEN '3.' || month(m) || '-upd-' || n END AS build, CASE WHEN old THEN 'Sat Apr 22 05:18:09 ' || year(m) END AS downloaded,
      CASE WHEN torn THEN 'no head line' END AS problem FROM x""",
)
def _(t):
    """Months of either layout: a build and a creation date, or a download time; Decembers lost their head line."""
    m = t.lineitem.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    old, n = F.year("m") <= 1994, F.col("n").cast("string")
    head = F.concat(
        F.lit("Grid-Daily v1-0-0 "), F.when(F.col("n") % 2 == 0, "complete").otherwise("prelim"), F.lit(" for "), F.col("m").cast("string"),
        F.lit(" through "), F.last_day("m").cast("string"), F.lit("\n"),
    )
    new = F.concat(
        F.lit("Made from GHCN-Daily 3."), F.month("m").cast("string"), F.lit("-upd-"), n, F.lit(" created on "), F.date_add(F.last_day("m"), 7).cast("string"),
    )
    was = F.concat(F.lit("station data downloaded on Sat Apr 22 05:18:09 "), F.year("m").cast("string"), F.lit("  "))
    text = F.concat(F.when(F.month("m") == 12, "").otherwise(head), F.lit("by software v"), n, F.lit(" of ours\n"), F.when(old, was).otherwise(new))
    return m.select(text.alias("text")).select(*[c.alias(n) for n, c in P.parse_version_text("text").items()])


@query(
    "src6_single_measure",
    """SELECT o_orderpriority AS entity, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(count(*) AS DOUBLE) AS value, 'Orders (count)' AS measure FROM orders GROUP BY 1, 2""",
    d="value",
)
def _(t):
    x = t.orders.groupBy(F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").cast("string").alias("year")).agg(
        F.count(F.lit(1)).cast("string").alias("Orders (count)")
    )
    return P.single_measure(x, ["entity", "year"])


def quantity_bodies(t):
    """One payload per state and year: quantities by area with thousands separators, small ones withheld."""
    x = t.lineitem.withColumnRenamed("l_suppkey", "point").join(small_places(t), "point").groupBy(
        "state", F.year("l_shipdate").alias("y"), "l_linenumber"
    ).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    county = F.when(F.col("l_linenumber") == 7, "998").otherwise(F.col("l_linenumber").cast("string"))
    value = F.when(F.col("q") < 1000, " (D) ").otherwise(F.format_number("q", 0))
    rec = F.struct(
        F.regexp_extract("state", r"(\d+)$", 1).alias("state_code"), county.alias("county_code"),
        F.col("y").cast("string").alias("year"), value.alias("Value"),
    )
    bodies = x.groupBy("state", "y").agg(F.to_json(F.struct(F.collect_list(rec).alias("data"))).alias("body"))
    # one year's requests were refused, another's answer was cut short
    refused = F.when(F.col("y") == 1996, '{"error":["exceeds limit","try less"]}').when(F.col("y") == 1997, '{"dat')
    return bodies.select("state", F.coalesce(refused, F.col("body")).alias("body"))


@query(
    "src7_quantities",
    """SELECT n_name AS state, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || CASE WHEN l_linenumber = 7 THEN '998' ELSE lpad(CAST(l_linenumber AS VARCHAR), 3, '0') END AS area,
      CAST(year(l_shipdate) AS BIGINT) AS year, CASE WHEN sum(l_quantity) >= 1000 THEN sum(l_quantity) END AS quantity,
      CASE WHEN sum(l_quantity) < 1000 THEN 'D' END AS flag, l_linenumber <> 7 AS is_area, NULL AS problem
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE year(l_shipdate) NOT IN (1996, 1997) GROUP BY n_name, n_nationkey, l_linenumber, year(l_shipdate)
    UNION ALL SELECT DISTINCT n_name, NULL, NULL::BIGINT, NULL::DOUBLE, NULL, NULL::BOOLEAN, CASE year(l_shipdate) WHEN 1996 THEN 'refused: exceeds limit; try less' ELSE 'no data' END
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE year(l_shipdate) IN (1996, 1997)""",
    d="quantity",
)
def _(t):
    return P.parse_quantities(quantity_bodies(t), "body")


# ------------------------------------------------------------------ reports


def reports(t):
    """One report per week of orders: a condition and a progress table of corn, and a table of another crop.

    Figures are counts by priority. Some weeks are a notice, some lack corn, some have no date, and some
    were listed under another date.
    """
    x = t.orders.withColumn("w", F.to_date(F.date_trunc("week", "o_orderdate"))).groupBy("w", "o_orderstatus").agg(
        *[F.sum((F.substring("o_orderpriority", 1, 1) == str(i + 1)).cast("int")).alias(f"n{i}") for i in range(5)]
    )

    def cell(i):
        c = F.col(f"n{i}")
        return F.when(c == 0, "-").when(c > 100, "120").when(c % 7 == 3, "(NA)").otherwise(c.cast("string"))

    def row(label, n):
        return F.concat(label, F.lit(" ......: "), F.concat_ws("     ", *[cell(i) for i in range(n)]), F.lit("\n"))

    state = F.concat(F.lit("  State   "), F.col("o_orderstatus"))
    per = x.groupBy("w").agg(
        F.array_join(F.sort_array(F.collect_list(row(state, 5))), "").alias("c"), F.array_join(F.sort_array(F.collect_list(row(state, 4))), "").alias("p"),
        *[F.sum(f"n{i}").alias(f"t{i}") for i in range(5)],
    )
    rule = F.lit("-" * 40 + "\n")
    week = F.floor(F.datediff("w", F.lit("1990-01-01").cast("date")) / 7)
    head = F.when(week % 11 == 5, "Prepared").otherwise(F.concat(F.lit("Released "), F.date_format(F.date_add("w", 7), "MMMM d, yyyy"), F.lit(", by the service")))
    corn = F.concat(
        F.lit("Corn Condition - Selected States: Week Ending\nnoise line: 1 2 3\n"), rule, F.col("c"),
        F.lit("18 States ....:  5  10  20  40  25\nPrevious week ....:  5  10  20  -  65\nPrevious year ....:  1  2  3  (NA)  9\nShort ....: 1 2\n"),
        rule, F.lit("Corn Dent - Selected States\n"), rule, F.col("p"), F.lit("18 States ....:  1  2  (NA)  -\nPrevious week ....:  1  2\n"), rule,
    )
    other = F.concat(F.lit("Soybeans Mature - Selected States\n"), F.col("p"))
    text = F.concat(head, F.lit("\nOther ....: 1 2 3 4 5\n"), F.when(week % 13 == 6, "").otherwise(corn), other)
    notice = F.lit("The Crop Progress report will not be issued this week.")
    listed = F.when(week % 17 == 8, F.col("w")).otherwise(F.date_add("w", 7))
    return per.select("w", listed.alias("listed"), F.when(week % 19 == 9, notice).otherwise(text).alias("text"))


REPORTS = """x AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, o_orderstatus AS s, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS i FROM orders),
n AS (SELECT w, s, g.i, count(x.i) AS n FROM (SELECT DISTINCT w, s FROM x) JOIN range(5) g(i) ON true LEFT JOIN x USING (w, s, i) GROUP BY 1, 2, 3),
v AS (SELECT w, s, i, CASE WHEN n = 0 THEN 0 WHEN n > 100 THEN 120 WHEN n % 7 = 3 THEN NULL ELSE n END AS v FROM n),
wk AS (SELECT DISTINCT w, CAST(floor((w - DATE '1990-01-01') / 7) AS BIGINT) AS k FROM x),
st AS (SELECT w, k, CASE WHEN k % 19 = 9 THEN 'release notice' WHEN k % 11 = 5 THEN 'no release date' WHEN k % 17 = 8 THEN 'date is not the listed one' WHEN k % 13 = 6 THEN 'no table of the crop' END AS problem FROM wk),
rows AS (
  SELECT w, 'condition' AS measure, 'condition' AS stage, 'State ' || s AS region, 'state' AS region_type, 'current' AS comparison, list(v ORDER BY i) AS v FROM v GROUP BY w, s
  UNION ALL SELECT w, 'progress', 'dented', 'State ' || s, 'state', NULL, list(v ORDER BY i) FILTER (i < 4) FROM v GROUP BY w, s
  UNION ALL SELECT w, 'condition', 'condition', 'selected_states', 'selected_states', c, l FROM wk, (VALUES ('current', [5, 10, 20, 40, 25]), ('previous_week', [5, 10, 20, 0, 65]), ('previous_year', [1, 2, 3, NULL, 9])) f(c, l)
  UNION ALL SELECT w, 'condition', 'condition', 'Short', 'state', NULL, [1, 2] FROM wk
  UNION ALL SELECT w, 'progress', 'dented', 'selected_states', 'selected_states', NULL, [1, 2, NULL, 0] FROM wk),
good AS (SELECT r.*, len(list_filter(v, lambda x: x IS NULL)) = 0 AND measure = 'condition' AND list_sum(v) <> 100 AS off,
  CASE WHEN len(v) <> CASE measure WHEN 'condition' THEN 5 ELSE 4 END THEN 'wrong number of values' WHEN len(list_filter(v, lambda x: x > 100)) > 0 THEN 'figure outside 0..100' END AS problem
  FROM rows r JOIN st ON st.w = r.w AND st.problem IS NULL),
cells AS (SELECT w, measure, stage, region, region_type, unnest(v) AS value, unnest(CASE measure WHEN 'condition' THEN ['very_poor', 'poor', 'fair', 'good', 'excellent'] ELSE ['percent', 'percent', 'percent', 'percent'] END) AS category,
  unnest(CASE measure WHEN 'condition' THEN [comparison, comparison, comparison, comparison, comparison] ELSE ['previous_year', 'previous_week', 'current', 'five_year_average'] END) AS comparison,
  CASE WHEN off THEN 'source_condition_sum_' || list_sum(v) END AS quality_status FROM good WHERE problem IS NULL),
o AS (
  SELECT w, w + 7 AS release_date, measure, stage, region, region_type, comparison, category, CAST(value AS DOUBLE) AS value, quality_status, NULL AS problem FROM cells
  UNION ALL SELECT w, w + 7, measure, stage, region, region_type, NULL, NULL, NULL, CASE WHEN off THEN 'source_condition_sum_' || list_sum(v) END, problem FROM good WHERE problem IS NOT NULL
  UNION ALL SELECT w, CASE WHEN problem NOT IN ('release notice', 'no release date') THEN w + 7 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM st WHERE problem IS NOT NULL)"""


@query(
    "src8_report",
    with_sql(REPORTS) + """
    SELECT *, release_date - 1 AS reference_date,
      timezone('UTC', timezone('America/New_York', CAST(release_date AS TIMESTAMP) + INTERVAL 16 HOUR)) AS available_at FROM o""",
    d="value",
)
def _(t):
    out = P.parse_report(reports(t), "text", "Corn", expected="listed")
    return out.drop("listed").withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))


# ------------------------------------------------------------------ outlooks (polygons come decoded)

OUTLOOKS = """files AS (
  SELECT o_orderkey AS file_id, CASE WHEN o_orderpriority < '3' THEN '610temp' ELSE '814temp' END AS product, CAST(o_orderdate AS DATE) AS issued,
    CASE WHEN o_orderstatus = 'F' THEN 'Above' ELSE 'Below' END AS file_category FROM orders),
polys AS (
  SELECT l_orderkey AS file_id, CASE WHEN l_returnflag <> 'R' THEN l_quantity + 30.0 END AS prob, CASE WHEN l_returnflag = 'R' THEN '  ' || CAST(CAST(l_quantity AS INTEGER) + 30 AS VARCHAR) END AS label,
    CASE WHEN l_linestatus = 'F' THEN 'Above' WHEN l_linenumber = 1 THEN 'Normal' ELSE 'Below' END AS cat, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 4 AS e FROM lineitem)"""


def outlook_files(t):
    return t.orders.select(
        F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderpriority") < "3", "610temp").otherwise("814temp").alias("product"),
        F.col("o_orderdate").cast("date").alias("issued"), F.when(F.col("o_orderstatus") == "F", "Above").otherwise("Below").alias("file_category"),
    )


def outlook_polys(t):
    d = F.col("l_shipdate").cast("date")
    early = F.col("l_returnflag") == "R"
    return t.lineitem.select(
        F.col("l_orderkey").alias("file_id"), F.when(~early, F.col("l_quantity") + 30.0).alias("prob"),
        F.when(early, F.concat(F.lit("  "), (F.col("l_quantity").cast("int") + 30).cast("string"))).alias("label"),
        F.when(F.col("l_linestatus") == "F", "Above").when(F.col("l_linenumber") == 1, "Normal").otherwise("Below").alias("cat"),
        F.when(~early, d).alias("start"), F.when(~early, F.date_add(d, 4)).alias("end"),
        F.when(early, F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit(" - "), F.date_format(F.date_add(d, 4), "MM/dd/yyyy"))).alias("valid_period"),
    )


@query(
    "src9_outlooks",
    with_sql(OUTLOOKS) + """, n AS (
      SELECT file_id, product, issued, s AS valid_start, e AS valid_end, CASE WHEN prob IS NULL THEN file_category ELSE cat END AS category,
        coalesce(prob, CAST(trim(label) AS DOUBLE)) AS probability, CASE WHEN prob IS NULL THEN 'early' ELSE 'unified' END AS era FROM polys JOIN files USING (file_id)
      UNION ALL SELECT file_id, product, issued, issued + CASE product WHEN '610temp' THEN 6 ELSE 8 END, issued + CASE product WHEN '610temp' THEN 10 ELSE 14 END, 'Normal', NULL, 'empty'
      FROM files WHERE file_id NOT IN (SELECT file_id FROM polys))
    SELECT *, CASE category WHEN 'Normal' THEN 0.0 WHEN 'Above' THEN probability - 100.0 / 3.0 ELSE 100.0 / 3.0 - probability END AS anomaly FROM n""",
    d="probability anomaly",
)
def _(t):
    return P.normalise_outlooks(outlook_polys(t), outlook_files(t), {"610temp": (6, 10), "814temp": (8, 14)})


# ------------------------------------------------------------------ message indexes

LINES = """msg AS (
  SELECT l_orderkey AS k, row_number() OVER w AS number, row_number() OVER w * 1000 + CAST(l_quantity AS BIGINT) AS off,
    l_returnflag AS variable, l_linestatus AS level, CAST(l_linenumber AS VARCHAR) AS forecast, l_linenumber = 7 AS broken
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus))"""


def indexes(t):
    """One index text per order; the lines of an order are bounded by the order."""
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("r"))
    line = F.transform("r", lambda x, i: F.concat_ws(
        ":", (i + 1).cast("string"), ((i + 1) * 1000 + x["l_quantity"].cast("long")).cast("string"), F.lit("d=1995010100"),
        x["l_returnflag"], x["l_linestatus"], x["l_linenumber"].cast("string"), F.lit("ens mean"),
    ))
    # An order whose last line is its seventh loses the last field of its index.
    cut = F.when(F.element_at("r", -1)["l_linenumber"] == 7, F.regexp_replace(F.array_join(line, "\n"), ":ens mean$", "")).otherwise(F.array_join(line, "\n"))
    return rows.select("k", cut.alias("text"))


CUT = """, bad AS (SELECT k FROM msg GROUP BY k HAVING bool_or(broken))"""


@query(
    "src10_message_index",
    with_sql(LINES) + CUT + """
    SELECT k, number, off AS "offset", variable, level, forecast, lead(off) OVER (PARTITION BY k ORDER BY number) - 1 AS "end", NULL AS problem FROM msg WHERE k NOT IN (SELECT k FROM bad)
    UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, 'wrong number of fields' FROM bad""",
)
def _(t):
    return P.parse_message_index(indexes(t), "text").drop("run", "statistic")


@query(
    "src11_select_required",
    with_sql(LINES) + CUT + """, g AS (SELECT k, count(*) FILTER (variable = 'A' AND level = 'F') AS a, count(*) FILTER (variable = 'N' AND level = 'O') AS n FROM msg WHERE k NOT IN (SELECT k FROM bad) GROUP BY k),
    w AS (SELECT k, 'A' AS variable, 'F' AS level, a AS found FROM g UNION ALL SELECT k, 'N', 'O', n FROM g)
    SELECT *, CASE WHEN found = 0 THEN 'missing' WHEN found > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM w""",
)
def _(t):
    return P.select_required(P.accepted(P.parse_message_index(indexes(t), "text")), ["k"], [("A", "F"), ("N", "O")])


@query(
    "src12_coalesce_ranges",
    with_sql(DAILY) + """, r AS (SELECT k, d - DATE '1995-01-01' AS s, d - DATE '1995-01-01' + 1 AS e FROM daily WHERE day(d) % 9 NOT IN (3, 4)),
    r2 AS (SELECT k, s * 10 AS s, s * 10 + 4 AS e FROM r),
    f AS (SELECT *, CASE WHEN s - lag(e) OVER w - 1 <= 15 THEN 0 ELSE 1 END AS nw FROM r2 WINDOW w AS (PARTITION BY k ORDER BY s)),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY s) AS island FROM f)
    SELECT k, min(s) AS start, max(e) AS "end", count(*) AS pieces FROM g GROUP BY k, island""",
)
def _(t):
    s = F.datediff("d", F.lit("1995-01-01").cast("date")).cast("long") * 10
    # two pieces of nine were never fetched
    r = daily(t).filter(~(F.dayofmonth("d") % 9).isin(3, 4)).select("k", s.alias("s"), (s + 4).alias("e"))
    return P.coalesce_ranges(r, ["k"], "s", "e", 15, 500)


# ------------------------------------------------------------------ links

ANCHOR = '<a href="([^"]+)">([^<]*)</a>'
# Added to every page: links of each kind of target, releases on good and foreign hosts, page numbers.
MORE = """'<a href="//CDN.Example.com/x">Cdn</a><a href="?page=' || (page_id % 7) || '">Next</a><a href="list.TXT?v=' || page_id || '">Jun  ' || (1 + page_id % 9) || ' 2024 - txt</a>'
  || '<a href="https://' || CASE page_id % 4 WHEN 0 THEN 'evilexample.com' WHEN 1 THEN 'www.example.com' ELSE 'EXAMPLE.com:443' END || '/r/b.txt">Jul 4 2024 - txt</a>'
  || CASE WHEN page_id % 5 = 0 THEN '<a href="/other.txt">Jul 4 2024 - txt</a>' ELSE '' END || '<a href="/about.pdf">Jul 5 2024 - txt</a>'"""
HOSTS = ("example.com", "www.example.com", "cdn.example.com")
LISTING = f"""pg AS (SELECT page_id, url, html || {MORE} AS html, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, regexp_replace(url, '[?#].*$', '') AS page FROM pages),
raw AS (SELECT page_id, url, site, page, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS h, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS l FROM pg),
lk AS (SELECT page_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS label,
  CASE WHEN h LIKE '%://%' THEN h WHEN h LIKE '//%' THEN split_part(url, ':', 1) || ':' || h WHEN h LIKE '/%' THEN site || h WHEN h LIKE '?%' THEN page || h
    ELSE regexp_replace(page, '[^/]*$', '') || h END AS href FROM raw),
links AS (SELECT *, lower(regexp_extract(href, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM lk)"""


def listing(t):
    n = F.col("page_id").cast("string")
    host = F.when(F.col("page_id") % 4 == 0, "evilexample.com").when(F.col("page_id") % 4 == 1, "www.example.com").otherwise("EXAMPLE.com:443")
    more = F.concat(
        F.lit('<a href="//CDN.Example.com/x">Cdn</a><a href="?page='), (F.col("page_id") % 7).cast("string"), F.lit('">Next</a><a href="list.TXT?v='), n,
        F.lit('">Jun  '), (1 + F.col("page_id") % 9).cast("string"), F.lit(' 2024 - txt</a><a href="https://'), host, F.lit('/r/b.txt">Jul 4 2024 - txt</a>'),
        F.when(F.col("page_id") % 5 == 0, '<a href="/other.txt">Jul 4 2024 - txt</a>').otherwise(""), F.lit('<a href="/about.pdf">Jul 5 2024 - txt</a>'),
    )
    return P.extract_links(t.pages.withColumn("html", F.concat("html", more)), "html", "url", ANCHOR, HOSTS)


@query("src13_extract_links", f"WITH {LISTING} SELECT page_id, href, label, host, host IN {HOSTS} AS allowed FROM links")
def _(t):
    return listing(t)


@query("src13_link_conflicts", f"WITH {LISTING} SELECT page_id, label, count(*) AS links, min(href) <> max(href) AS conflict FROM links GROUP BY 1, 2")
def _(t):
    return P.link_conflicts(listing(t), ["page_id"])


RELEASE = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4})\s+-\s+txt$"


@query(
    "src13_typed_links",
    f"""WITH {LISTING} SELECT page_id, strptime(replace(label, ' - txt', ''), '%b %-d %Y')::DATE AS release_date, min(href) AS href,
      CASE WHEN bool_or(host NOT IN {HOSTS}) THEN 'host not allowed' WHEN min(href) <> max(href) THEN 'more than one target' END AS problem
    FROM links WHERE label LIKE '% 2024 - txt' AND lower(regexp_replace(href, '[?#].*$', '')) LIKE '%.txt' GROUP BY 1, 2""",
)
def _(t):
    return P.typed_links(listing(t), ["page_id"], RELEASE, "MMM d yyyy", ".txt")


@query("src13_last_page", f"WITH {LISTING} SELECT page_id, max(coalesce(TRY_CAST(regexp_extract(href, '[?&]page=([0-9]+)', 1) AS BIGINT), 0)) AS last_page FROM links GROUP BY 1")
def _(t):
    return P.last_page(listing(t), ["page_id"])


# ------------------------------------------------------------------ vendor exports

MAPPING = {"date": "l_shipdate", "root": "l_returnflag", "contract": "l_suppkey", "open": "l_extendedprice", "settlement": "l_tax"}


@query(
    "src14_import_export",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'ZA' WHEN 'N' THEN 'ZN' ELSE 'R' END AS root, CAST(l_suppkey AS VARCHAR) AS contract, CASE WHEN l_returnflag = 'R' THEN 'unmapped root' END AS problem,
      count(*) AS rows, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END)::BIGINT AS cents FROM lineitem GROUP BY 1, 2, 3""",
)
def _(t):
    rows = P.import_export(t.lineitem, MAPPING, "root", {"A": "ZA", "N": "ZN"}, ["open", "settlement"], 100.0)
    return rows.groupBy("root", F.col("contract").cast("string").alias("contract"), "problem").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.col("open_cents") + 0.5).cast("long")).alias("cents")
    )


@query(
    "src15_normalize_history",
    with_sql(PANEL) + """
    SELECT root, contract, CASE WHEN oi = 1 THEN NULL ELSE expiry END AS expiry, CASE WHEN oi = 1 THEN 'incomplete' WHEN settle_cents < low_cents THEN 'impossible' END AS dropped, count(*) AS rows
    FROM panel GROUP BY 1, 2, 3, 4""",
)
def _(t):
    # Single-trade sessions have no expiry; the settlement stands in for the open.
    p = panel(t).withColumn("expiry", F.when(F.col("oi") > 1, F.concat(F.date_format("expiry", "yyyyMMdd"), F.lit(".0"))))
    out = P.normalize_history(p, "expiry", "settle_cents", "high_cents", "low_cents", "settle_cents")
    return out.groupBy("root", "contract", "expiry", "dropped").agg(F.count(F.lit(1)).alias("rows"))


def margin_texts(t):
    """One text layer per root and month: five-line rate blocks between page furniture."""
    x = t.lineitem.groupBy(
        F.col("l_returnflag").alias("root"), F.col("l_shipdate").cast("date").alias("d"), "l_linenumber"
    ).agg(F.sum(cents("l_extendedprice")).alias("c"))
    block = F.concat(
        # one root's pages carry another product
        F.col("d").cast("string"), F.when(F.col("root") == "R", "\nRICE FUTURES\nXCH+\n").otherwise("\nGRAIN (5,000 BU.) FUTURES\nXCH+\n"), (F.col("c") / 100).cast("decimal(18,2)").cast("string"),
        F.lit("\nC-0"), F.col("l_linenumber").cast("string"), F.lit("\npage footer\n"),
    )
    return x.groupBy("root", F.trunc("d", "month").alias("month")).agg(F.array_join(F.collect_list(block), "").alias("text")).drop("month")


@query(
    "src16_margin_text",
    """SELECT l_returnflag AS root, CAST(l_shipdate AS DATE) AS business_date, 'C' AS product, CAST(l_linenumber AS BIGINT) AS roll_index,
      sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS rate, NULL AS problem FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 4
    UNION ALL SELECT DISTINCT l_returnflag, NULL::DATE, NULL, NULL::BIGINT, NULL::DOUBLE, 'no rate rows' FROM lineitem WHERE l_returnflag = 'R'""",
    d="rate",
)
def _(t):
    return P.parse_margin_text(margin_texts(t), "text", "GRAIN (5,000 BU.) FUTURES", "XCH+", "C").distinct()


@query(
    "src17_geo_dims",
    """WITH m AS (SELECT r_name AS belt, n_name AS state, s_suppkey AS point, CASE WHEN r_name <> 'ASIA' AND s_acctbal > 0 THEN s_acctbal END AS w
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT belt, state, point, CASE WHEN sum(w) OVER p > 0 THEN coalesce(w, 0.0) / sum(w) OVER p ELSE 1.0 / count(*) OVER p END AS share FROM m WINDOW p AS (PARTITION BY belt)""",
    d="share",
)
def _(t):
    w = t.supplier.select(F.col("s_suppkey").alias("point"), "s_acctbal").join(small_places(t), "point")
    w = w.withColumn("w", F.when((F.col("belt") != "ASIA") & (F.col("s_acctbal") > 0), F.col("s_acctbal")))
    return P.geo_dims(w, ["belt"], "w").select("belt", "state", "point", "share")


@query(
    "src18_store",
    with_sql(DAILY) + "SELECT k, d, px, n, 'daily' AS name FROM daily",
    d="px",
)
def _(t):
    store = Store(t.spark)
    store.write("daily", daily(t))
    names = F.lit(",".join(n for n in store.names() if n == "daily"))
    return store.read("daily").withColumn("name", names)


@query(
    "src19_filter_verified",
    """SELECT problem, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS qty FROM (
      SELECT l_quantity, CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 'archived late' WHEN l_linenumber <> CAST(substr(o_orderpriority, 1, 1) AS INTEGER) THEN 'wrong lead' END AS problem
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def _(t):
    o = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("available"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("lead"),
    )
    lines, orders = dealt_by_rows(t.lineitem.count(), (t.lineitem, "l_orderkey"), (o, "l_orderkey"))
    rows = lines.join(orders, "l_orderkey").withColumn("archived", F.col("l_shipdate").cast("date"))
    return P.filter_verified(rows, "archived", "available", "l_linenumber", "lead").groupBy("problem").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_quantity").cast("long")).alias("qty")
    )


@query(
    "src20_write_results",
    """SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS BIGINT) AS year, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)), 2) AS mean_price FROM orders GROUP BY 1, 2""",
    d="mean_price",
)
def _(t):
    x = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(
        (F.sum(cents("o_totalprice")).cast("double") / (F.lit(100.0) * F.count(F.lit(1)))).alias("mean_price")
    )
    path = Store(t.spark).root + "/results/mean_price"
    write_results(x, path, {"mean_price": 2})
    return read_results(t.spark, path, "priority string, year bigint, mean_price double")
