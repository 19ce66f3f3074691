"""Fetch-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import ranges
from tidemark.sources import versions as V

from .base import LOG, cents, log, with_sql
from .registry import query


@query("ver1_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", V.content_hash("text").alias("sha"))


# Every column as text: whole numbers, money in cents, days; a tax of zero counts as unknown.
LINE_COLUMNS = {
    "l_orderkey": "CAST({c} AS VARCHAR)", "l_partkey": "CAST({c} AS VARCHAR)", "l_suppkey": "CAST({c} AS VARCHAR)", "l_linenumber": "CAST({c} AS VARCHAR)",
    "l_quantity": "CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)", "l_extendedprice": "CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)",
    "l_discount": "CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)", "l_tax": "CAST(nullif(CAST(round({c} * 100) AS BIGINT), 0) AS VARCHAR)",
    "l_linestatus": "{c} || '|<null>\"' || chr(92)",
}


def line_text(c: str):
    if c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        return F.col(c).cast("string")
    if c == "l_linestatus":
        return F.concat(c, F.lit('|<null>"\\'))
    return F.when((F.col(c) != 0) | F.lit(c != "l_tax"), cents(c).cast("string"))


@query(
    "ver2_rowset_fingerprint",
    f"""WITH r AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS d, sha256(CAST(to_json({{{", ".join(f"'{c}': {e.format(c=c)}" for c, e in LINE_COLUMNS.items())}}}) AS VARCHAR)) AS h FROM lineitem),
      e AS (SELECT l_returnflag, d, h, count(*) AS n FROM r GROUP BY 1, 2, 3),
      b AS (SELECT l_returnflag, d, substr(h, 1, 2) AS b, sum(n) AS n, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS bh FROM e GROUP BY 1, 2, 3)
    SELECT l_returnflag, d, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(b || bh, chr(10) ORDER BY b)) AS fingerprint FROM b GROUP BY 1, 2""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_shipdate").cast("date").alias("d"), *[line_text(c).alias(c) for c in LINE_COLUMNS])
    return V.rowset_fingerprint(rows, ["l_returnflag", "d"], list(LINE_COLUMNS))


@query("ver3_history", with_sql(LOG) + "SELECT source, key, pos, fetched_at, sha FROM log WHERE source = 'purchase' ORDER BY pos")
def _(t):
    return V.history(log(t), source="purchase").select("source", "key", "pos", "fetched_at", "sha").orderBy("pos")


@query("ver4_versions", with_sql(LOG) + "SELECT source, key, sha, min(fetched_at) AS first_seen, count(*) AS fetches FROM log GROUP BY 1, 2, 3")
def _(t):
    return V.versions(log(t))


@query(
    "ver5_latest",
    with_sql(LOG) + "SELECT source, key, pos, fetched_at, sha FROM log QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY fetched_at DESC, pos DESC) = 1",
)
def _(t):
    return V.latest(log(t), ["pos", "fetched_at", "sha"])


@query("ver6_first_seen", with_sql(LOG) + "SELECT source, key, min(pos) AS first_pos FROM log GROUP BY 1, 2 ORDER BY 3")
def _(t):
    return V.first_seen(log(t), ["source", "key"]).orderBy("first_pos")


@query(
    "ver7_archive_status",
    with_sql(LOG) + """SELECT source, count(DISTINCT key) AS keys, count(DISTINCT (key, sha)) AS versions, count(*) AS fetches,
      max(fetched_at) AS newest_fetch, max(pub) AS newest_publication FROM log GROUP BY 1""",
)
def _(t):
    return V.archive_status(log(t))


@query(
    "ver8_snapshot",
    with_sql(LOG) + "SELECT source, count(*) AS fetch_records, max(fetched_at) AS latest_fetch, max(pub) AS latest_publication FROM log GROUP BY 1",
)
def _(t):
    return V.snapshot(log(t))


# The files have no view, so the SQL names the folder of the tables it is run on.
FILES = "/root/testdata/sf0.01"
CHUNK = 1 << 16


def level(n: int) -> str:
    return f"l{n} AS (SELECT file, n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l{n - 1} GROUP BY 1, 2)"


@query(
    "ver8_file_digests",
    f"""WITH f AS (SELECT parse_filename(filename) AS file, size AS bytes, content, (size + {CHUNK - 1}) // {CHUNK} AS chunks FROM read_blob('{FILES}/*.parquet')),
      c AS (SELECT file, content, CAST(unnest(range(0, chunks)) AS BIGINT) AS n FROM f),
      l0 AS (SELECT file, n, sha256(content[n * {CHUNK} + 1:(n + 1) * {CHUNK}]) AS h FROM c), {", ".join(level(n) for n in range(1, 5))}
    SELECT file, f.bytes, f.chunks, l4.h AS root, sha256(content) AS sha256 FROM f JOIN l4 USING (file)""",
    i="bytes chunks",
)
def _(t):
    return ranges.file_digests(t.spark, f"{t.sf_dir}/*.parquet", CHUNK).drop("path")


@query(
    "ver9_plan_missing",
    with_sql(LOG) + """, g AS (SELECT key, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS pub FROM (SELECT DISTINCT key FROM log))
    SELECT key, pub FROM g WHERE pub = DATE '2024-01-30' OR (key, pub) NOT IN (SELECT (key, pub) FROM log)""",
)
def _(t):
    lg = log(t)
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return V.plan_missing(lg.select("key").distinct(), lg, ["key"], "pub", days, F.lit("2024-01-30").cast("date"))


@query(
    "ver10_dedupe_last",
    with_sql(LOG) + """SELECT key, pub, arg_max(body, pos) AS body, max(pos) AS pos, count(*) - 1 AS dropped FROM log GROUP BY 1, 2""",
)
def _(t):
    return V.dedupe_last(log(t), ["key", "pub"], ["pos"], ["body", "pos"])


@query(
    "ver11_dedupe_strongest",
    """SELECT user_id, event_type, value - 50 AS anomaly, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(value - 50) DESC, event_id DESC) = 1""",
    d="anomaly",
)
def _(t):
    e = t.events.withColumn("anomaly", F.col("value") - 50)
    return V.dedupe_strongest(e, ["user_id", "event_type"], "anomaly", ["anomaly", "event_id"], ["event_id"])
