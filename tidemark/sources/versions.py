"""Operators over the append-only fetch log.

A key (or source) may hold a third of the log, so nothing here sorts or collects the rows
of a key: newest and oldest rows come from max_by / min_by, which combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import col

LOG_SCHEMA = (
    "source string, key string, url string, path string, sha256 string, bytes bigint, fetched_at timestamp, "
    "params map<string,string>, publication_date date, version_stamp string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines fetch log; a corrupt line is fatal."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").json(path)


def content_hash(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def rowset_fingerprint(df: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Order-insensitive digest of each key's rows; equal rows count as often as they occur.

    A row is digested as JSON, so field borders and NULLs are part of it. A key's rows meet only in
    buckets: equal digests are counted, each bucket (by the digest's first two hex digits) is digested in sorted
    order, and the key's digest covers its bucket digests. No sum that could cancel out, and a key's
    rows are spread over 256 groups.
    """
    digest = F.sha2(F.to_json(F.struct(*row), {"ignoreNullFields": "false"}), 256)
    each = df.select(*keys, digest.alias("_d")).groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    bucket = each.groupBy(*keys, F.substring("_d", 1, 2).alias("_b")).agg(
        F.sum("_n").alias("_n"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("_d", F.lit(":"), F.col("_n").cast("string")))), "\n"), 256).alias("_h"),
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda x: F.concat(x["_b"], x["_h"])), "\n")
    return bucket.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sha2(listed, 256).alias("fingerprint"))


def history(log: DataFrame, source: str | None = None, key: str | None = None) -> DataFrame:
    """Fetches of a source or key. Log order is the `pos` column; sort on it at the point of use."""
    out = log
    if source is not None:
        out = out.filter(F.col("source") == source)
    if key is not None:
        out = out.filter(F.col("key") == key)
    return out


def versions(log: DataFrame) -> DataFrame:
    """Distinct contents per key, stamped with their first observation."""
    return log.groupBy("source", "key", "sha").agg(
        F.min("fetched_at").alias("first_seen"), F.count(F.lit(1)).alias("fetches")
    )


def latest(log: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Newest fetch per key; equal times go to the one written last."""
    s = F.struct(*payload)
    return log.groupBy("source", "key").agg(F.max_by(s, F.struct("fetched_at", "pos")).alias("_s")).select("source", "key", "_s.*")


def first_seen(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys (or sources) with the log position they first appeared at."""
    return log.groupBy(*by).agg(F.min("pos").alias("first_pos"))


def archive_status(log: DataFrame) -> DataFrame:
    """Keys, versions, fetches, newest fetch and publication per source, folded level by level."""
    v = log.groupBy("source", "key", "sha").agg(
        F.count(F.lit(1)).alias("_f"), F.max("fetched_at").alias("_t"), F.max("pub").alias("_p")
    )
    k = v.groupBy("source", "key").agg(
        F.count(F.lit(1)).alias("_v"), F.sum("_f").alias("_f"), F.max("_t").alias("_t"), F.max("_p").alias("_p")
    )
    return k.groupBy("source").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("_v").alias("versions"), F.sum("_f").alias("fetches"),
        F.max("_t").alias("newest_fetch"), F.max("_p").alias("newest_publication"),
    )


def snapshot(log: DataFrame) -> DataFrame:
    """Record counts and newest times per source used by a result."""
    return log.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetch_records"), F.max("fetched_at").alias("latest_fetch"),
        F.max("pub").alias("latest_publication"),
    )


def plan_missing(keys: DataFrame, log: DataFrame, key: Sequence[str], period: str, periods: Column, open_period: Column) -> DataFrame:
    """Expected (key, period) grid minus what is archived; the open period is always planned again."""
    grid = keys.select(*key, F.explode(periods).alias(period))
    done = log.select(*key, period).distinct()
    return grid.filter(F.col(period) < open_period).join(done, [*key, period], "left_anti").unionByName(
        grid.filter(F.col(period) == open_period)
    )


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Last row per identity in fetch order, with how many were dropped."""
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_s"), (F.count(F.lit(1)) - 1).alias("dropped"))
        .select(*keys, "_s.*", "dropped")
    )


def dedupe_strongest(df: DataFrame, keys: Sequence[str], c: str, payload: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Row with the largest |value| per identity; the tiebreak settles equals."""
    rank = F.struct(F.abs(F.col(c)), *[F.col(x) for x in tiebreak])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("_s")).select(*keys, "_s.*")
