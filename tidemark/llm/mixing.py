"""Mixing sources to target weights: Sainte-Laguë block quotas, then a seeded choice of blocks.

Sources get target token counts by weighted water filling. The targets become whole blocks of equal
token count, dealt by highest quotients t / (2k + 1): among sources, among bundles of a source's
shards, among the shards of a bundle. So a source that holds a third of all rows is spread over many
bounded shards, and no window holds more than a bundle of them. Within a shard the documents stand in
a seeded order, their tokens form one stream, and the quota takes blocks from its start, going round
once more where the quota exceeds the stream.

Only quotients near the cut are enumerated: the house is monotone, so a divisor that surely gives no
more than the seats fixes most of them in closed form. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.common import spread_join

from .common import WORD, cut, packed, row_key, text_or_empty, unpacked

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Shards in a bundle.
BUNDLE = 1024
SOURCE = ["_null", "_name"]


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Target tokens of each source: `share` of all tokens by weight, none above `most` times its size.

    Water filling in closed form. In the order of most * size / weight, sources are at their limit up
    to some point, and the others share by weight what is left; that point is the first source whose
    limit exceeds its level. `sizes` has one row per source, so its one window is small.
    """
    whole = W.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    needs = limits.withColumn("need", F.col("limit") / F.col("weight"))
    order = whole.orderBy("need", *SOURCE)
    below = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    among = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = needs.withColumn("level", (share * F.sum("source_size").over(whole) - below) / among)
    # levels fall from the first open source on, so the largest open one is the water level
    found = levels.withColumn("water", F.max(F.when(F.col("level") < F.col("need"), F.col("level"))).over(whole))
    target = F.when(F.col("need") > F.col("water"), F.col("water") * F.col("weight")).otherwise(F.col("limit"))
    return found.select(*SOURCE, "source_size", target.alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """The rows of `votes` with `blocks`: the `seats` of each group dealt by highest quotients.

    Ties go to the smaller key. A key without votes gets no seat. With q the exact share, s the keys
    and m the seats, each key gets between q (1 - s / 2m) and q (1 + s / 2m), up to rounding, so only
    those quotients are ranked: a few times as many rows as there are keys.
    """
    w = W.partitionBy(*([F.col(g) for g in group] or [F.lit(0)]))
    total = F.sum(F.col(vote).cast("double")).over(w)
    share = F.when(total > 0, F.col(vote) * F.col(seats) / total).otherwise(0.0)
    slack = F.count(F.lit(1)).over(w) / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    near = votes.withColumn("_share", share).withColumn("_slack", slack)
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") * (1 - F.col("_slack"))) - 1).cast("long"))
    near = near.withColumn("_open", F.col(seats) - F.sum("_sure").over(w))
    last = F.when(F.col(vote) > 0, F.ceil(F.col("_share") * (1 + F.col("_slack"))) + 1).otherwise(F.col("_sure")).cast("long")
    tried = near.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.greatest(last, F.col("_sure")))))
    tried = tried.withColumn("_q", F.when(F.col(vote) > 0, F.col(vote) / (2 * F.col("_k") + 1)))
    place = F.row_number().over(w.orderBy(F.col("_q").desc_nulls_last(), *key, "_k"))
    won = ((F.col("_place") <= F.col("_open")) & F.col("_q").isNotNull()).cast("long")
    dealt = tried.withColumn("_place", place).groupBy(*group, *key).agg((F.max("_sure") + F.sum(won)).alias("blocks"))
    return votes.join(dealt, [*group, *key])


def digest(seed: int, what: str) -> Column:
    """32 hex digits that depend on the seed, a name and the document's id."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(what), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 32, shard_tokens: int = 1 << 16, seed: int = 7
) -> DataFrame:
    """Words the mix takes of each document.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last in order. Null
    doc_id: a document like others. Repeated rows are separate documents that stand side by side in
    their shard. A table without words takes nothing; an empty table gives an empty result. Other
    columns are ignored.

    Returns doc_id, size, source_size, target (its source's), taken, and the keys _k1, _k2.
    """
    rows = docs.select(
        *row_key("text", "source"), "doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        digest(seed, "shard").alias("_shard_of"), digest(seed, "order").alias("_order"),
    )
    sized = cut(rows)
    sizes = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, share, most)
    house = F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block + 0.5).cast("long")
    sources = cut(sainte_lague(aims.withColumn("_seats", house), [], SOURCE, "target", "_seats"))
    sources = sources.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))

    info = sources.select(*SOURCE, "source_size", "target", "_shards")
    placed = spread_join(sized, info, SOURCE)
    shard = F.conv(F.substring("_shard_of", 1, 8), 16, 10).cast("long") % F.col("_shards")
    placed = placed.withColumn("_shard", shard).withColumn("_bundle", F.expr(f"_shard div {BUNDLE}"))
    shards = placed.groupBy(*SOURCE, "_bundle", "_shard").agg(F.sum("size").alias("shard_size"))
    bundles = shards.groupBy(*SOURCE, "_bundle").agg(F.sum("shard_size").alias("bundle_size"))
    bundles = bundles.join(sources.select(*SOURCE, F.col("blocks").alias("_of_source")), SOURCE)
    bundles = sainte_lague(bundles, SOURCE, ["_bundle"], "bundle_size", "_of_source")
    seats = bundles.select(*SOURCE, "_bundle", F.col("blocks").alias("_of_bundle"))
    quotas = sainte_lague(shards.join(seats, [*SOURCE, "_bundle"]), [*SOURCE, "_bundle"], ["_shard"], "shard_size", "_of_bundle")
    quota = F.col("blocks") * block

    at = W.partitionBy(*SOURCE, "_bundle", "_shard")
    before = F.sum("size").over(at.orderBy("_order", "size", "_k2").rowsBetween(W.unboundedPreceding, -1))
    streams = placed.join(quotas.select(*SOURCE, "_bundle", "_shard", "shard_size", "blocks"), [*SOURCE, "_bundle", "_shard"])
    streams = streams.withColumn("_before", F.coalesce(before, F.lit(0)))

    def covered(tokens: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), tokens - F.col("_before")))

    taken = covered(quota) + covered(quota - F.col("shard_size"))
    return streams.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "_k1", "_k2")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents with the text the mix takes: nothing (the row goes), the first words, or up to twice the text.

    A document taken in whole keeps its text; a part is its first words joined by single spaces; a
    second round is appended after a line feed. Same columns, n_chars recounted.
    """
    taken = mix_sources(docs, **how).groupBy("_k1", "_k2").agg(F.max("size").alias("_size"), F.max("taken").alias("_taken"))
    keyed = packed(docs, *row_key("text", "source")).join(taken.filter("_taken > 0"), ["_k1", "_k2"])
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)

    def first(n: Column) -> Column:
        return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")

    text = (
        F.when(F.col("_taken") < F.col("_size"), first(F.col("_taken")))
        .when(F.col("_taken") == F.col("_size"), F.col("text"))
        .when(F.col("_taken") < 2 * F.col("_size"), F.concat("text", F.lit("\n"), first(F.col("_taken") - F.col("_size"))))
        .otherwise(F.concat("text", F.lit("\n"), F.col("text")))
    )
    return unpacked(keyed, docs.columns, text)


ORACLE = r"""
WITH RECURSIVE z AS (
  SELECT doc_id, source IS NULL AS nu, coalesce(source, '') AS nm,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7/shard/' || doc_id), 1, 8) AS BIGINT) AS sh, md5('7/order/' || doc_id) AS ord
  FROM documents
),
s AS (
  SELECT nu, nm, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY nu, nm) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM z GROUP BY nu, nm
),
fill(round, level, pool, open) AS (
  -- share by weight among open sources; close those above their limit; repeat until none is
  SELECT 0, 1.5 * sum(source_size)::DOUBLE / sum(weight), 1.5 * sum(source_size)::DOUBLE, list(nm || nu::VARCHAR) FROM s
  UNION ALL
  SELECT * FROM (
    SELECT f.round + 1 AS round,
           (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - (SELECT coalesce(sum(2.0 * source_size), 0) FROM s WHERE 2.0 * source_size / weight <= f.level))
             / (SELECT sum(weight) FROM s WHERE 2.0 * source_size / weight > f.level) AS level,
           f.pool, (SELECT list(nm || nu::VARCHAR) FROM s WHERE 2.0 * source_size / weight > f.level) AS open
    FROM fill f WHERE f.round < 200
  ) WHERE level IS NOT NULL AND round <= (SELECT count(*) FROM s)
),
water AS (SELECT max(level) AS level FROM fill),
aim AS (
  SELECT s.*, CASE WHEN 2.0 * source_size / weight > level THEN level * weight ELSE 2.0 * source_size END AS target
  FROM s, water
),
q1 AS (
  SELECT nu, nm, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nu, nm, k) AS place
  FROM aim, range(0, 100000) AS r(k) WHERE target > 0 AND k <= 2 * target / 32 + 2
),
b1 AS (
  SELECT nu, nm, count(*) AS blocks FROM q1
  WHERE place <= (SELECT CAST(floor(sum(target) / 32 + 0.5) AS BIGINT) FROM aim) GROUP BY nu, nm
),
p AS (
  SELECT z.*, aim.source_size, aim.target, coalesce(b1.blocks, 0) AS of_source,
         sh % greatest(1, CAST(ceil(aim.source_size / 65536.0) AS BIGINT)) AS shard
  FROM z JOIN aim USING (nu, nm) LEFT JOIN b1 USING (nu, nm)
),
v AS (SELECT nu, nm, shard, sum(size) AS shard_size, max(of_source) AS of_source FROM p GROUP BY nu, nm, shard),
q2 AS (
  SELECT nu, nm, shard, of_source,
         row_number() OVER (PARTITION BY nu, nm ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
  FROM v, range(0, 100000) AS r(k) WHERE shard_size > 0 AND k <= 2 * of_source + 1
),
b2 AS (SELECT nu, nm, shard, count(*) * 32 AS quota FROM q2 WHERE place <= of_source GROUP BY nu, nm, shard),
t AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, v.shard_size, coalesce(b2.quota, 0) AS quota,
         coalesce(sum(p.size) OVER (PARTITION BY p.nu, p.nm, p.shard ORDER BY p.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM p JOIN v USING (nu, nm, shard) LEFT JOIN b2 USING (nu, nm, shard)
)
SELECT doc_id, size, source_size, target,
       CAST(least(size, greatest(0, quota - c)) + least(size, greatest(0, quota - shard_size - c)) AS BIGINT) AS taken
FROM t
"""
