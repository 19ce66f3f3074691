"""Merkle dataset manifest by lag and lead windows.

A document's leaf is the hash of its encoded columns. The leaves of a source, in the order of doc_id,
are joined three at a time, level by level, to the source's subroot, and the subroots likewise to the
root. Nodes are never collected per source:

* Places come from one range-partitioned sort: a row's place in its partition, plus what the partitions
  before it hold of the same group.
* The places of a group are cut into aligned blocks of SPAN = 3 ** LEVELS, so no run of three crosses a
  block on the lowest LEVELS levels. Inside a block a node of level k stands at its first leaf's row: the
  others of its run are lag and lead columns at the fixed offsets 3 ** k and 2 * 3 ** k, masked by the
  row's slot in the run and by the length of the group. The run's first-child row hashes the parent, and
  the other rows take a node's siblings from the last first-child row before them. All levels of a
  block share one exchange and one sort.
* A block leaves one node; blocks are the leaves of the next pass, until a group is one node.

A row's path holds the siblings left and right of it on every level up to the root, which is what the
proof is made of and what a changed leaf is folded with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

ARITY = 3
LEVELS = 6
SPAN = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
KEY = ["g0", "g1"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, with their place pos (from 0) in the order of their group (g0, g1), and the group's size n."""
    dealt = rows.repartitionByRange(*KEY, *order).sortWithinPartitions(*KEY, *order)
    numbered = cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = numbered.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("begin"))
    # one row per group and partition
    before = F.coalesce(F.sum("c").over(W.partitionBy(*KEY).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*KEY, "part", "begin", before.alias("before"), F.sum("c").over(W.partitionBy(*KEY)).alias("n"))
    met = numbered.join(counts, [*KEY, "part"])
    return met.withColumn("pos", F.col("at") - F.col("begin") + F.col("before")).drop("at", "part", "begin", "before")


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From nodes (g0, g1, pos, n, node, ...) to the tops of their groups.

    Returns the nodes with block and path (siblings up to the top of the block), and the blocks as (g0, g1,
    block, upper, top): the path from the block's top to the top of the group, and that top.
    """
    block = W.partitionBy(*KEY, "block").orderBy("pos")
    so_far = block.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).withColumn("n0", F.col("node"))
    none = F.lit("")
    for k in range(LEVELS):
        step = ARITY**k
        first = F.col("pos") % step == 0
        slot = F.floor(F.col("pos") / step) % ARITY
        here = first & (F.col("n") > step)
        around = {"b2": F.lag(f"n{k}", 2 * step), "b1": F.lag(f"n{k}", step), "a1": F.lead(f"n{k}", step), "a2": F.lead(f"n{k}", 2 * step)}
        x = x.select("*", *[c.over(block).alias(name) for name, c in around.items()])
        left = F.when(slot == 2, F.concat("b2", "b1")).when(slot == 1, F.col("b1")).otherwise(none)
        right = F.when(slot == 0, F.concat(F.coalesce("a1", none), F.coalesce("a2", none))).when(slot == 1, F.coalesce("a1", none)).otherwise(none)
        x = x.withColumn("beside", F.when(here, F.struct(left.alias("l"), right.alias("r"))))
        parent = F.when(here, digest(F.col(f"n{k}"), F.col("beside.r"))).otherwise(F.col(f"n{k}"))
        x = x.withColumn(f"n{k + 1}", F.when(F.col("pos") % (step * ARITY) == 0, parent))
        sides = F.col("beside") if k == 0 else F.last("beside", ignorenulls=True).over(so_far)
        x = x.withColumn(f"s{k}", F.when(F.col("n") > step, sides)).drop("b2", "b1", "a1", "a2", "beside")
    path = F.filter(F.array(*[f"s{k}" for k in range(LEVELS)]), lambda s: s.isNotNull())
    made = [f"n{k}" for k in range(LEVELS)] + [f"s{k}" for k in range(LEVELS)]
    done = cut(x.withColumn("path", path).withColumn("top", F.col(f"n{LEVELS}")).drop(*made, f"n{LEVELS}"))
    tops = done.filter(F.col("top").isNotNull()).select(*KEY, F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("node"))
    done = done.drop("top")
    if tops.filter("n > 1").isEmpty():
        nothing = F.filter(F.array(F.struct(none.alias("l"), none.alias("r"))), lambda s: F.lit(False))
        return done, tops.select(*KEY, F.col("pos").alias("block"), nothing.alias("upper"), F.col("node").alias("top"))
    below, above = climb(tops)
    joined = below.join(above, [*KEY, "block"])
    return done, joined.select(*KEY, F.col("pos").alias("block"), F.concat("path", "upper").alias("upper"), "top")


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and path of every document.

    `changed` is the text to verify against the manifest, the table's own text by default. path lists the
    siblings left (l) and right (r) of the document's branch from its leaf to the root, as concatenated
    hex digests. Null columns are encoded as `-`. Leaves of equal doc_id are in the order of their hashes,
    null ids come first; the null source comes first and is one source. Repeated rows are leaves of their
    own. A dataset of one document has its leaf as root and no siblings. An empty table gives an empty
    result; other columns are ignored.
    """
    text = F.col("text").cast("string")
    named = [F.col(c) for c in COLUMNS]
    leaf = digest(*[encoded(c) for c in named])
    other = leaf if changed is None else digest(*[encoded(c) for c in named[:-1]], encoded(changed))
    source = F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.isNotNull().alias("g0"), F.coalesce(source, F.lit("")).alias("g1"), leaf.alias("node"),
        F.when(text.isNull(), leaf).otherwise(other).alias("tampered"),
    ).withColumn("tie", F.monotonically_increasing_id())
    leaves, upper = climb(placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("tie")]))
    one = [F.lit(True).alias("g0"), F.lit("").alias("g1")]
    subroots = upper.filter("block = 0").select(*one, F.col("g0").alias("h0"), F.col("g1").alias("h1"), F.col("top").alias("node"))
    sources, tops = climb(placed(subroots, [F.col("h0"), F.col("h1")]))
    sources = sources.join(tops, [*KEY, "block"]).select(
        F.col("h0").alias("g0"), F.col("h1").alias("g1"), F.concat("path", "upper").alias("over"), F.col("top").alias("root")
    )
    blocks = upper.join(sources, KEY).select(*KEY, "block", F.concat("upper", "over").alias("upper"), F.col("top").alias("subroot"), "root")
    x = leaves.join(blocks, [*KEY, "block"]).withColumn("path", F.concat("path", "upper"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256)
    folded = F.aggregate("path", F.col("tampered"), lambda h, s: digest(s.l, h, s.r))
    x = x.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), "path")
    return x.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")


def lines_joined() -> Column:
    """The text, without its line breaks where crc32 of the doc_id is even."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))


def _enc(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_REST = " || ".join(_enc(c) for c in COLUMNS[:-1])
_SIBLINGS = """SELECT *, coalesce(string_agg(node, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""

ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, source, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, _: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)) AS c,
    {_REST} AS rest FROM documents),
leaf AS (SELECT doc_id, source, sha256(rest || {_enc('text')}) AS leaf,
  sha256(rest || CASE WHEN c IS NOT NULL AND xor(c, 4294967295::BIGINT) % 2 = 0 THEN {_enc("replace(text, chr(10), '')")} ELSE {_enc('text')} END) AS tampered FROM crc),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
tree AS (SELECT source, 0 AS level, pos, n, leaf AS node FROM numbered UNION ALL
  SELECT source, level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, level + 1, pos // 3),
sib AS ({_SIBLINGS} FROM tree WHERE n > 1 WINDOW b AS (PARTITION BY source, level, pos // 3 ORDER BY pos)),
walk AS (SELECT row_number() OVER () AS i, source, 0 AS level, pos, n, tampered AS h, '' AS proof FROM numbered UNION ALL
  SELECT i, w.source, w.level + 1, w.pos // 3, (w.n + 2) // 3, sha256(l || h || r), proof || l || r FROM walk w JOIN sib s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.pos = w.pos),
subroot AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS level, pos, n, node FROM subroot UNION ALL
  SELECT level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level + 1, pos // 3),
usib AS ({_SIBLINGS} FROM upper WHERE n > 1 WINDOW b AS (PARTITION BY level, pos // 3 ORDER BY pos)),
uwalk AS (SELECT i, 0 AS level, s.pos, s.n, h, proof FROM walk w JOIN subroot s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1 UNION ALL
  SELECT i, w.level + 1, w.pos // 3, (w.n + 2) // 3, sha256(l || h || r), proof || l || r FROM uwalk w JOIN usib s ON s.level = w.level AND s.pos = w.pos),
root AS (SELECT node FROM upper WHERE n = 1),
first AS (SELECT row_number() OVER () AS i, * FROM numbered)
SELECT doc_id, leaf, s.node AS subroot, root.node AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = root.node AS verified
FROM first JOIN uwalk u ON u.i = first.i AND u.n = 1 JOIN subroot s ON s.source IS NOT DISTINCT FROM first.source, root
"""
