"""Quality rules: text statistics of a document and the frequency of its lines across documents.

Only DataFrame functions run here. Statistics of one document are expressions over its own row
(arrays of word-window hashes, sorted and compared with their neighbours), so they need no shuffle.
Line frequency is a grouped count of distinct documents with map-side partials and one join against the
lines above the limit; a line that a third of all documents carry is one row on the counted side
and adaptive execution may split the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, bound, packed, row_key, text_or_empty, unpacked

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def paired(gap: int):
    """Each hash joined with the one `gap` places on; at the end, where there is none, with nothing."""
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more, by hashes of all windows.

    Windows are sorted by hash; equal neighbours are repeats. Their starts, sorted, cover
    min(8, gap to the next start) words each.
    """
    hashes = words
    for gap in (1, 2, 4):  # windows of two, four, eight words from pairs of windows of half the size
        hashes = bound(hashes, paired(gap))
    hashes = F.slice(hashes, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
            return F.sort_array(F.transform(twin, lambda x: x.i))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return bound(bound(ordered, starts), width)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    return bound(hashes, count)


def normal_line(line: Column) -> Column:
    """Lower case, runs of digits as one 0, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def lines_of(text: Column) -> Column:
    """(h, n, pos) of the lines with a word: hash of the normalised line, its words, its place."""
    marked = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    full = F.filter(marked, lambda s: s.x.rlike(WORD))
    return F.transform(
        full, lambda s: F.struct(F.xxhash64(normal_line(s.x)).alias("h"), F.regexp_count(s.x, F.lit(WORD)).alias("n"), s.i.alias("pos"))
    )


def frequent_lines(docs: DataFrame, host: str, min_docs: int) -> DataFrame:
    """(host, h): lines found in more than `min_docs` distinct documents of a host.

    A document is its doc_id; among rows without one, equal texts of a host are one document. Distinct
    documents are counted in two grouped steps, (host, line, document) and then (host, line), both with
    map-side partials, so neither a line of all documents nor a document of many rows meets in one task.
    """
    lines = F.array_distinct(F.transform(lines_of(text_or_empty()), lambda s: s.h))
    nameless = F.when(F.col("_none"), F.col("_k2")).otherwise(0).alias("_k2")
    seen = docs.select(*row_key("text", host), F.col("doc_id").isNull().alias("_none"), F.col(host).alias("_host"), lines.alias("_lines"))
    seen = seen.select("_host", "_k1", nameless, F.explode("_lines").alias("h"))
    counts = seen.groupBy("_host", "h").agg(F.count_distinct("_k1", "_k2").alias("n_docs"))
    return counts.filter(F.col("n_docs") > min_docs).select("_host", "h")


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = 20, min_words: int = 20, max_removed: float = 0.5) -> DataFrame:
    """What `quality_rules` returns, once for rows equal in id, text and host, and how many rows these are (times)."""
    rows = docs.select(*row_key("text", host), "doc_id", F.col(host).alias("_host"), text_or_empty().alias("text"))
    split = rows.select(
        "_k1", "_k2", "doc_id", "_host", "text",
        F.filter(F.split("text", WS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD)).alias("full"),
        lines_of(F.col("text")).alias("lines"),
    )
    stats = F.struct(
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    # a document without lines still gets one entry: its hash means nothing and it has no words
    lines = F.when(F.size("lines") > 0, F.col("lines")).otherwise(
        F.array(F.struct(F.col("_k2").alias("h"), F.lit(0).alias("n"), F.lit(0).alias("pos")))
    )
    with_stats = split.select("_k1", "_k2", "doc_id", "_host", stats.alias("stats"), lines.alias("lines"))
    each = with_stats.select("_k1", "_k2", "doc_id", "_host", "stats", F.posexplode("lines").alias("at", "line")).select(
        "_k1", "_k2", "doc_id", "_host", F.when(F.col("at") == 0, F.col("stats")).alias("stats"), "line.h", "line.n", "line.pos"
    )
    over = frequent_lines(docs, host, min_docs).select(F.col("_host").alias("_oh"), F.col("h").alias("_ox"))
    judged = each.join(over, (F.col("h") == F.col("_ox")) & F.col("_host").eqNullSafe(F.col("_oh")), "left")
    gone = F.col("_ox").isNotNull() & (F.col("n") > 0)
    per_doc = judged.groupBy("_k1", "_k2").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("stats").alias("stats"),
        F.count("stats").alias("times"),
        F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("gone_words"),
        F.sort_array(F.collect_set(F.when(gone, F.col("pos")))).alias("removed_lines"),
    )
    out = per_doc.select("_k1", "_k2", "doc_id", "times", "stats.*", "removed_lines", F.expr("gone_words div times").alias("n_removed_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~failed & (left >= min_words) & (F.col("n_removed_words") <= max_removed * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        kept.alias("kept"), "n_removed_words", "removed_lines", "_k1", "_k2", "times",
    )


def quality_rules(docs: DataFrame, **rules) -> DataFrame:
    """One row per row of `docs` with its statistics, the verdict and the lines to remove.

    A line is removed if more than `min_docs` distinct documents of its host carry it (normalised),
    however many documents the host has. A document is rejected if its own statistics fail, if fewer
    than `min_words` words are left, or if more than `max_removed` of its words were removed.

    Null or empty text: no words, rejected for that. Null host: a host of its own. Null doc_id: rows of
    equal text and host are one document in the count. Rows that repeat a doc_id count as one document;
    each has its own row in the result. An empty table gives an empty result. Other columns are ignored.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words, removed_lines (places of the removed lines, from 0) and the keys _k1, _k2.
    """
    found = verdicts(docs, **rules)
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def apply_quality(docs: DataFrame, **rules) -> DataFrame:
    """The kept documents with their frequent lines taken out; same columns, n_chars recounted."""
    host = rules.get("host", "source")
    verdict = verdicts(docs, **rules).filter("kept").select("_k1", "_k2", F.col("removed_lines").alias("_gone"))
    keyed = packed(docs, *row_key("text", host)).join(verdict, ["_k1", "_k2"])
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return unpacked(keyed, docs.columns, F.when(F.size("_gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8
),
hashed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM win),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 8) AS r(j) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
over AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20),
per AS (
  SELECT l.doc_id, count(*) - count(DISTINCT l.line) AS n_dup_lines,
         sum(CASE WHEN o.norm IS NOT NULL THEN l.n ELSE 0 END) AS n_removed_words
  FROM l LEFT JOIN over o ON l.norm = o.norm AND l.source IS NOT DISTINCT FROM o.source GROUP BY l.doc_id
),
s AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(per.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(per.n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN cover USING (doc_id)
),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words <= 0.5 * n_words) AS kept,
       n_removed_words
FROM f
"""
