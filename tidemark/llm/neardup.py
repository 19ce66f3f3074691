"""SimHash near-duplicates with pivot distance tables.

Fingerprints are reduced to their distinct values first, so any number of exact copies is one row. A
table then holds each value's Hamming distances to reference fingerprints (pivots) of two kinds.

* Six families of pivots: a family's members differ from one base in a single bit of its block of
  bits. A member is one nearer or one farther than the base, according to that bit, so a family's
  distances relative to the base are a +/-1 pattern: the bits of (value xor base) in the block, which
  is how they are computed. Two values at most 3 bits apart agree on all distances of at least three
  of six families, so pairs are looked for by an equi-join on three families' distances (20 keys of
  about 32 bits) and none is lost.
* Random pivots: a pair is dropped when its distances to any of them differ by more than 3 (the
  triangle inequality). Survivors are verified by their Hamming distance.

Groups of near copies never become all pairs. Neighbours in the order of values under a key are linked
first, which emits at most one row per value and key; then only pairs of different groups are joined.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, components, cut, packed, row_key, shuffled, unpacked

LIMIT = 3
FAMILIES = 6
SEED = 42
PIVOTS = 16
BASE = 0x6A09E667F3BCC908
#: Shingle hashes unpacked into bits at a time.
SLICE = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit i is set if it is set in over half of the hashes of all shingles of `size` words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else [tuple(words)]
    hashes = (xxhash.xxh64_digest(b" ".join(g), SEED) for g in grams)
    ones, n = np.zeros(64, np.int64), 0
    while part := b"".join(itertools.islice(hashes, SLICE)):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the keys _k1 and _k2, and the fingerprint fp (long) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3):
            prints = pa.array([fingerprint(t) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], prints], ["doc_id", "_k1", "_k2", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("text"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long")


def family_keys(fp: Column) -> Column:
    """The keys of a value: for each choice of three families, which three and their distances."""
    edges = [round(i * 64 / FAMILIES) for i in range(FAMILIES + 1)]
    seen = fp.bitwiseXOR(F.lit(BASE))
    blocks = [F.shiftrightunsigned(seen, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
    chosen = itertools.combinations(range(FAMILIES), FAMILIES - LIMIT)
    return F.array(*[F.xxhash64(F.lit(i), *[blocks[j] for j in c]) for i, c in enumerate(chosen)])


def pivot_table(values: DataFrame, pivots: int = PIVOTS, seed: int = 1) -> DataFrame:
    """The values with their distances to random pivots, eight to a long, a byte each."""
    rng = random.Random(seed)
    points = [rng.getrandbits(64) - (1 << 63) for _ in range(pivots)]
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in points]
    packed = []
    for i in range(0, pivots, 8):
        word = F.lit(0).cast("long")
        for j, d in enumerate(distance[i : i + 8]):
            word = word.bitwiseOR(F.shiftleft(d, 8 * j))
        packed.append(word.alias(f"d{i // 8}"))
    return values.select("*", *packed)


def within_pivots(a: str, b: str, pivots: int = PIVOTS) -> Column:
    """No coordinate differs by more than the limit."""
    gaps = []
    for i in range(pivots):
        x, y = (F.shiftright(F.col(f"{side}.d{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127)) for side in (a, b))
        gaps.append(F.abs(x - y))
    return F.greatest(*gaps) <= LIMIT


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= LIMIT


def link_values(values: DataFrame) -> DataFrame:
    """(fp, component): groups of distinct fingerprints connected by links of at most LIMIT bits."""
    keyed = pivot_table(values.select("fp")).withColumn("key", F.explode(family_keys(F.col("fp"))))
    before = F.lag("fp").over(W.partitionBy("key").orderBy("fp"))
    chain = keyed.select("fp", before.alias("other")).filter(near(F.col("fp"), F.col("other")))
    first = components(chain.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    grouped = cut(
        values.select("fp").join(first.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("part"))
    )
    keyed = pivot_table(grouped).withColumn("key", F.explode(family_keys(F.col("fp"))))
    a, b = keyed.alias("a"), keyed.alias("b")
    same_key = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.part") != F.col("b.part"))
    pairs = a.join(shuffled(b), same_key & within_pivots("a", "b") & near(F.col("a.fp"), F.col("b.fp")))
    second = components(pairs.select(F.col("a.part").alias("a"), F.col("b.part").alias("b")).distinct())
    joined = grouped.join(second.select(F.col("node").alias("part"), "component"), "part", "left")
    return joined.select("fp", F.coalesce("component", "part").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document, and the keys _k1, _k2.

    Documents link where their fingerprints differ in at most three bits; component_id is the
    smallest doc_id that can be reached, the document's own included. Also _first: whether the
    document is the one that stands for its group (smallest doc_id, nulls last, then smallest key).

    Null, empty and blank texts have the fingerprint zero and link like any other. Fewer than three
    words are one shingle. Null doc_ids group like others and name no component, unless alone (then
    component_id is null). Repeated rows are copies. An empty table gives an empty result; other
    columns are ignored.
    """
    prints = cut(fingerprints(docs))
    values = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = link_values(values)
    named = values.join(groups, "fp")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_value = named.join(smallest, "component").select("fp", "component_id", "component")
    heads = prints.join(per_value.select("fp", "component", F.col("component_id").alias("_c")), "fp").filter(F.col("doc_id").eqNullSafe(F.col("_c")))
    heads = heads.groupBy("component").agg(F.min("_k2").alias("_head"))
    per_value = per_value.join(heads, "component", "left").select("fp", "component_id", "_head")
    out = prints.join(per_value, "fp")
    stands = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("_k2") == F.col("_head"))
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_k1", "_k2", stands.alias("_first")
    )


def apply_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with the same columns; of repeated rows one."""
    stay = near_duplicates(docs).filter("_first").select("_k1", "_k2").distinct()
    kept = packed(docs, *row_key("text")).join(stay, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return unpacked(kept, docs.columns)
