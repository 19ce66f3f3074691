"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct shingles of SIZE words. Two sets link at a Jaccard
similarity of LIMIT percent or more. A set of n shingles can only link if it shares one of its first
n - ceil(LIMIT * n / 100) + 1 in any order that all sets have in common; the order here is rare first, by
the number of sets that hold a shingle.

* Most documents hold so many shingles of their own that they cannot link with anything. They are told
  by an exact count over a quarter of the hash range (SAMPLE_BITS): a shingle counted once there is in no
  other set, and a set with a prefix's worth of such shingles is out. The count goes through packed
  messages from slices of documents to buckets of hashes, and back.
* Equal sets among the others become one. Their shingles are counted in full, those found in one set only
  come first and need no row, and the rest of a set is sorted by (count, hash).
* Prefix shingles are joined, under three filters. Length: the smaller set has LIMIT percent of the larger
  one. Positional: what can still be shared after a common shingle is enough. Suffix: of the shingles
  that follow a set's own ones, the number in each of 64 * WORDS parts of the hash range is odd or even, a
  bit; every differing bit is a shingle in one set only, like the sets' own ones. Where a pair's first common
  shingle is known, no shingle before it is shared. A pair that is left is verified once, by the size of
  the intersection.
* A group of near copies is not expanded into all pairs: under a prefix shingle, sorted by a minimum hash, a
  set is held against the LOOK before it, and the nearest by the filters is verified. The groups that come
  of it go through a second such pass, by another minimum hash, against sets of other groups. Then only
  prefix shingles that several groups share are joined, between groups.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import spread_join

from .common import chunks, components, cut, release, row_key

SIZE = 4
LIMIT = 85
#: Shingles whose hash has this many leading zero bits are counted for the first filter.
SAMPLE_BITS = 2
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Longs that hold the bits of the suffix filter.
WORDS = 8
BITS = [f"f{i}" for i in range(WORDS)]
#: Sets before it that a set is held against when groups are first made; the join finds whatever that leaves.
LOOK = 16
#: Slots of the bitmap that spares most texts the join with the open sets; 2 MB, whatever the input.
SLOTS = 1 << 24
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, in order; a long text is split slice by slice."""
    import xxhash

    data, at, parts = (text or "").encode().lower(), 0, [np.zeros(0, np.uint64)]
    while at < len(data):
        space = SPACE.search(data, min(at + SLICE, len(data)))
        end = space.start() if space else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end + 1
    return np.concatenate(parts)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of all shingles; of the whole sequence if it is shorter, none if there is no word."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ words[i : len(words) - size + 1 + i]) * MIX[i % 4]
            out ^= out >> np.uint64(29)
        out *= MIX[0]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def least_overlap(n: Column) -> Column:
    """ceil(LIMIT * n / 100)"""
    return F.floor((n * LIMIT + 99) / 100)


def prefix_size(n: Column) -> Column:
    return n - least_overlap(n) + 1


def enough(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles with so many in common link."""
    return 100 * shared >= LIMIT * (a + b - shared)


def read_sets(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per slice of documents: slice id, the documents and, by bucket, the counted hashes and whose they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("text"), F.col("text").cast("string").alias("text"))
    doc = "struct<doc_id:bigint,k1:bigint,k2:bigint,n:bigint,s0:bigint,s1:bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3):
            sets = [shingles(t) for t in batch.column(3).to_pylist()]
            digests = [set_digest(s) for s in sets]
            told = [s[: np.searchsorted(s, np.uint64(1 << (64 - SAMPLE_BITS)))] for s in sets]
            counted = np.concatenate([np.zeros(0, np.uint64), *told])
            whose = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(t) for t in told])
            bucket = (counted >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key = counted.astype(np.uint32)[order]
            whose = whose[order]
            parts = [
                {"bucket": b, "keys": key[i:j].tobytes(), "whose": whose[i:j].tobytes()} for b, (i, j) in enumerate(itertools.pairwise(edges.tolist())) if j > i
            ]
            listed = zip(*(c.to_pylist() for c in batch.columns[:3]), (len(s) for s in sets), digests)
            of = [{"doc_id": d, "k1": a, "k2": b, "n": n, "s0": s[0], "s1": s[1]} for d, a, b, n, s in listed]
            yield pa.RecordBatch.from_pylist([{"docs": of, "parts": parts}], schema=ARROW)

    kinds = {"doc_id": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "n": pa.int64(), "s0": pa.int64(), "s1": pa.int64()}
    part = pa.struct({"bucket": pa.int32(), "keys": pa.binary(), "whose": pa.binary()})
    ARROW = pa.schema({"docs": pa.list_(pa.struct(kinds)), "parts": pa.list_(part)})
    found = rows.mapInArrow(run, f"docs array<{doc}>, parts array<struct<bucket:int,keys:binary,whose:binary>>")
    return cut(found.withColumn("slice", F.monotonically_increasing_id()))


def singles(bucket: pa.Table) -> pa.Table:
    """Of each slice, how many hashes of each document occur once in the whole bucket (as far as 32 bits tell)."""
    keys = [np.frombuffer(k, np.uint32) for k in bucket["keys"].to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    alone = np.ones(len(every), bool)
    same = ordered[1:] == ordered[:-1]
    alone[order[1:][same]] = False
    alone[order[:-1][same]] = False
    slices, out, begin = [], [], 0
    for s, k, w in zip(bucket["slice"].to_pylist(), keys, bucket["whose"].to_pylist()):
        own = np.frombuffer(w, np.uint32)[alone[begin : begin + len(k)]]
        begin += len(k)
        if len(own):
            slices.append(s)
            out.append(np.bincount(own).astype(np.uint32).tobytes())
    return pa.table([pa.array(slices, pa.int64()), pa.array(out, pa.binary())], names=["slice", "counts"])


def added(replies: pa.Table) -> pa.Table:
    """The counts of a slice's documents over all buckets."""
    total = np.zeros(0, np.int64)
    for c in replies["counts"].to_pylist():
        c = np.frombuffer(c, np.uint32)
        if len(c) > len(total):
            total = np.pad(total, (0, len(c) - len(total)))
        total[: len(c)] += c
    at = np.flatnonzero(total)
    return pa.table([pa.array(np.full(len(at), replies["slice"][0].as_py()), pa.int64()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slice", "at", "own"])


def read_and_filter(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n, s0, s1 of every document and open: whether it may link with another one."""
    slices = read_sets(docs, buckets=max(16, 4 * docs.rdd.getNumPartitions()))
    parts = slices.select("slice", F.explode("parts").alias("p")).select("slice", "p.*")
    replies = parts.groupBy("bucket").applyInArrow(singles, "slice long, counts binary")
    own = replies.groupBy("slice").applyInArrow(added, "slice long, at int, own long")
    every = slices.select("slice", F.posexplode("docs").alias("at", "d")).select("slice", "at", "d.*")
    told = every.join(own, ["slice", "at"], "left")
    maybe = (F.col("n") > 0) & (F.coalesce("own", F.lit(0)) < prefix_size(F.col("n")))
    out = cut(told.select("doc_id", "k1", "k2", "n", "s0", "s1", maybe.alias("open")))
    release(slices)
    return out


def hashed_sets(docs: DataFrame) -> DataFrame:
    """The rows of (k1, k2, text, ...) with the set's hashes and two minimum hashes in the place of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            with np.errstate(over="ignore"):
                least = [[int((s * m).min().view(np.int64)) if len(s) else 0 for s in sets] for m in MIX[1:3]]
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *(pa.array(m, pa.int64()) for m in least)]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "hashes", "m0", "m1"])

    return docs.mapInArrow(run, "sid long, hashes array<long>, m0 long, m1 long")


PREFIX = "sid long, m0 long, m1 long, n long, hash long, place int, own int, " + ", ".join(f"{f} long" for f in BITS)


def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix rows of sets (sid, m0, m1, n, shared in global order): hash, its place, shingles of the set's own, bits of the rest."""
    for batch in batches:
        heads, bits, hashes, places, owns = [], [], [], [], []
        shared = batch.column(4)
        values, ends = shared.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(shared).to_numpy())
        for row, n in enumerate(batch.column(3).to_pylist()):
            rest = values[ends[row - 1] if row else 0 : ends[row]]
            own = n - len(rest)
            take = min(n - (LIMIT * n + 99) // 100 + 1 - own, len(rest))
            if take <= 0:
                continue
            spot = ((rest.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * WORDS)).astype(np.int64)
            odd = np.bincount(spot, minlength=64 * WORDS).astype(np.uint8) & 1
            bits.append(np.broadcast_to(np.packbits(odd).view(np.int64), (take, WORDS)))
            heads.append(np.full(take, row))
            hashes.append(rest[:take])
            places.append(np.arange(own, own + take))
            owns.append(np.full(take, own))
        if heads:
            at = pa.array(np.concatenate(heads))
            columns = [batch.column(i).take(at) for i in range(4)] + [pa.array(np.concatenate(hashes))]
            columns += [pa.array(np.concatenate(c), pa.int32()) for c in (places, owns)]
            flags = np.concatenate(bits)
            columns += [pa.array(np.ascontiguousarray(flags[:, i])) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "m0", "m1", "n", "hash", "place", "own", *BITS])


def in_line(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (hash, sid, part, n, own, bits), each set b with the nearest a of the LOOK before it under the hash, another part's."""
    kept = None
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        had = 0 if kept is None else len(kept[0])
        h, sid, part, n, own, *bits = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        kept = [x[-LOOK:] for x in (h, sid, part, n, own, *bits)]
        best, of = np.full(len(h), np.inf), np.zeros(len(h), np.int64)
        for back in range(1, min(LOOK, len(h) - 1) + 1):
            a, b = slice(None, -back), slice(back, None)
            apart = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits) + own[a] + own[b]
            both = n[a] + n[b]
            shared = (both - apart) >> 1
            fit = (h[a] == h[b]) & (part[a] != part[b]) & (100 * np.minimum(n[a], n[b]) >= LIMIT * np.maximum(n[a], n[b])) & (100 * shared >= LIMIT * (both - shared))
            far = np.where(fit, apart / both, np.inf)
            nearer = far < best[b]
            best[b][nearer] = far[nearer]
            of[b][nearer] = sid[a][nearer]
        best[:had] = np.inf
        found = np.flatnonzero(best < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(of[found]), pa.array(sid[found]), pa.array(best[found])], ["a", "b", "far"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; the intersection needs only hashes that several sets hold."""
    each = sets.select("sid", "n", "shared")  # one exchange serves both joins
    one = pairs.join(each, F.col("a") == F.col("sid")).select("a", "b", F.col("n").alias("na"), F.col("shared").alias("ha"))
    two = one.join(each, F.col("b") == F.col("sid")).select("a", "b", "na", "ha", F.col("n").alias("nb"), F.col("shared").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return two.filter(enough(both.cast("long"), F.col("na"), F.col("nb"))).select("a", "b")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, part) with the parts joined that verified links (a, b) connect."""
    named = links.join(parts.select(F.col("sid").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("sid").alias("b"), F.col("part").alias("pb")), "b")
    groups = components(named.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    joined = parts.join(groups.select(F.col("node").alias("part"), "component"), "part", "left")
    return cut(joined.select("sid", F.coalesce("component", "part").alias("part")))


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups (part) that share a prefix hash and pass the filters."""
    several = rows.groupBy("hash").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("hash")
    met = cut(rows.join(several, "hash"))
    a, b = met.alias("a"), met.alias("b")
    na, nb, i, j = F.col("a.n"), F.col("b.n"), F.col("a.place"), F.col("b.place")
    apart = sum((F.bit_count(F.col(f"a.{f}").bitwiseXOR(F.col(f"b.{f}"))) for f in BITS), F.col("a.own") + F.col("b.own"))
    length = 100 * F.least(na, nb) >= LIMIT * F.greatest(na, nb)
    # at any common shingle: what comes before may be shared as well, but for the sets' own
    positional = F.least(i - F.col("a.own"), j - F.col("b.own")) + F.least(na - i, nb - j)
    suffix = F.shiftright(na + nb - apart, 1)
    met = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.part") < F.col("b.part")) & length & enough(F.least(positional, suffix), na, nb)
    pairs = a.join(b, met).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"), na.alias("na"), nb.alias("nb"), i.alias("i"), j.alias("j"))
    first = pairs.groupBy("a", "b").agg(F.min_by(F.struct("na", "nb", "i", "j"), "i").alias("f")).select("a", "b", "f.*")
    # nothing before the first common shingle is shared
    positional = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))
    return first.filter(enough(positional, F.col("na"), F.col("nb"))).select("a", "b")


def link_sets(sets: DataFrame) -> DataFrame:
    """(sid, component) of distinct sets (sid, n, m0, m1, hashes)."""
    each = sets.select("sid", F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = each.join(common, "hash").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("c", "hash"))).alias("x"))
    ordered = cut(sets.join(met, "sid").select("sid", "m0", "m1", "n", F.col("x.hash").alias("shared")))
    rows = cut(ordered.mapInArrow(prefixes, PREFIX))

    parts = sets.select("sid", F.col("sid").alias("part"))
    for by in ("m0", "m1"):
        line = rows.join(parts, "sid").select("hash", "sid", "part", "n", F.col("own").cast("long").alias("own"), *BITS, by)
        line = line.repartitionByRange("hash", by, "sid").sortWithinPartitions("hash", by, "sid").drop(by)
        nearest = line.mapInArrow(in_line, "a long, b long, far double").groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a"))
        parts = merged(parts, verified(nearest.select("a", "b"), ordered))
    return merged(parts, verified(candidates(rows.join(parts, "sid")), ordered)).withColumnRenamed("part", "component")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link where their sets of distinct 4-word shingles (A-Z lower-cased) have a Jaccard similarity of
    0.85 or more; component_id is the smallest doc_id that can be reached, the document's own included.
    Fewer than four words are one shingle. Null, empty and blank texts have no shingle and link with
    nothing. Null doc_ids link like others and name no component, unless alone (then component_id is
    null). Every input row gives a row, repeated ones too; an empty table gives an empty result; other
    columns are ignored. Shingles are told apart by 64 bits, equal sets by 128.
    """
    told = read_and_filter(docs)
    same = told.filter("open").groupBy("s0", "s1").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2")).alias("place"), F.max("n").alias("n"))
    same = cut(same.withColumn("sid", F.monotonically_increasing_id()))
    wanted = same.select("sid", F.col("place.k1").alias("_k1"), F.col("place.k2").alias("_k2"))
    slot = F.pmod(F.col("_k2"), F.lit(SLOTS))
    bitmap = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(_k2, {SLOTS}) & 63 AS INT))")).alias("bits"))
    rows = docs.select(*row_key("text"), F.col("text").cast("string").alias("text"))
    likely = rows.join(F.broadcast(bitmap), F.shiftright(slot, 6) == F.col("word")).filter(F.expr(f"bit_get(bits, CAST(pmod(_k2, {SLOTS}) & 63 AS INT)) = 1"))
    texts = likely.select("_k1", "_k2", "text").join(wanted, ["_k1", "_k2"]).select("sid", "text")
    hashed = hashed_sets(texts).dropDuplicates(["sid"])
    sets = cut(hashed.select("sid", F.size("hashes").cast("long").alias("n"), "m0", "m1", "hashes"))
    linked = same.select("s0", "s1", "sid", "first_id").join(link_sets(sets), "sid")
    named = linked.join(linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("s0", "s1", "component_id")
    of_open = spread_join(told.filter("open").select("doc_id", F.col("n").alias("n_shingles"), "s0", "s1"), named, ["s0", "s1"])
    return of_open.select("doc_id", "n_shingles", "component_id").union(told.filter("not open").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
