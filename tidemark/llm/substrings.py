"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier goes.

All 100-byte strings (windows) of the corpus are compared, but no window is shuffled on its own.

1. Fragments. Each window is assigned to an anchor: the place of its smallest 40-byte hash, leftmost on
   ties. The choice depends on the window's content alone, so equal windows have equal anchors at equal
   distances. Windows of one anchor are consecutive; together they are one fragment, a string of
   about 130 bytes that is shipped as two hashes and a place. Equal fragments of a task are reduced to
   their first before the shuffle, which deals fragments out by anchor.
2. Equal fragments are one string of the collection. All its occurrences but the first lose all their
   windows. Anchors whose fragments are all equal need nothing more.
3. Where an anchor has several different strings, their texts are fetched, once each, and compared by
   their Burrows-Wheeler transforms. Strings are dealt into shards; each shard's transform is built on
   its own; the transforms are merged by refining an interleave: round by round one more symbol decides
   the order, by one stable counting pass over the interleaved transforms, and blocks of suffixes with
   a common prefix split. After 100 bytes the blocks that are left are the repeated intervals: equal
   windows of different strings, of which all but the first go. No suffix of the union is sorted anew.
4. The windows of an anchor with very many different strings are dealt out once more by their own hash
   and reduced as in 2, so no group is ever held together.

A symbol of the transforms is a block of bytes, ranked within a batch, so that 100 bytes take 20 rounds
(or 25 to 100, where a batch has too many different blocks).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import spread_join

from .common import cut

WINDOW, GRAM = 100, 40
#: Bytes handled at once, and the bits of a place within them.
SLICE, PLACE_BITS = 4 << 20, 23
#: More different strings at an anchor than this are dealt out window by window.
MANY = 256
#: Batch and shard sizes of the transforms, in bytes.
BATCH, SHARD = 1 << 17, 1 << 15
BASE = 0x9E3779B97F4A7C15
LAST = 2**63 - 1
NONE = np.uint16(65535)
FRAGMENT = "anchor long, id long, _k1 long, _k2 int, start int, n int"
STRING = "anchor long, _k1 long, _k2 int, start int, n int, many int, text binary"
RANGE = "_k1 long, _k2 int, start int, n int"


def keys() -> list[Column]:
    """The document's place in order: its id (null last), then a hash that tells rows of one id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_k1"), F.hash(F.col("doc_id").isNull(), F.col("text")).alias("_k2")]


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(*keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def fragments(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of all fragments of the texts raw[begin:end]."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * powers(pow(BASE, -1, 1 << 64), n - GRAM + 1)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, WINDOW - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & mask).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    ok = end - begin >= WINDOW
    inside[begin[ok]] += 1
    inside[end[ok] - WINDOW + 1] -= 1
    window = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
    at = anchor[window]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (np.diff(at) != 0) | (np.diff(window) != 1)]))
    return window[first], np.diff(np.concatenate([first, [len(window)]])), hashes[at[first]]


def pieces(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Texts of a task in buffers of at most SLICE bytes.

    Yields the buffer, where each piece begins and ends in it, the place of a piece in its text, and the
    other columns' values. A text longer than a slice comes in pieces that overlap by a window less a
    byte, so each of its windows is in one piece.
    """
    held: list[bytes] = []
    offset: list[int] = []
    values: list[tuple] = []

    def out():
        size = np.array([len(x) for x in held], np.int64)
        end = np.cumsum(size)
        return b"".join(held), end - size, end, np.array(offset, np.int64), [np.array(v) for v in zip(*values)]

    total = 0
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != column]
        for i, text in enumerate(batch.column(column)):
            raw = text.as_py().encode()
            for at in range(0, max(1, len(raw) - WINDOW + 1), SLICE):
                part = raw[at : at + SLICE + WINDOW - 1]
                if held and total + len(part) > SLICE:
                    yield out()
                    held, offset, values, total = [], [], [], 0
                held.append(part)
                offset.append(at)
                values.append(tuple(c[i] for c in others))
                total += len(part)
    if held:
        yield out()


def table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns)], [n for n, _ in fields])


def merged_ranges(k1, k2, start, n) -> list[np.ndarray]:
    """Ranges of windows, with those that continue one another joined."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start, n = k1[order], k2[order], start[order], n[order]
    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(k1)), bool), (np.diff(k1) != 0) | (np.diff(k2) != 0) | (start[1:] > start[:-1] + n[:-1])]))
    stop = np.maximum.reduceat(start + n, fresh) if len(fresh) else start
    return [k1[fresh], k2[fresh], start[fresh], stop - start[fresh]]


def reduced(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Fragments of a task: the first of equal ones; the others as ranges that are surely repeats.

    Ranges carry a key of their own and id 0 with negative n, so the shuffle spreads them evenly.
    """
    anchor, ident, k1, k2, start, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((start, k2, k1, ident, anchor))
    anchor, ident, k1, k2, start, n = (c[order] for c in (anchor, ident, k1, k2, start, n))
    first = np.concatenate([np.ones(min(1, len(anchor)), bool), (np.diff(anchor) != 0) | (np.diff(ident) != 0)])
    same = np.concatenate([np.zeros(min(1, len(anchor)), bool), (np.diff(k1) == 0) & (np.diff(k2) == 0) & (np.diff(start) == 0)]) & ~first
    again = ~first & ~same
    r1, r2, rs, rn = merged_ranges(k1[again], k2[again], start[again], n[again])
    spread = (r1 * 1_000_003 + r2 * 8191 + rs) * 0x5851F42D4C957F2D
    return table(
        FRAGMENT, np.concatenate([anchor[first], spread]), np.concatenate([ident[first], np.zeros(len(r1), np.int64)]),
        np.concatenate([k1[first], r1]), np.concatenate([k2[first], r2]).astype(np.int32),
        np.concatenate([start[first], rs]).astype(np.int32), np.concatenate([n[first], -rn]).astype(np.int32),
    )


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All fragments of a task's documents (_k1, _k2, text)."""
    import xxhash

    parts: list[list[np.ndarray]] = []
    held = 0
    for raw, begin, end, offset, (k1, k2) in pieces(batches, 2):
        start, n, anchor = fragments(np.frombuffer(raw, np.uint8), begin, end)
        ident = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + WINDOW - 1).tolist())], np.uint64)
        which = np.searchsorted(end, start, side="right")
        parts.append([anchor.view(np.int64), ident.view(np.int64), k1[which], k2[which], start - begin[which] + offset[which], n])
        held += len(start)
        if held > 1_000_000:
            yield reduced(parts)
            parts, held = [], 0
    if held:
        yield reduced(parts)


def scan_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of strings (_k1, _k2, start, n, text), each its own fragment."""
    import xxhash

    parts: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        for k1, k2, start, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[i : i + WINDOW]) for i in range(n)]), np.int64).reshape(-1, 2)
            parts.append([hashes[:, 0], hashes[:, 1], np.full(n, k1), np.full(n, k2), np.arange(start, start + n), np.ones(n, np.int64)])
            held += n
        if held > 1_000_000:
            yield reduced(parts)
            parts, held = [], 0
    if held:
        yield reduced(parts)


OUT = f"kind int, {FRAGMENT}"
REPEAT, DIFFERS = 0, 1


def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in the order of (anchor, id, document, start): repeats, and firsts of several strings at an anchor.

    One pass that remembers a row: the latest first occurrence that is still alone at its anchor.
    """
    previous = None  # anchor, id, k1, k2, start, n, and whether it was given out (or is no candidate)
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if previous is not None:
            cols = [np.concatenate([np.array([p], c.dtype), c]) for p, c in zip(previous[:6], cols)]
        anchor, ident, k1, k2, start, n = cols
        same_anchor = np.concatenate([[False], np.diff(anchor) == 0])
        same_id = same_anchor & np.concatenate([[False], np.diff(ident) == 0])
        known = n < 0
        first = ~same_id & ~known
        head = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
        copy = (k1 == k1[head]) & (k2 == k2[head]) & (start == start[head])  # the same row of the input once more
        again = (same_id & ~known & ~copy) | known
        at = np.flatnonzero(first)
        near = anchor[at[1:]] == anchor[at[:-1]]
        several = np.zeros(len(at), bool)
        several[1:] |= near
        several[:-1] |= near
        if previous is not None and len(at) and at[0] == 0 and previous[6]:
            # it was given out already; what follows at its anchor still counts as one of several
            several[0] = False
        picked = at[several]
        out = np.flatnonzero(again)
        if previous is not None:
            out = out[out > 0]
        rows = np.concatenate([out, picked])
        kind = np.concatenate([np.full(len(out), REPEAT), np.full(len(picked), DIFFERS)])
        yield table(OUT, kind.astype(np.int32), anchor[rows], ident[rows], k1[rows], k2[rows], start[rows], np.abs(n[rows]))
        if len(at):
            last = at[-1]
            given = bool(several[-1]) or (previous is not None and last == 0 and previous[6])
            previous = [c[last] for c in cols] + [given]


def local_order(sym: np.ndarray, step: int) -> np.ndarray:
    """Order of a shard's suffixes by at least their first 100 bytes: ranks of ever longer prefixes, doubling."""
    rank, span = sym.astype(np.int64), step
    while span < WINDOW:
        later = np.concatenate([rank[span:], np.zeros(min(span, len(rank)), np.int64)])[: len(rank)]
        # a suffix that ends within its prefix differs from all others there
        joined = np.where(rank > 0, rank * (len(rank) + 65536) + later, 0)
        _, rank = np.unique(joined, return_inverse=True)
        if joined.min(initial=1) > 0:
            rank += 1
        span *= 2
    return np.argsort(rank, kind="stable")


def repeated_windows(strings: list[bytes], shard_bytes: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, place) of all windows that occur more than once in the strings.

    The transforms of the shards are merged by interleave refinement; see the module's text.
    """
    size = np.array([len(s) for s in strings], np.int64)
    # a byte of room after each string: the empty suffix
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    string = np.repeat(np.arange(len(strings)), size + 1)
    place = np.arange(len(raw)) - begin[string]
    left = size[string] - place
    for step in (5, 4, 2, 1):
        gram = np.zeros(len(raw), np.uint64)
        for i in range(step):
            gram = gram << np.uint64(8)
            gram[: len(raw) - i] |= raw[i:].astype(np.uint64)
        whole = left >= step
        distinct, number = np.unique(gram[whole], return_inverse=True)
        if len(distinct) < int(NONE) - 1:
            break
    # symbol of a suffix: its first block, from 1; 0 where the string ends within the block
    sym = np.zeros(len(raw), np.uint16)
    sym[whole] = number + 1
    before = np.full(len(raw), NONE, np.uint16)
    before[place >= step] = sym[np.flatnonzero(place >= step) - step]
    shard_of = np.cumsum(size + 1) // shard_bytes
    shard_of = np.minimum(np.searchsorted(np.unique(shard_of), shard_of), 254)
    edges = np.flatnonzero(np.diff(shard_of, prepend=-1, append=-1))
    bounds = np.append(begin, len(raw))[edges]
    suffixes, transform, ends_of = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        order = a + local_order(sym[a:b], step)
        suffixes.append(order)
        transform.append(before[order])
        ends_of.append(int((sym[a:b] == 0).sum()))
    suffix = np.concatenate(suffixes)
    lengths = [len(x) for x in suffixes]
    # suffixes that end within a block come first, shard by shard, in every round
    terminal = np.repeat(np.arange(len(lengths)), ends_of).astype(np.uint8)
    interleave = np.repeat(np.arange(len(lengths)), lengths).astype(np.uint8)
    block = np.zeros(len(raw), np.int32)
    placed = len(raw) - len(terminal)
    woven = np.empty(len(raw), np.uint16)
    for _ in range(WINDOW // step):
        for shard, part in enumerate(transform):
            woven[interleave == shard] = part
        order = np.argsort(woven, kind="stable")[:placed]
        symbol, old = woven[order], block[order]
        fresh = np.ones(placed, bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        block = np.concatenate([np.zeros(len(terminal), np.int32), np.cumsum(fresh, dtype=np.int32)])
        interleave = np.concatenate([terminal, interleave[order]])
    row = np.empty(len(raw), np.int64)
    row[np.argsort(interleave, kind="stable")] = suffix
    full = left[row] >= WINDOW
    block, row = block[full], row[full]
    times = np.bincount(block)
    several = times[block] > 1
    return block[several], string[row[several]], place[row[several]]


def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows among strings (anchor, _k1, _k2, start, n, text) sorted by anchor."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, start = (np.array(c, np.int64) for c in list(zip(*rows))[1:4])
        interval, string, place = repeated_windows([r[5] for r in rows])
        k1, k2, at = k1[string], k2[string], start[string] + place
        order = np.lexsort((at, k2, k1, interval))
        interval, k1, k2, at = interval[order], k1[order], k2[order], at[order]
        again = np.concatenate([np.zeros(min(1, len(at)), bool), np.diff(interval) == 0])
        return table(RANGE, *merged_ranges(k1[again], k2[again].astype(np.int32), at[again], np.ones(int(again.sum()), np.int64)))

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held > BATCH and row[0] != rows[-1][0]:
                yield out(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
    if rows:
        yield out(rows)


def settled(found: DataFrame) -> DataFrame:
    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "id", "_k1", "_k2", "start")
    return ordered.mapInArrow(settle, OUT)


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The strings of fragments (anchor, _k1, _k2, start, n) with their bytes, text."""
    per_doc = wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("anchor", "start", "n", "many")).alias("asked"))

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = []
                for k1, k2, text, asked in zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns)):
                    raw = text.encode()
                    rows += [(x["anchor"], k1, k2, x["start"], x["n"], x["many"], raw[x["start"] : x["start"] + x["n"] + WINDOW - 1]) for x in asked]
                yield table(STRING, *zip(*rows))

    met = rows_of(docs).join(per_doc, ["_k1", "_k2"]).select("_k1", "_k2", "text", "asked")
    return met.mapInArrow(slices, STRING).dropDuplicates(["anchor", "_k1", "_k2", "start"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """_k1, _k2, start, n: ranges of windows (n of them from start) that also start earlier."""
    found = cut(settled(rows_of(docs).mapInArrow(scan, FRAGMENT)))
    several = found.filter(F.col("kind") == DIFFERS).drop("kind")
    sizes = several.groupBy("anchor").agg((F.count(F.lit(1)) > MANY).cast("int").alias("many"))
    strings = cut(fetch(docs, spread_join(several, sizes, ["anchor"])))
    few = strings.filter("many = 0").select("anchor", "_k1", "_k2", "start", "n", "text")
    compared = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, RANGE)
    windows = strings.filter("many = 1").select("_k1", "_k2", "start", "n", "text").mapInArrow(scan_windows, FRAGMENT)
    each = settled(windows)
    columns = ["_k1", "_k2", "start", "n"]
    repeats = found.filter(F.col("kind") == REPEAT).select(*columns).union(compared).union(each.filter(F.col("kind") == REPEAT).select(*columns))
    return repeats


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) of every document.

    Documents are ordered by doc_id, nulls last, rows of one id by a hash of their text. Null or empty
    text: nothing to remove. Rows equal in id and text are one document, so one does not repeat the
    other; each gets the same result. Texts of any length are cut up within a task; matches never cross
    documents. An empty table gives an empty result; other columns are ignored.
    """
    per_doc = repeated_ranges(docs).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    gone = np.zeros(len(raw) + 1, np.int32)
                    for r in ranges or ():
                        gone[r["start"]] += 1
                        gone[r["start"] + r["n"] - 1 + WINDOW] -= 1
                    removed = np.cumsum(gone)[:-1] > 0
                    spans = int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(raw, np.uint8)[~removed].tobytes() if spans else raw
                    out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(per_doc, ["_k1", "_k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
