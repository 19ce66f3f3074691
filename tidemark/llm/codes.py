"""Vector code compression: product codes by exact Lloyd rounds, pruned by norm-of-sum bounds.

A vector of integers is cut into four equal parts, and each part position has a codebook of at most 256
entries. A round assigns every part to its nearest entry and then moves each entry to the mean of its
parts. Most parts keep their entry, and bounds prove it without looking at the other entries:

* A part remembers an upper bound on the distance to its own entry and, for each of GROUPS groups of
  entries, a lower bound on the distance to the nearest other entry of the group. Every bound has the
  stamp of the round whose codebook it was taken against.
* All codebooks since the start are kept (the history, a few codebooks of 256 entries). A bound of round s
  holds now after the norm of (entry now - entry at s), the true net displacement: the norm of the sum
  of an entry's moves, which is never more than the sum of their norms that running bounds pile up.
* A group whose lower bound exceeds the upper bound cannot hold the nearest entry. If one does not, the
  own distance is taken exactly; groups that are still open are scanned exactly and get fresh stamps.

Distances are compared as integers and bounds are rounded away from each other, so bounds never change a
result. Vectors and bounds go from round to round in one table without a shuffle; what comes back to the
driver per round are the sums of the codebook's entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import spread_join

from .common import cut, release
from .topk import matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUPS = 4
SCALE = 1024
LAST = 2**63 - 1
#: What a part remembers: its entry, the bound on the own distance, bounds on the groups, and their stamps.
STATE = np.dtype([("at", "u1"), ("upper_at", "u1"), ("lower_at", "u1", GROUPS), ("upper", "f4"), ("lower", "f4", GROUPS)])


def exact_kind(width: int, largest: int) -> type:
    """The fastest kind of number that holds all squared distances of a part exactly."""
    top = 4 * max(1, width) * max(1, largest) ** 2
    return np.float64 if top < 2**52 else np.int64 if top < 2**62 else object


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact in the kind of number of both."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


class Bounds:
    """One part position: the codebooks so far and how far an entry has moved since each of them."""

    def __init__(self, history: list[np.ndarray], kind: type):
        self.history = [np.array(c.tolist(), dtype=kind).reshape(c.shape) for c in history]
        now = self.history[-1]
        self.now, self.round = now, len(history) - 1
        moved = [((now - c) ** 2).sum(axis=1).astype(np.float64) for c in self.history]
        self.moved = np.sqrt(np.stack(moved)) * (1 + 1e-12)
        self.groups = [g for g in np.array_split(np.arange(len(now)), GROUPS) if len(g)]
        self.group_moved = np.stack([self.moved[:, g].max(axis=1) for g in self.groups], axis=1)
        self.scanned = 0

    def first(self, x: np.ndarray) -> np.ndarray:
        """The state of parts that have none yet: every group is scanned."""
        state = np.zeros(len(x), STATE)
        state["lower"] = -1
        state["upper"] = np.inf
        return self.next(x, state)

    def next(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state of the parts against the newest codebook."""
        state = state.copy()
        every = np.arange(len(x))
        upper = state["upper"] + self.moved[state["upper_at"], state["at"]]
        lower = np.stack([state["lower"][:, g] - self.group_moved[state["lower_at"][:, g], g] for g in range(len(self.groups))], axis=1)
        open_rows = every[(lower <= upper[:, None]).any(axis=1)]
        if not len(open_rows):
            return state
        own = ((x[open_rows] - self.now[state["at"][open_rows]]) ** 2).sum(axis=1)
        tight = np.sqrt(own.astype(np.float64)) * (1 + 1e-6)
        state["upper"][open_rows], state["upper_at"][open_rows] = tight, self.round
        best, entry = own.copy(), state["at"][open_rows].astype(np.int64)
        was, found = entry.copy(), []
        for g, members in enumerate(self.groups):
            look = np.flatnonzero(lower[open_rows, g] <= tight)
            if not len(look):
                continue
            self.scanned += len(look) * len(members)
            d = squared(x[open_rows[look]], self.now[members])
            nearest = d.argmin(axis=1)
            least = d[np.arange(len(look)), nearest]
            found.append((g, look, d, members[nearest]))
            better = (least < best[look]) | ((least == best[look]) & (members[nearest] < entry[look]))
            best[look[better]], entry[look[better]] = least[better], members[nearest][better]
        for g, look, d, nearest in found:
            # the own entry does not count for the bound of its group
            mine = entry[look] == nearest
            d = d.astype(np.float64)
            d[np.flatnonzero(mine), (nearest - self.groups[g][0])[mine]] = np.inf
            state["lower"][open_rows[look], g] = np.sqrt(d.min(axis=1)) * (1 - 1e-6)
            state["lower_at"][open_rows[look], g] = self.round
        # an entry that a part leaves counts for the bound of its group, unless the group has just been scanned
        left = np.flatnonzero(entry != was)
        group_of = np.concatenate([np.full(len(m), g) for g, m in enumerate(self.groups)])[was[left]]
        for g in range(len(self.groups)):
            rows = left[group_of == g]
            stale = rows[state["lower_at"][open_rows[rows], g] != self.round]
            bound = np.minimum(lower[open_rows[stale], g], tight[stale] * (1 - 3e-6))
            state["lower"][open_rows[stale], g], state["lower_at"][open_rows[stale], g] = bound - np.abs(bound) * 1e-6, self.round
        state["at"][open_rows] = entry
        state["upper"][open_rows] = np.sqrt(best.astype(np.float64)) * (1 + 1e-6)
        return state


def blocks_of(batches: Iterable[pa.RecordBatch], width: int, kind: type, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches and their vectors (column 1) as parts: rows x PARTS x width of a part."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            piece = batch.slice(begin, rows)
            yield piece, matrix(piece.column(1), width * PARTS).astype(kind).reshape(piece.num_rows, PARTS, width)


def states(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), STATE).reshape(-1, PARTS)


def assign(history: list[np.ndarray], width: int, kind: type):
    """A task's pass: the bounds of each row brought up to the newest codebook."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Bounds([c[p] for c in history], kind) for p in range(PARTS)]
        for piece, x in blocks_of(batches, width, kind):
            if len(history) == 1:
                new = np.stack([b.first(x[:, p]) for p, b in enumerate(books)], axis=1)
            else:
                old = states(piece.column(3))
                new = np.stack([b.next(x[:, p], old[:, p]) for p, b in enumerate(books)], axis=1)
            each = pa.binary(STATE.itemsize * PARTS)
            packed = pa.Array.from_buffers(each, len(new), [None, pa.py_buffer(new.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], packed], ["vec_id", "v", "label", "state"])

    return run


def totals(entries: int, width: int):
    """A task's sums and counts of the parts of each entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, entries, width), object)
        counts = np.zeros((PARTS, entries), np.int64)
        for piece, x in blocks_of(batches, width, np.int64):
            at = states(piece.column(2))["at"]
            # a slice's sums of values under 2**40 stay within a long
            x = x if np.abs(x).max(initial=0) < 2**40 else x.astype(object)
            for p in range(PARTS):
                order = np.argsort(at[:, p], kind="stable")
                firsts = np.flatnonzero(np.diff(at[order, p].astype(np.int64), prepend=-1))
                used = at[order, p][firsts]
                sums[p, used] += np.add.reduceat(x[order, p], firsts, axis=0).astype(object)
                counts[p] += np.bincount(at[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            listed = pa.array([[Decimal(int(v)) for v in sums[p, e]] for p, e in zip(part, entry)], pa.list_(pa.decimal128(38, 0)))
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), listed, pa.array(counts[part, entry], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "sums", "n"])

    return run


def moved_entries(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: each entry the floored mean of its parts; an unused one stays."""
    parts, entries, width = book.shape
    partial = table.select("vec_id", "v", "state").mapInArrow(totals(entries, width), "part int, entry int, sums array<decimal(38,0)>, n long")
    each = partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
    rows = each.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # as many as the codebook has components
    new = book.copy()
    for r in rows:
        new[r.part, r.entry, r.place] = int(r.s) // r.n
    return new


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    Vectors that are null or hold a null or non-finite component are dropped. Components become
    floor(scale * x), saturated at 64 bits. Shorter vectors count as filled up with zeros, to the longest
    one's length rounded up to a multiple of four (4 at least). Codebooks start from the parts of the
    smallest vec_ids (null ids last, repeated ids in the order of their vectors), as many as there are if
    fewer than `entries`. Ties go to the lower entry. code has two hex digits a part; error is the sum of
    the final squared distances and label_error its sum over equal labels, nulls together; both saturate
    at 64 bits. Every input row gives a row, repeated ones too; an empty table gives an empty result.
    Other columns are ignored.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long"))
    table = cut(
        vectors.filter(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.col("label").cast("string").alias("label"))
    )
    low = F.coalesce(F.array_min("v"), F.lit(0)).cast("decimal(20,0)")
    high = F.coalesce(F.array_max("v"), F.lit(0)).cast("decimal(20,0)")
    size = table.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(-low, high)).alias("largest")).first()
    width = max(1, -(-(size.width or 0) // PARTS))
    kind = exact_kind(width, int(size.largest or 0))
    seeds = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        zero = F.lit(0).cast("long")
        return table.select("vec_id", F.lit("").alias("code"), zero.alias("error"), zero.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    book = np.zeros((len(seeds), PARTS * width), object)
    for i, r in enumerate(seeds):
        book[i, : len(r.v)] = r.v
    book = book.reshape(len(seeds), PARTS, width).transpose(1, 0, 2)
    history = [book]
    for _ in range(rounds):
        assigned = cut(table.mapInArrow(assign(history, width, kind), "vec_id long, v array<long>, label string, state binary"))
        release(table)
        table = assigned
        history.append(moved_entries(table, history[-1]))
    listed = ",".join(str(v) for v in history[-1].reshape(-1))
    digest = hashlib.sha256(listed.encode()).hexdigest()
    coded = table.mapInArrow(code_rows(history, width, kind), "vec_id long, label string, code string, error long")
    coded = cut(coded.withColumn("unlabelled", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit(""))))
    per_label = coded.groupBy("unlabelled", "label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(Decimal(LAST))).cast("long").alias("label_error"))
    joined = spread_join(coded, per_label, ["unlabelled", "label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def code_rows(history: list[np.ndarray], width: int, kind: type):
    """A task's last pass: codes and exact errors against the final codebook."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Bounds([c[p] for c in history], kind) for p in range(PARTS)]
        for piece, x in blocks_of(batches, width, kind):
            if len(history) == 1:
                at = np.stack([b.first(x[:, p])["at"] for p, b in enumerate(books)], axis=1)
            else:
                old = states(piece.column(3))
                at = np.stack([b.next(x[:, p], old[:, p])["at"] for p, b in enumerate(books)], axis=1)
            error = sum(((x[:, p] - b.now[at[:, p]]) ** 2).sum(axis=1).astype(object) for p, b in enumerate(books))
            columns = [
                piece.column(0), piece.column(2), pa.array([row.tobytes().hex() for row in at.astype(np.uint8)], pa.string()),
                pa.array([min(int(e), LAST) for e in error], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds unrolled: every part against every entry."""
    sql = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(ceil(max(len(v)) / {PARTS}) AS BIGINT) AS w FROM kept),
x AS (SELECT i, p, list_slice(v, p * w + 1, (p + 1) * w) AS v FROM kept, w, range({PARTS}) r(p)),
c0 AS (SELECT p, i AS e, v FROM x WHERE i < {ENTRIES})"""
    for t in range(rounds + 1):
        sql += f""",
a{t} AS MATERIALIZED (SELECT i, x.p, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), 'e': e}}) AS best
  FROM x JOIN c{t} c ON c.p = x.p GROUP BY i, x.p)"""
        if t < rounds:
            sql += f""",
c{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN (
  SELECT p, e, list(q ORDER BY place) AS v FROM (
    SELECT x.p, best.e AS e, place, CAST(floor(sum(v[place + 1]) / count(*)) AS BIGINT) AS q FROM x JOIN a{t} a ON a.i = x.i AND a.p = x.p, w, range(0, w) r(place) GROUP BY 1, 2, 3) GROUP BY p, e) n USING (p, e))"""
    return sql


ORACLE = (
    oracle()
    + f""",
code AS (SELECT i, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN code USING (i), books"""
)
