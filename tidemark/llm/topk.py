"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of bounded size. A block's index keeps, for every component and sign, its
vectors in posting segments of equal quantised impact. A query takes the segments of all components in
order of their largest possible contribution, adds quantised contributions to accumulators, and knows
at any time how far an accumulator can be from the true score. It stops when that error proves that only
few vectors can still be among the best (or when no segment is left); those are rescored exactly, so
the answer is exact wherever it stops. Each block answers each block of queries on its own; the best k
of all blocks' answers are the result. The blocks of queries and of rows form a grid of tasks of the
same size; no task holds more than one block of either. A task builds its block's index for the
thousands of queries it answers with it, next to which the building is little.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 8
SCHEMA = "query_id long, query_key long, vec_id long, score long, postings long, rescored long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    out = np.zeros((len(lists), width), np.int64)
    lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class ImpactIndex:
    """Posting segments of one block of vectors."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.ids, self.keys, self.rows = ids, keys, rows
        size = np.abs(rows)
        self.step = max(1, -(-int(size.max(initial=0) + 1) // LEVELS))
        self.tops = size.max(axis=0, initial=0)
        component, sign, level, members = [], [], [], []
        for c in range(rows.shape[1]):
            # level 0 adds nothing but its error, so it has no postings
            key = (size[:, c] // self.step) * 2 + (rows[:, c] > 0)
            order = np.argsort(key, kind="stable")
            for k, part in zip(*self._cut(key[order], order)):
                if k >= 2:
                    component.append(c)
                    sign.append(1 if k % 2 else -1)
                    level.append(k // 2)
                    members.append(part)
        self.component, self.sign = np.array(component, np.int64), np.array(sign, np.int64)
        self.level = np.array(level, np.int64)
        self.members = members
        self.lengths = np.array([len(m) for m in members], np.int64)
        self.top = (self.level + 1) * self.step - 1
        self.mid = self.level * self.step + self.step // 2

    @staticmethod
    def _cut(keys: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        breaks = np.flatnonzero(np.diff(keys)) + 1
        firsts = keys[np.concatenate([[0], breaks])].tolist() if len(keys) else []
        return firsts, np.split(order, breaks) if len(keys) else []

    def search(self, own: int, key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """ids and scores of the best k rows other than row `key` of id `own`, postings read, rows rescored."""
        weight = np.abs(query)
        order = np.argsort(-weight[self.component] * self.top, kind="stable")
        order = order[weight[self.component[order]] > 0]
        values = query[self.component] * self.sign * self.mid
        left = int(self.lengths[order].sum())
        total = np.zeros(len(self.ids), np.int64)
        allowed = (self.ids != own) | (self.keys != key)
        floor = np.iinfo(np.int64).min // 2
        # the largest magnitude a component may still add unseen: it falls as its segments are read
        unseen = self.tops.copy()
        read, check = 0, max(1, len(order) // 12)
        possible = np.flatnonzero(allowed)
        for begin in range(0, max(1, len(order)), check):
            for s in order[begin : begin + check].tolist():
                total[self.members[s]] += values[s]
                read += len(self.members[s])
            rest = order[begin + check :]
            unseen[:] = np.minimum(self.tops, self.step - 1)
            np.maximum.at(unseen, self.component[rest], np.minimum(self.top[rest], self.tops[self.component[rest]]))
            error = int((weight * np.maximum(unseen, self.step // 2 + 1)).sum())
            scores = np.where(allowed, total, floor)
            if len(scores) > k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                possible = np.flatnonzero(allowed & (scores >= worst - 2 * error))
            if len(possible) * len(query) <= max(64 * len(query), (left - read) // 4):
                break
        exact = self.rows[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best], read, len(possible)


def search_block(k: int):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(block: pa.Table) -> pa.Table:
        asks = block["is_query"].to_numpy()
        queries, rows = block.filter(pa.array(asks)), block.filter(pa.array(~asks))
        width = pa.compute.max(pa.compute.list_value_length(block["v"])).as_py() or 0
        index = ImpactIndex(rows["vec_id"].to_numpy(), rows["key"].to_numpy(), matrix(rows["v"], width))
        ids, keys = queries["vec_id"].to_numpy(), queries["key"].to_numpy()
        found = [index.search(int(i), int(key), q, k) for i, key, q in zip(ids, keys, matrix(queries["v"], width))]
        sizes = [len(f[0]) for f in found]

        def column(values: list) -> pa.Array:
            return pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())

        return pa.table(
            [
                column([np.repeat(ids, sizes)]), column([np.repeat(keys, sizes)]), column([f[0] for f in found]), column([f[1] for f in found]),
                column([np.repeat([f[2] for f in found], sizes).astype(np.int64)]), column([np.repeat([f[3] for f in found], sizes).astype(np.int64)]),
            ],
            names=names,
        )

    return run


def search_top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, row_block: int = 8192, query_block: int = 2048
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the vectors whose vec_id is divisible by `every`;
    every other vector is a candidate. Vectors that are null or hold a null or non-finite component
    take no part, nor do rows without a vec_id. Shorter vectors count as filled up with zeros; an
    empty vector scores 0. Every row counts: rows that repeat a vec_id are candidates each, also for one
    another, and each row with a query's id is a query with a ranking of its own (a row is excluded only
    from its own ranking). A query with fewer candidates than k gets them all. An empty table gives an empty result; other columns
    are ignored. Scores are exact while they fit 64 bits.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long"))
    valid = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    # equal rows are numbered, so that (vec_id, key) names one row and a retried task gives it the same name
    equal = valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    numbered = equal.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("n"))
    rows = numbered.select("vec_id", "v", F.xxhash64("v", "n").alias("key"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    n_rows, n_queries = valid.count(), valid.filter(F.col("vec_id") % every == 0).count()
    rb, qb = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_queries / query_block))

    def deal(n: int):
        return F.pmod(F.xxhash64("vec_id", "key"), F.lit(n))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = queries.select("vec_id", "key", "v", F.lit(True).alias("is_query"), deal(qb).alias("qb"), each(rb).alias("rb"))
    offered = rows.select("vec_id", "key", "v", F.lit(False).alias("is_query"), deal(rb).alias("rb"), each(qb).alias("qb"))
    found = asked.unionByName(offered).groupBy("rb", "qb").applyInArrow(search_block(k), SCHEMA)
    best = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, row ORDER BY score DESC, vec_id) <= 5
"""
