import math
import random

import numpy as np
import pytest

from tidemark.llm import topk


def brute(rows, k=5, every=50):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for own, (q, v) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(ok) if n != own)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as v", "4 as rb")
    return sorted(tuple(r) for r in topk.search_top_k(df, **how).collect())


@pytest.mark.parametrize("block", [16, 8192])
def test_exact_with_ties_and_odd_vectors(spark, block):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(12)]) for i in range(160)]
    rows += [(300 + i, rows[0][1]) for i in range(8)] + [(400, [0.0] * 12), (401, [0.0] * 12), (450, [])]
    rows += [(None, rows[1][1]), (500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (7, rows[7][1])]
    assert run(spark, rows, row_block=block, query_block=block) == brute(rows)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0]), (50, [2.0]), (3, [-1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


@pytest.mark.parametrize("block", [2, 8192])
def test_rows_that_repeat_an_id(spark, block):
    rows = [(3, [1.0, 0.0]), (3, [9.0, 1.0]), (3, [9.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [-2.0, 5.0]), (4, [0.5, 0.5])]
    got = run(spark, rows, row_block=block, query_block=block)
    assert got == brute(rows) and got.count((50, 1, 3, 655360)) == 2


def test_sql_keeps_every_row(spark):
    import duckdb

    rng = random.Random(4)
    rows = [(rng.randint(0, 60), [float(rng.randint(-3, 3)) for _ in range(3)]) for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(topk.ORACLE).fetchall()) == brute(rows) == run(spark, rows)


def test_stops_early_on_proof():
    rng = np.random.default_rng(1)
    rows = rng.integers(-60, 60, (3000, 16))
    query = np.zeros(16, np.int64)
    query[3], rows[17, 3], rows[18, 3] = 200, 5000, 4000
    index = topk.ImpactIndex(np.arange(3000), np.zeros(3000), rows)
    ids, scores, read, rescored = index.search(-1, 0, query, 2)
    assert ids.tolist() == [17, 18] and scores.tolist() == [1000000, 800000]
    assert read < 3000 and rescored < 3000
