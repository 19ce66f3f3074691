import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes


def brute(rows, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    """Rows (vec_id, vector, label) coded with Python integers, every part against every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // 4))

    def ints(v):
        v = [max(-(2**63), min(2**63 - 1, math.floor(float(np.float32(x)) * 1024))) for x in v]
        v += [0] * (4 * width - len(v))
        return [v[p * width : (p + 1) * width] for p in range(4)]

    whole = [ints(r[1]) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    books = [[whole[i][p] for i in order[:entries]] for p in range(4)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        for p in range(4):
            at = [near(v[p], books[p])[1] for v in whole]
            books[p] = [
                [sum(col) // len(col) for col in zip(*(v[p] for v, a in zip(whole, at) if a == e))] if e in at else c for e, c in enumerate(books[p])
            ]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(4)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    of = [r[2] for r in kept]
    last = 2**63 - 1
    return [
        (r[0], "".join(f"{e:02x}" for _, e in f), min(err, last), min(last, sum(min(e, last) for e, l in zip(errors, of) if l == r[2])), digest)
        for r, f, err in zip(kept, found, errors)
    ]


@pytest.fixture
def make(spark):
    def table(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return df.withColumns({c: F.lit("x") for c in ("v", "state", "code", "error", "unlabelled", "part", "n", "_salt")})

    return table


def check(df, rows, **how):
    got = codes.compress_vectors(df, **how).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, **how), key=key)
    return got


def test_against_every_entry(make):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(7, rows[7][1], 1), (8, rows[9][1], None)] * 3
    check(make(rows), rows)
    check(make(rows), rows, entries=6)
    check(make(rows), rows, rounds=0)


def test_ties_and_odd_vectors(make):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(rng.choice([5, 6, 8]))], i % 2) for i in range(60)]
    rows += [(None, [1.0] * 8, None), (100, None, 1), (101, [1.0, None], 1), (102, [float("nan")], 1), (103, [float("inf")] * 8, 1), (104, [], 0), (None, None, None)]
    check(make(rows), rows, entries=5)


def test_components_beyond_the_exact_floats(make):
    rows = [(i, [(-1.0) ** i * 3e20 * (1 + i / 7), 1e6 * i, 5.0, 0.1 * i], 0) for i in range(9)]
    got = check(make(rows), rows, entries=3)
    assert len(got) == 9
    middle = [(i, [1e5 * i, -2e5 + i, 5e4, 0.1 * i], 0) for i in range(9)]
    check(make(middle), middle, entries=3)


def test_one_vector_and_none(make):
    check(make([(4, [0.5, 0.25], 3)]), [(4, [0.5, 0.25], 3)])
    assert codes.compress_vectors(make([(4, [0.5], 3)]).filter("false")).count() == 0


def test_bounds_spare_scans_and_hold():
    """Net displacement: entries that wander and come back leave the bounds as tight as they were."""
    rng = np.random.default_rng(1)
    first = rng.integers(-2000, 2000, (64, 8)).astype(np.float64)
    x = (first[rng.integers(0, 64, 3000)] + rng.integers(-40, 41, (3000, 8))).astype(np.float64)
    history = [first]
    state = codes.Bounds(history, np.float64).first(x)
    scans = []
    for t in range(6):
        history.append(first + (rng.integers(-60, 61, first.shape) if t % 2 == 0 else 0))
        book = codes.Bounds(history, np.float64)
        state = book.next(x, state)
        d = codes.squared(x, history[-1])
        assert (state["at"] == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), state["at"]])
        held = state["upper"] + book.moved[state["upper_at"], state["at"]]
        assert (own <= held).all()
        d[np.arange(len(x)), state["at"]] = np.inf
        for g, members in enumerate(book.groups):
            assert (state["lower"][:, g] - book.group_moved[state["lower_at"][:, g], g] <= np.sqrt(d[:, members].min(axis=1))).all()
        scans.append(book.scanned)
    assert max(scans) < 0.2 * x.shape[0] * 64
