from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def water(sizes, share=Fraction(3, 2), most=2):
    """Targets by repeated sharing: sources over their limit are closed until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, closed = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in closed)
        among = sum(weight[s] for s in names if s not in closed)
        new = {s for s in names if s not in closed and left * weight[s] > most * sizes[s] * among}
        if not new or not among:
            return {s: most * sizes[s] if s in closed else left * weight[s] / among for s in names}
        closed |= new


def rows_for(plan):
    out, i = [], 0
    for source, sizes in plan.items():
        for n in sizes:
            out.append((i, " ".join(["w"] * n), "en", source))
            i += 1
    return out


PLANS = [
    {"a": [50] * 40, "b": [10] * 9, "c": [700, 1, 0, 5], None: [33] * 7, "é": [400]},
    {"only": [5, 6, 7]}, {"a": [0, 0], "b": [0]}, {"a": [3], "b": [100000 // 20] * 20, "c": [1]},
]


@pytest.mark.parametrize("plan", PLANS)
def test_targets_and_taken(make_docs, plan):
    df = make_docs(rows_for(plan))
    got = mixing.mix_sources(df, shard_tokens=500).collect()
    again = mixing.mix_sources(df.repartition(7), shard_tokens=500).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {r[0]: r[3] for r in rows_for(plan)}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = water(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s])) and all(r.source_size == sizes[s] for r in got if source[r.doc_id] == s)
        assert abs(taken[s] - target[s]) <= 64 + 0.02 * target[s]


def test_highest_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 0, "e": 700}
    for seats in (0, 1, 7, 100, 5001):
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "k string, v long, s long")
        got = {r.k: r.blocks for r in mixing.sainte_lague(df, [], ["k"], "v", "s").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda k: (Fraction(votes[k], 2 * want[k] + 1), -ord(k)))
            want[best] += 1
        assert got == want


def test_odd_rows_and_texts(odd, empty, make_docs):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and mixing.mix_sources(empty).count() == 0
    df = make_docs(rows_for(PLANS[0]))
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()}
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    counted = {r.doc_id: r.n for r in mixed.select("doc_id", F.size(F.split("text", r"\s+")).alias("n")).collect()}
    assert counted == {i: n for i, n in taken.items() if n}
