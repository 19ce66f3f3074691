import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import jaccard


def sets_of(rows):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, label = sets_of(rows), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if a and b and 100 * k >= 85 * (len(a) + len(b) - k):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), math.inf))
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = jaccard.jaccard_join(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    return got


def edited(rng, words, n):
    out = words[:]
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], ["other"], [out[i], "more"], [f"w{rng.random()}"]])
    return out


def test_against_all_pairs(make_docs):
    rng = random.Random(9)
    stock = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 4, 7, 9, 20, 60, 150]))] for _ in range(25)]
    shared = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(300):
        words = edited(rng, rng.choice(stock), rng.choice([0, 0, 1, 1, 2, 4]))
        if rng.random() < 0.3:
            words = words + shared
        rows.append((rng.randrange(400), rng.choice([" ", "\n", " \t"]).join(words if rng.random() < 0.9 else [w.upper() for w in words])))
    got = check(make_docs(rows))
    assert 100 < sum(r.doc_id != r.component_id for r in got) < 290


def test_similarities_at_the_limit(make_docs):
    """Pairs of sets around 85 of 100: 37 and 37 with 34 in common are just in, 33 are not."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k, (n, cut) in enumerate((n, cut) for n in (23, 40, 43, 103) for cut in range(1, 1 + n // 5)):
        base = [f"{k}{w}" for w in words[:n]]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-cut]))]
    got = check(make_docs(rows))
    assert 10 < sum(r.doc_id != r.component_id for r in got) < len(rows) / 2


def test_chains_and_large_groups(make_docs):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    chain, rows = base, [(1000, " ".join(base))] * 30
    for i in range(40):
        chain = chain[2:] + [f"n{i}a", f"n{i}b"]
        rows.append((i, " ".join(chain)))
    other = [f"v{i}" for i in range(150)]
    rows += [(100 + i, " ".join(edited(rng, other, 1))) for i in range(150)]
    got = check(make_docs(rows))
    assert {r.component_id for r in got if r.doc_id < 50 or r.doc_id == 1000} == {0}


def test_odd_rows(odd, empty):
    got = check(odd)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 4)} == {1, 2, 3, 4}
    assert jaccard.jaccard_join(empty).count() == 0


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["Word ", "a\n", "\t\tbb ", "cccc\x0b", "É", " "]) for _ in range(3000))
    whole = jaccard.word_hashes(text)
    assert len(whole) == len(text.encode().split())
    for size in (1, 7, 64):
        monkeypatch.setattr(jaccard, "SLICE", size)
        assert np.array_equal(jaccard.word_hashes(text), whole)


def test_filters_spare_pairs(spark):
    """Sets that share a common passage, but nothing else, are not verified."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    sets = [jaccard.shingles(" ".join([f"{i}-{j}" for j in range(rng.randrange(5, 8))] + passage)) for i in range(60)]
    seen = Counter(x for s in sets for x in s.view(np.int64).tolist())
    rows = [(i, 0, 0, len(s), sorted((x for x in s.view(np.int64).tolist() if seen[x] > 1), key=lambda x: (seen[x], x))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "sid long, m0 long, m1 long, n long, shared array<long>")
    first = df.mapInArrow(jaccard.prefixes, jaccard.PREFIX)
    assert jaccard.candidates(first.withColumn("part", first.sid)).count() == 0
