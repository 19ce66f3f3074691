import random

import xxhash

from tidemark.llm import neardup


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, prints):
    """Smallest reachable id of every row, by all pairs."""
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                label[find(a)] = find(b)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    return [min((d for d in members[find(i)] if d is not None), default=None) for i in range(len(rows))]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{p:016x}", g) for (d, _), p, g in zip(rows, prints, groups(rows, prints))), key=str)
    got = neardup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    return got


def test_against_all_pairs(make_docs, odd, empty):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    texts = [rng.choices(words, k=rng.randint(60, 250)) for _ in range(25)]
    for text in texts[:12]:
        for _ in range(8):
            near = text[:]
            near[rng.randrange(len(near))] = "changed"
            texts.append(near)
    got = check(make_docs([(100 + i, " ".join(t)) for i, t in enumerate(texts)]).unionByName(odd))
    assert len({r.component_id for r in got}) < len(got) - 20
    assert neardup.near_duplicates(empty).count() == 0


def test_any_pair_within_three_bits_is_found(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for v in values:
        near = v
        for bit in rng.sample(range(64), 3):
            near ^= 1 << bit
        rows += [v, near]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in rows], "fp long")
    found = {r.fp: r.component for r in neardup.link_values(df).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in rows]
    assert all(found[a] == found[b] == min(a, b) for a, b in zip(signed[::2], signed[1::2]))


def test_one_document_of_each_group_stays(odd):
    left = neardup.apply_near_duplicates(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    assert ids.count(6) == 1 and 7 not in ids and 1 in ids and 2 not in ids and 3 not in ids


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes 20 keys a value for one row, so the side of the pair join looks 20 times too small."""
    edges, real = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda df: edges.append(df) or real(df))
    neardup.link_values(spark.range(300).selectExpr("xxhash64(id) AS fp")).collect()
    plan = edges[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
