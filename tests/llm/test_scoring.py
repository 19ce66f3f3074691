import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import scoring


def corpus(n=150):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 120)))) for i in range(n)]


def base(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update(scoring.tokens(text))
    total = sum(counts.values())
    out = {}
    for i, text in rows:
        words = scoring.tokens(text)
        value = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words)
        out[i, text] = (zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), total, value)
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = base(rows)
    got = scoring.score_documents(df).collect()
    key = lambda r: (str(r[0]), *r[1:4], round(r[4], 6))
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    assert len(mine) == len(want)
    for a, (k, b) in zip(mine, sorted(want.items(), key=lambda x: key((x[0][0], *x[1][:3], x[1][4])))):
        assert a[:4] == (k[0], *b[:3]) and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r.train_tokens == next(iter(want.values()))[3] and math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_base_score_and_odd_rows(make_docs, odd, empty, monkeypatch):
    monkeypatch.setattr(scoring, "HOT", 40)
    check(make_docs(corpus()).unionByName(odd))
    assert scoring.score_documents(empty).count() == 0


def test_mixing_predicts_better_than_chance(make_docs):
    rows = corpus()
    got = {r.doc_id: r for r in scoring.score_documents(make_docs(rows)).collect()}
    size = sum(len(" ".join([*(t.split()), "x"]).encode()) for i, t in rows if got[i].held_out)
    bits = -sum(got[i].score for i, _ in rows if got[i].held_out) / math.log10(2)
    assert bits / size < 2.5  # a fixed code for eight letters and the space takes over three
    noise = scoring.score_documents(make_docs([*rows, (500, "zq jx kv wq")])).collect()
    strange = next(r for r in noise if r.doc_id == 500)
    assert -strange.score / math.log10(2) / 12 > 5


def test_score_is_a_probability():
    """Over all one-byte words followed by a space, and the end, the first symbol's probabilities add up to one."""
    counts = np.zeros((256, 256), np.int64)
    counts[32, [97, 98, 32, 10]] = [50, 20, 30, 5]
    code = scoring.Code.fit(counts)
    assert all(sum(2.0**-n for n in row) == pytest.approx(1) for row in code.length[[0, 32, 97]])
    rng = np.random.default_rng(1)
    slots = 1 << scoring.SLOT_BITS
    odds = rng.integers(-120, 120, (scoring.ORDERS, slots)).astype(np.int8)
    total = 0.0
    for symbol in range(256):
        n = int(code.length[32, symbol])
        nodes, bits = code.node[32, symbol, :n], code.bit[32, symbol, :n]
        inputs = odds[:, nodes.astype(np.int64)].T.copy()
        logs = scoring.mix(inputs, bits, np.arange(n, dtype=np.int32), np.array([0]), np.array([n]))
        total += math.exp(logs[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_segments_do_not_depend_on_neighbours(make_docs):
    rows = corpus(60)
    fitted = scoring.fit(make_docs(rows))
    alone = scoring.score_texts(fitted[0], [rows[5][1]])[3][0]
    among = scoring.score_texts(fitted[0], [t for _, t in rows])[3][5]
    assert alone == pytest.approx(among, rel=1e-6)
