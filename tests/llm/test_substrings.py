import hashlib
import random
from collections import defaultdict

import numpy as np

from tidemark.llm import substrings


def brute(rows):
    """Expected row of each (doc_id, text): every 100-byte string that started earlier covers its bytes."""
    docs = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i, text] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows):
    want = brute(rows)
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want[r[:2]] for r in rows)


def test_against_all_windows(make_docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passage, line = prose(60), prose(18)
    rows = [(i, " ".join([prose(rng.randint(0, 60)), rng.choice([passage, line, passage[40:170], prose(9)]), prose(rng.randint(0, 60))])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1][:-3] + "zzz"), (102, passage + passage), (103, "ab" * 400), (104, "ab" * 300 + "c" + "ab" * 90)]
    rows += [(200 + i, line * 2 + prose(12)) for i in range(30)] + [(300, "x" * 99), (301, "x" * 100), (302, "é" * 50), (303, "é" * 50)]
    check(make_docs(rows), rows)


def test_many_strings_at_one_anchor(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", 8)
    rng = random.Random(6)
    phrase = "".join(rng.choices("abcdefghijklmnop", k=80))
    rows = [(i, "".join(rng.choices("qrstuvwxyz", k=90)) + phrase + "".join(rng.choices("qrstuvwxyz", k=90))) for i in range(40)]
    rows += [(50 + i, rows[i][1][60:230]) for i in range(0, 40, 3)]
    check(make_docs(rows), rows)


def test_long_text_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 1000)
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefg ", k=7000))
    rows = [(1, text), (2, text[1500:4200]), (3, "zz" + text[2000:5000] + text[100:300])]
    check(make_docs(rows), rows)


def test_odd_rows_and_empty_table(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(odd, rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_repeated_windows_of_merged_transforms():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcd", k=rng.randint(100, 260))).encode() for _ in range(5)]
    strings = [b"a" * 300, b"ab" * 100]
    for _ in range(50):
        b = rng.choice(base)
        a = rng.randrange(len(b) - 99)
        cut = bytearray(b[a : rng.randint(a + 100, len(b))])
        if rng.random() < 0.5:
            cut[rng.randrange(len(cut))] = 100
        strings.append(bytes(cut))
    places = defaultdict(list)
    for i, s in enumerate(strings):
        for p in range(len(s) - 99):
            places[s[p : p + 100]].append((i, p))
    want = sorted(sorted(v) for v in places.values() if len(v) > 1)
    for shard in (400, 1 << 15):
        found = defaultdict(list)
        for interval, string, place in zip(*(x.tolist() for x in substrings.repeated_windows(strings, shard))):
            found[interval].append((string, place))
        assert sorted(sorted(v) for v in found.values()) == want
