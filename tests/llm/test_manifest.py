import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """Levels of a tree over nodes in order."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text); the results of each, in any order."""
    def leaf(r, text):
        return h(*[enc(v) for v in r[:4]], enc(text))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = up([leaf(r, r[4]) for r in by[s]])
    over = up([trees[s][-1][0] for s in sources])
    root = over[-1][0]
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = beside(trees[s], i) + beside(over, j)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(r, text)
            for a, b in path:
                fold = h(a, fold, b)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, h(*[x for p in path for x in p]), fold, fold == root))
    return sorted(out, key=str)


def check(df):
    rows = [tuple(r) for r in df.select(*manifest.COLUMNS).collect()]
    got = manifest.manifest(df, manifest.lines_joined()).drop("path").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    return got


def test_against_trees_in_memory(make_docs):
    rng = random.Random(2)
    sources = [None, "", "a", "Ä", "z", "hot"] + [f"s{i}" for i in range(12)]
    rows = []
    for i in range(900):
        s = "hot" if rng.random() < 0.9 else rng.choice(sources)
        rows.append((rng.randrange(700), rng.choice(["x\ny", "x", "äö\n", None, ""]), rng.choice([None, "en", "-"]), s))
    assert 0 < sum(not r.verified for r in check(make_docs(rows)))


def test_blocks_of_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "SPAN", 9)
    check(make_docs([(i, f"t\n{i}", "en", f"s{i % 11}" if i % 3 else "hot") for i in range(260)]))


def test_sizes_around_powers_of_three(make_docs):
    check(make_docs([(i, "t", "en", f"n{n}") for n in (1, 2, 3, 4, 8, 9, 10, 28) for i in range(n)]))


def test_odd_rows(odd, empty, make_docs):
    check(odd)
    assert manifest.manifest(empty).count() == 0
    one = check(make_docs([(5, "only\none")]))[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")
    check(make_docs([(None, None, None, None)] * 5))


def test_any_change_shows(make_docs):
    df = make_docs([(i, f"text {i}", "en", f"s{i % 3}") for i in range(40)])
    assert all(r.verified for r in manifest.manifest(df).collect())
    cut = F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))
    assert [r.doc_id for r in manifest.manifest(df, cut).collect() if not r.verified] == [17]
