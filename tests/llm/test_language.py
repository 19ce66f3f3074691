import random
import zlib

import numpy as np

from tidemark.llm import language

STEMS = {"en": "the of and ing tion er", "fr": "le la eau eux ment que", "ru": "что это как для ния ость"}


def prose(rng, lang, n):
    stems = STEMS[lang].split()
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))


def corpus(rng, n=240):
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        rows.append((i, prose(rng, lang, rng.randint(3, 60)), lang))
    return rows


def test_held_out_accuracy_and_spans(make_docs):
    rng = random.Random(1)
    rows = corpus(rng) + [(1000, prose(rng, "en", 40) + " " + prose(rng, "fr", 20), None), (1001, prose(rng, "ru", 9) + prose(rng, "en", 30), None)]
    got = {r.doc_id: r for r in language.identify(make_docs(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[2]]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert [s.lang for s in got[1000].spans][:1] == ["en"] and got[1000].spans[-1].lang == "fr" and got[1000].lang_pred == "en"
    assert sum(s.n_words for s in got[1000].spans) == got[1000].n_words and 0.5 < got[1000].score < 1


def test_labels_of_other_rows_do_not_leak(make_docs):
    rng = random.Random(2)
    rows = corpus(rng)
    wrong = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(make_docs(rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(make_docs(wrong)).collect()}
    assert a == b


def test_odd_rows(odd, empty, make_docs):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert len(got) == len({r.doc_id for r in odd.collect()})
    for i in (1, 2, 3, 4):
        assert (got[i].lang_pred, got[i].score, got[i].n_spans) == ("und", 0.0, 0)
    assert language.identify(empty).count() == 0
    nothing = language.identify(make_docs([(1, "some words", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    first, count = np.array([0, 6, 6, 7]), np.array([6, 0, 1, 4])
    labels = language.viterbi(scores, first, count, 0.7)
    for f, c in zip(first, count):
        def value(path):
            return sum(scores[f + i, s] for i, s in enumerate(path)) - 0.7 * sum(a != b for a, b in itertools.pairwise(path))

        if c:
            best = max(itertools.product(range(3), repeat=int(c)), key=value)
            assert abs(value(labels[f : f + c]) - value(best)) < 1e-5
