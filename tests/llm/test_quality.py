import random
import re
from collections import Counter, defaultdict

from tidemark.llm import quality

WS = " \t\n\x0b\x0c\r"


def brute(rows):
    """Expected (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of (doc_id, text, source) rows."""

    def norm(line):
        return re.sub(f"[{WS}]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")

    def full(text):
        return [x for x in (text or "").split("\n") if x.strip(WS)]

    carriers = defaultdict(set)
    for doc, text, source in rows:
        for x in full(text):
            carriers[source, norm(x)].add((doc, text if doc is None else ""))
    over = {k for k, docs in carriers.items() if len(docs) > 20}
    out = []
    for _, text, source in rows:
        words = [w for w in re.split(f"[{WS}]+", text or "") if w]
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        cover = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = full(text)
        gone = sum(len(x.split()) for x in lines if (source, norm(x)) in over)
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        kept = not failed and len(words) - gone >= 20 and gone <= 0.5 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        out.append((len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(cover), failed, kept))
    return out


def check(df):
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    want = zip((str(r[0]) for r in rows), brute(rows))
    got = quality.quality_rules(df).collect()
    mine = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert mine == sorted((k, *v) for k, v in want)
    return got


def test_against_plain_python(make_docs, odd, empty):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé#|$", k=rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = [" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(rng.randint(0, 8))]
        if i % 3 == 0:
            text.insert(0, f"Page  {i} of\t99 all  rights")
        if i % 4 == 0:
            text += text[:2]
        rows.append((100 + i, "\n".join(text), "en", rng.choice(["a", "a", None])))
    got = check(make_docs(rows).unionByName(odd))
    assert any(r.n_removed_words for r in got) and any(r.n_repeat_words for r in got)
    assert quality.quality_rules(empty).count() == 0


def test_decisions_take_effect(make_docs):
    body = [" ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j) for j in range(26)) for i in range(40)]
    rows = [(i, f"The same first line 12\n{body[i]}\nend", "en", "a") for i in range(40)] + [(90, "too short", "en", "a"), (91, None, "en", "a")]
    rows += [(92, "\n".join(["The same first line 7"] * 8 + [body[0]]), "en", "a")]
    df = make_docs(rows)
    left = quality.apply_quality(df)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == {i: body[i] for i in range(40)}


def body(i):
    return " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(26))


def test_rows_of_one_document_count_once(make_docs):
    own = "a line of its own that no other document has\n" + body(0)
    rows = [(1, own, "en", "a")] * 25 + [(100 + i, body(1 + i), "en", "a") for i in range(10)]
    got = check(make_docs(rows))
    assert len(got) == 35 and all(r.kept and not r.n_removed_words for r in got)
    # rows of one id with different texts, and nameless rows of equal text, are one document each
    head = "the head of all of these pages\n"
    rows = [(1, head + body(i), "en", "a") for i in range(30)] + [(None, head + body(40), "en", "a")] * 30
    got = check(make_docs(rows))
    assert len(got) == 60 and not any(r.n_removed_words for r in got)


def test_same_limit_at_every_host_size(make_docs):
    for others in (0, 600):
        rows = [(i, f"seen on many pages\n{body(i)}", "en", "a") for i in range(21)]
        rows += [(100 + i, f"seen on few pages\n{body(30 + i)}", "en", "a") for i in range(20)]
        rows += [(1000 + i, body(60 + i), "en", "a") for i in range(others)]
        got = check(make_docs(rows))
        assert {r.doc_id for r in got if r.n_removed_words} == set(range(21))
