import re

from tidemark.llm import licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    """n_words, n_base, first and last word, base labels, by a scan of the word list."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Under the MIT-license; under the mit License! Apache License, Version 2.0", "cc by nc cc by nc",
    "under the mité license", "xunder the mit license", "under the mit licenseé", "cc\nby\tnc", "cc0by nc",
]


def test_base_phrases(make_docs, odd, empty):
    df = make_docs(list(enumerate(TEXTS))).unionByName(odd)
    got = licenses.scan_licenses(df).collect()
    rows = df.select("doc_id", "text").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) for r in got] == [base(r.text) for r in rows]
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in got)
    assert licenses.scan_licenses(empty).count() == 0


def test_shunting_yard():
    assert licenses.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licenses.postfix("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == [
        "mit", "apache-2.0", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and",
    ]
    assert licenses.postfix("MIT and the rest of a sentence") == ["mit", "the", "and"]
    for bad in ("", "OR MIT", "MIT OR", "(MIT", "MIT AND )", "((MIT OR BSD) GPL"):
        assert licenses.postfix(bad) is None


def test_expressions_decide():
    labels, score = licenses.evaluate("GPL-3.0-or-later OR MIT")
    assert labels == {"gpl", "mit"} and score == 1.0
    assert licenses.evaluate("GPL-3.0 AND MIT")[1] == licenses.PERMISSION["gpl"]
    assert licenses.PERMISSION["gpl"] < licenses.evaluate("GPL-2.0 WITH x")[1] < 1
    machine = licenses.automaton()
    row = licenses.scan_text("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", machine)
    assert row[5:] == (["apache-2", "mit"], 1.0, ["mit apache-2.0 or"])
    assert licenses.scan_text("SPDX-License-Identifier: (MIT OR", machine)[5:] == ([], 0.0, [])
