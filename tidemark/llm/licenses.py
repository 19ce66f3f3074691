"""License scans: Aho-Corasick over normalised words, and a shunting-yard parser for expressions.

Every task builds one automaton from a fixed list of phrases and tags and runs each whole document
through it, so there is no shuffle and a document never meets another. Texts are normalised to
lower-case words with single spaces first; a phrase then is one string, and its word index is the
number of spaces before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

# Phrases whose words, standing consecutively, name a licence.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases and the labels this method gives them.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
# How freely text under a licence may be used, 0 to 1; unknown licences get UNKNOWN.
PERMISSION = {
    "0bsd": 1.0, "agpl": 0.2, "apache-2": 1.0, "bsd": 1.0, "cc-by": 0.9, "cc-by-nc": 0.3, "cc-by-sa": 0.6, "cc0": 1.0,
    "gpl": 0.3, "isc": 1.0, "lgpl": 0.5, "mit": 1.0, "mpl": 0.6, "proprietary": 0.0, "unlicense": 1.0,
}
UNKNOWN = 0.4
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, expressions array<string>"
)
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TAG_AT = re.compile(rb"(?:spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier|license[^0-9a-z\x80-\xff]+expression)[ \t]*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")


def family(identifier: str) -> str:
    """The label of a licence identifier: its name without version, -only, -or-later or clause counts."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-\d+-clause.*$", "", name)
    if name in PERMISSION:
        return name
    if name.startswith("apache-2"):
        return "apache-2"
    return re.sub(r"-?v?\d+(\.\d+)*$", "", name) or name


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's identifiers and operators in postfix order; None if it is malformed.

    `with` binds closest, then `and`, then `or`; all associate to the left. A text that continues
    after a complete expression (a comment's end, a sentence) ends it there.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand_next:
                break
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            if "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next:
                if "(" in held:
                    return None
                break
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """The labels an expression names and the permission it gives; None if it is malformed.

    `or` leaves the choice, so the larger permission counts; `and` binds to both, so the smaller;
    an exception added by `with` only widens what the licence allows, half way up to 1.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[frozenset[str], float]] = []
    for token in order:
        if token not in PRECEDENCE:
            label = family(token)
            stack.append((frozenset([label]), PERMISSION.get(label, UNKNOWN)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], (1 + left[1]) / 2))
        else:
            stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
    return stack[0]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        key = f" {phrase} "
        found.add_word(key, (phrase, len(key)))
    found.make_automaton()
    return found


def scan_text(text: str | None, machine) -> tuple:
    raw = (text or "").encode()
    words = raw.translate(SPACED).split()
    spaced = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end - n + 1, phrase) for end, (phrase, n) in machine.iter(spaced)]
    base: list[int] = []
    labels: set[str] = set()
    named: set[str] = set()
    score, expressions, seen, upto = 0.0, [], 0, 0
    for at, phrase in sorted(hits):
        seen += spaced.count(" ", upto, at)
        upto = at
        if phrase in BASE:
            base.append(seen)
            named.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
    if any(phrase in TAGS for _, phrase in hits):
        for tag in TAG_AT.finditer(raw.lower()):
            if value := evaluate(tag[1].decode()):
                expressions.append(" ".join(postfix(tag[1].decode())))
                labels |= value[0]
                score = max(score, value[1])
    score = max([score, *(PERMISSION.get(x, UNKNOWN) for x in named | (labels if not expressions else set()))])
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), sorted(named), sorted(named | labels), score, expressions,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence labels of every document, with the places of the base phrases.

    Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters.
    n_base counts all places, first_word and last_word are the smallest and largest start. The score
    is the largest permission a label or an evaluated expression gives, 0 where there is none.

    Null or empty text: no words, no labels, score 0. A malformed expression adds nothing. Repeated
    rows and null ids are rows like others; an empty table gives an empty result; other columns are
    ignored. A task holds a few MB of texts, or one longer text.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        names = SCHEMA.replace(",", "").split()[::2]
        types = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.string())]
        for batch in chunks(batches, 1):
            rows = [scan_text(t, machine) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
