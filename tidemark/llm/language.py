"""Language identification of mixed-language text: script ranges, word scores, Viterbi spans.

Words are runs of letters. A word's score for a language is the log-probability of its character
trigrams (with its borders) under that language; languages that the training rows never write in the
word's script are out of the question. Viterbi then labels the words of a document so that scores are
largest after a penalty for every switch of language, which yields spans; the language with most
letters in its spans is the prediction.

The model is fitted on a bounded sample: at most SAMPLE training documents of each of at most LANGUAGES
languages, chosen by a hash of their ids. It is a table of LANGUAGES x BUCKETS at most, so it can be
broadcast. Prediction is one pass over the documents without a shuffle. Within a task the documents of
a slice advance together, one word at a time, as lanes of one array.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks

#: Bounds of the sample and of the model.
SAMPLE, LANGUAGES, BUCKETS = 1000, 256, 1 << 15
SWITCH = 12.0
SMOOTHING = 0.5
#: Letters turned into trigram scores at a time.
PIECE = 1 << 19

# Starts of Unicode script ranges and their names; a range ends where the next starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
    (0x20000, "han"), (0x323B0, "other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])
SCHEMA = (
    "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_spans long, "
    "spans array<struct<lang:string,first_word:int,n_words:int>>"
)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts: trigram buckets of all letters, and per word its start, length, script and text."""

    buckets: np.ndarray
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    text: np.ndarray


def words_of(texts: list[str], is_letter: np.ndarray) -> Words:
    joined = "\n".join(t.lower() for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    alpha = is_letter[points]
    edge = np.diff(alpha.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    at = np.flatnonzero(alpha)
    here = np.where(alpha, points, np.uint32(32)).astype(np.uint64)
    before, after = here[at - 1], here[at + 1]
    before[at == 0] = 32
    mixed = (before * np.uint64(0x9E3779B1) ^ here[at] * np.uint64(0x85EBCA77C2B2) ^ after * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    buckets = (mixed >> np.uint64(64 - 15)).astype(np.int32) % BUCKETS
    length = end - begin
    script = NUMBER[np.searchsorted(STARTS, points[begin], side="right") - 1]
    return Words(buckets, np.cumsum(length) - length, length, script, np.searchsorted(text_ends, begin, side="right"))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, log-probabilities
    allowed: np.ndarray  # scripts x languages
    is_letter: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        n = len(self.languages)
        out = np.zeros((len(words.length), n), np.float32)
        if not n or not len(out):
            return out
        firsts = np.searchsorted(words.start, np.arange(0, len(words.buckets), PIECE))
        for a, b in zip(firsts, [*firsts[1:], len(out)]):
            if a < b:
                lo, hi = words.start[a], words.start[b - 1] + words.length[b - 1]
                out[a:b] = np.add.reduceat(self.scores[words.buckets[lo:hi]], words.start[a:b] - lo, axis=0)
        usable = self.allowed[words.script]
        usable |= ~usable.any(axis=1, keepdims=True)
        out[~usable] = -1e6
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word: rows first[i] ... first[i] + count[i] - 1 of `scores` are one document.

    Documents are lanes, longest first; at word t the lanes that still have one are a prefix.
    """
    n, width = scores.shape
    labels = np.zeros(n, np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    order = np.flatnonzero(count > 0)
    first, count = first[order], count[order]
    if not len(first) or not width:
        return labels
    switched = np.zeros((n, width), bool)
    came_from = np.zeros(n, np.int64)
    steps = int(count[0])
    live = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    best = scores[first].astype(np.float64)
    lanes = np.arange(len(first))
    for t in range(1, steps):
        m = live[t]
        rows = first[:m] + t
        prior = best[:m]
        top = prior.argmax(axis=1)
        jump = prior[lanes[:m], top][:, None] - penalty
        moved = jump > prior
        switched[rows], came_from[rows] = moved, top
        best[:m] = np.where(moved, jump, prior) + scores[rows]
    state = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        m = live[t]
        rows = first[:m] + t
        now = state[:m]
        labels[rows] = now
        state[:m] = np.where(switched[rows, now], came_from[rows], now)
    labels[first] = state
    return labels


def held_out(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, folds: int = 5) -> Model:
    """Trigram and script counts of the sample, summed by Spark; the driver gets one row per language and bucket."""
    is_letter = letters()
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), held_out(folds).alias("out"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("out"))
    common = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).select("lang")
    choice = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = rows.select("id", "lang", F.row_number().over(choice).alias("place")).filter(F.col("place") <= SAMPLE).select("id", "lang").distinct()
    # both are bounded by parameters: LANGUAGES rows, and SAMPLE rows of each
    chosen = rows.join(F.broadcast(sample.join(F.broadcast(common), "lang")), ["id", "lang"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 1 << 20):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            words = words_of(batch.column(1).to_pylist(), is_letter)
            for lang in sorted(set(langs)):
                mine = langs[words.text] == lang
                grams = np.bincount(words.buckets[np.repeat(mine, words.length)], minlength=BUCKETS)
                scripts = np.bincount(words.script[mine], words.length[mine], minlength=len(NAMES)).astype(np.int64)
                both = np.concatenate([grams, scripts])
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], ["lang", "at", "n"]
                )

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    seen = [x.as_py() for x in counted["lang"].unique()]
    languages = sorted(seen)
    table = np.zeros((BUCKETS + len(NAMES), len(languages)))
    if languages:
        which = {x: i for i, x in enumerate(languages)}
        table[counted["at"].to_numpy(), [which[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    return Model(languages, scores, scripts > 0.01 * scripts.sum(axis=0), is_letter)


def identify(docs: DataFrame, model: Model | None = None, folds: int = 5, penalty: float = SWITCH) -> DataFrame:
    """Predicted language, its share of the letters, and the spans of languages of every whole text.

    Learns from rows with a text and a language whose crc32(doc_id) mod `folds` is not 0; the
    prediction uses the text alone. lang_pred is the language with most letters (ties: the first in
    order); score is its share of all letters. `und` with score 0 where the text is null, has no
    letter, or nothing was learned. A null id is held out. Repeated rows are rows like others; an
    empty table gives an empty result; other columns are ignored.
    """
    model = model or fit(docs, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tags = [*model.languages, "und"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 2):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            words = words_of(texts, m.is_letter)
            n, k = len(texts), len(m.languages)
            count = np.bincount(words.text, minlength=n)
            first = np.cumsum(count) - count
            labels = viterbi(m.word_scores(words), first, count, penalty)
            share = np.bincount(words.text * max(k, 1) + labels, words.length, minlength=n * max(k, 1)).reshape(n, max(k, 1))
            total = share.sum(axis=1)
            known = (total > 0) & (k > 0)
            top = np.where(known, share.argmax(axis=1), k)
            score = np.where(known, share.max(axis=1) / np.maximum(total, 1), 0.0)
            breaks = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0)) if k else np.zeros(0, np.int64)
            spans_of = np.bincount(words.text[breaks], minlength=n)
            widths = np.diff(breaks, append=len(labels))
            names = pa.DictionaryArray.from_arrays(pa.array(labels[breaks], pa.int32()), pa.array(tags, pa.string())).cast(pa.string())
            spans = pa.StructArray.from_arrays(
                [names, pa.array(breaks - first[words.text[breaks]], pa.int32()), pa.array(widths, pa.int32())], ["lang", "first_word", "n_words"]
            )
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans_of)]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([tags[i] for i in top], pa.string()), pa.array(score, pa.float64()),
                    pa.array(count, pa.int64()), pa.array(spans_of, pa.int64()), listed,
                ],
                ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_spans", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
