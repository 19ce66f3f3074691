"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into words by the vocabulary's pre-tokenizer pattern; each distinct word is merged
once. Short words of a batch stand as rows of one matrix: a row holds the word's parts, and beside
them the rank of each adjacent pair. A round finds every row's smallest rank, joins that pair by
deleting the boundary, and looks up the two neighbouring ranks again, until no row has a pair that
the vocabulary can merge. Words longer than a matrix row take a heap over a linked list instead, so
a very long word costs n log n. Documents are independent: no shuffle, and a task holds a few MB of
texts (or one longer text) and a cache of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

# Fixed value: how byte-level BPE of this family cuts a text into words.
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
ROW = 64
CACHE = 250_000
NO_RANK = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes_of(tokenizer, top: int) -> dict[str, str]:
    """Letters, digits and white space below `top` as the tokenizer's own pre-tokenizer sees them.

    Unicode versions differ between libraries, so the classes of the installed `regex` are only a
    first guess: a run of code points of one class must come back as one piece when it follows a
    member of the class, and a run that does not is halved until the odd code points are found.
    """
    def pieces(text: str) -> list[str]:
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    every = "".join(chr(c) for c in range(top) if not 0xD800 <= c < 0xE000)
    guess = {"L": r"\p{L}{1,4096}", "N": r"\p{N}{1,4096}", "S": r"\s{1,4096}", "O": r"[^\s\p{L}\p{N}]{1,4096}"}
    probe = {"L": "a", "N": "1", "O": "!"}
    sets: dict[str, list[str]] = {k: [] for k in guess}

    def place(run: str, kind: str) -> None:
        if kind in probe and len(pieces(probe[kind] + run)) == 1:
            sets[kind].append(run)
        elif len(run) > 1:
            place(run[: len(run) // 2], kind)
            place(run[len(run) // 2 :], kind)
        else:
            sets[next((k for k, p in probe.items() if len(pieces(p + run)) == 1), "S")].append(run)

    for kind, pattern in guess.items():
        for run in regex.findall(pattern, every):
            place(run, kind)
    return {k: ranges("".join(v)) for k, v in sets.items()}


def word_pattern(classes: dict[str, str]) -> str:
    letters, digits, other, space = (classes[k] for k in "LNOS")
    return f"{CONTRACTIONS}| ?(?:[{letters}]+|[{digits}]+|[{other}]+)|[{space}]+(?![{letters}{digits}{other}])|[{space}]+"


def ranges(chars: str) -> str:
    """The inside of a character class for some characters."""
    points = np.sort(np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64))
    breaks = np.flatnonzero(np.diff(points) != 1) + 1
    return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in np.split(points, breaks) if len(p))


class Vocabulary:
    """Ids, merge ranks and decoding of one vocabulary file; built on the driver, sent to tasks once.

    Pair ranks stand in an open-addressed table of fixed size: key (left id, right id), value (rank, id).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * top
        for word, i in ids.items():
            self.pieces[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.pieces[i] = word.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = left << 32 | right
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for r, (k, at, m) in enumerate(zip(keys.tolist(), self.slot(keys).tolist(), made.tolist())):
            tries = 1
            while self.keys[at] not in (-1, k):
                at, tries = (at + 1) & (size - 1), tries + 1
            if self.keys[at] == -1:
                self.keys[at], self.rank[at], self.made[at] = k, r, m
            self.probes = max(self.probes, tries)
        #: Patterns for any text, and for texts of code points under 256, which match faster.
        self.patterns = [word_pattern(classes_of(Tokenizer.from_file(path), top)) for top in (0x110000, 256)]
        self._encoder: Encoder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; NO_RANK where the pair cannot be merged or a side is -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.slot(keys)
        rank, made = np.full(len(keys), NO_RANK, np.int32), np.zeros(len(keys), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            here = at[todo]
            held = self.keys[here]
            hit = held == keys[todo]
            rank[todo[hit]], made[todo[hit]] = self.rank[here[hit]], self.made[here[hit]]
            todo = todo[~hit & (held != -1)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def merge_rows(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of words of at most ROW bytes, all merged together, row by row."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        out: list[list[int]] = [[]] * len(words)
        for group in np.array_split(order, max(1, len(order) // 20_000)):
            done = self._merge_matrix([words[i] for i in group], lengths[group])
            for i, ids in zip(group.tolist(), done):
                out[i] = ids
        return out

    def _merge_matrix(self, words: Sequence[bytes], lengths: np.ndarray) -> list[list[int]]:
        width = int(lengths.max()) + 1
        cell = np.arange(width)
        parts = np.full((len(words), width), -1, np.int32)
        parts[cell[None, :] < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NO_RANK, np.int32)
        rank[:, :-1] = self.lookup(parts[:, :-1].ravel(), parts[:, 1:].ravel())[0].reshape(len(words), -1)
        size = lengths.copy()
        live = np.flatnonzero(rank.min(axis=1) < NO_RANK)
        while len(live):
            p, r = parts[live], rank[live]
            at = r.argmin(axis=1)
            rows = np.arange(len(live))
            _, made = self.lookup(p[rows, at], p[rows, at + 1])
            p[rows, at] = made
            # delete the boundary after the joined part: later cells move one to the left
            shift = np.minimum(cell[None, :] + (cell[None, :] > at[:, None]), width - 1)
            p, r = np.take_along_axis(p, shift, 1), np.take_along_axis(r, shift, 1)
            size[live] -= 1
            r[rows, at] = self.lookup(p[rows, at], p[rows, at + 1])[0]
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self.lookup(p[before, at[before] - 1], p[before, at[before]])[0]
            parts[live], rank[live] = p, r
            live = live[r.min(axis=1) < NO_RANK]
        return [row[:n] for row, n in zip(parts.tolist(), size.tolist())]

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: a heap of pair ranks over a linked list of parts."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].copy()
        n = len(ids)
        nxt, prev = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
        rank, made = self.lookup(ids[:-1], ids[1:])
        heap = [(r, i, int(a), int(b), m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), ids[:-1], ids[1:], made.tolist())) if r < NO_RANK]
        heapq.heapify(heap)
        ids = ids.tolist()

        def push(i: int, j: int) -> None:
            r, m = self.lookup(np.array([ids[i]]), np.array([ids[j]]))
            if r[0] < NO_RANK:
                heapq.heappush(heap, (int(r[0]), i, ids[i], ids[j], int(m[0])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                push(i, nxt[i])
            if prev[i] >= 0:
                push(prev[i], i)
        return [x for x in ids if x >= 0]

    def encoder(self) -> Encoder:
        """One encoder per process, so its cache serves all tasks that run in it."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


class Encoder:
    """A vocabulary with its compiled patterns and a cache of merged words; lives in one process.

    The cache maps a word to its ids as text, their number and the bytes they decode to.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words, self.words_256 = map(re.compile, vocabulary.patterns)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as their ids."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.v.special) else [text]
        out: list = []
        for part in parts:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                out += (self.words_256 if max(part) < "\u0100" else self.words).findall(part)
        return out

    def learn(self, words: Iterable) -> None:
        """Merge the words that the cache lacks."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(words)
        raw = [b"" if isinstance(w, int) else w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if 0 < len(w) <= ROW]
        merged: dict[int, list[int]] = dict(zip(short, self.v.merge_rows([raw[i] for i in short])))
        for i, (w, r) in enumerate(zip(new, raw)):
            ids = [w] if isinstance(w, int) else merged[i] if i in merged else self.v.merge_long(r)
            self.cache[w] = (",".join(map(str, ids)), len(ids), b"".join([self.v.pieces[x] for x in ids]))

    def encode(self, texts: Sequence[str | None]) -> list[list[tuple[str, int, bytes]]]:
        """Per text its words' (ids as text, number of ids, decoded bytes)."""
        split = [self.split(t) if t else [] for t in texts]
        distinct: set = set()
        for words in split:
            distinct.update(words)
        self.learn(distinct)
        found = self.cache
        return [[found[w] for w in words] for words in split]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """A file's vocabulary, read once by the driver."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in chunks(batches, 1, 2 << 20):
            yield make(batch.column(0), encoder.encode(batch.column(1).to_pylist()))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every whole text, special tokens recognised.

    Null or empty text: no ids, decoded to the empty string. Null ids and repeated rows are rows like
    others; an empty table gives an empty result; other columns are ignored. `path` is read on the
    driver; tasks get the vocabulary by broadcast, whose size is the vocabulary's.
    """

    def make(ids: pa.Array, rows: list) -> pa.RecordBatch:
        tokens = [[int(x) for s, _, _ in row for x in s.split(",")] for row in rows]
        text = [b"".join([d for _, _, d in row]).decode("utf-8", "replace") for row in rows]
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(text)],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    return encoded(docs, path, SCHEMA, make)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As `encode`, with digests in place of ids and text: of the ids joined by commas, and of the decoded text."""

    def make(ids: pa.Array, rows: list) -> pa.RecordBatch:
        listed = [hashlib.sha256(",".join([s for s, _, _ in row]).encode()).hexdigest() for row in rows]
        text = [hashlib.sha256(b"".join([d for _, _, d in row]).decode("utf-8", "replace").encode()).hexdigest() for row in rows]
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array([sum([n for _, n, _ in row]) for row in rows], pa.int64()), pa.array(listed), pa.array(text)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encoded(docs, path, DIGESTS, make)
