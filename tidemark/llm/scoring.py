"""LM scoring by online logistic context mixing, with an add-constant unigram score beside it.

What is learned from the corpus, all of it in grouped sums over every training document:

* the count of each token (a table as large as the vocabulary, never collected);
* a binary code for bytes given the byte before, short for frequent ones (Huffman codes: 65,536 counts);
* for each of ORDERS hashed contexts (the last one, two and three bytes, and the whole beginning of the
  word) and each node of the code, how often either branch followed. A word's bytes are predicted from
  inside the word, so these come from the token counts, each distinct word once with its count as
  weight. The tables have 2^SLOT_BITS slots each, whatever the corpus, so they can be broadcast.

A text is scored bit by bit. Each context gives the log-odds of its slot, and a gate between 0 and 1 from
how often training met the slot; the sum of weight x gate x log-odds is squashed to a probability, which
an adaptive table refines; the bit's cost is added, and weights and table learn from the error. The mixer
starts anew every SEGMENT bits, so segments of all documents of a slice advance together as lanes of
one array, and a document's score does not depend on its neighbours.

Tokens outside a broadcast list of the HOT most frequent words meet their counts in a join.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, row_key

ORDERS = 4
SLOT_BITS = 19
SEGMENT = 2048
HOT, HOT_BYTES = 200_000, 40
#: Tokens of a document that are laid out at once; the mixer starts anew between such parts.
PART = 1 << 18
ADD = 0.1
END = b"\n"  # cannot occur in a word
CELLS = 33
#: Gated log-odds are kept as whole steps of this size in a byte.
STEPS = 1 / 15.5
RATE, REFINE = 0.02, 0.02
START_WEIGHT = 0.4
#: Sightings of a slot that open its gate half way.
HALF_OPEN = 2.0
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0x100000001B3


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end."""
    return [*(text or "").encode().lower().split(), END]


@dataclass
class Code:
    """Prefix codes for a byte after a byte: length, the nodes on the path, and the branches taken."""

    length: np.ndarray  # before x byte
    node: np.ndarray  # before x byte x depth
    bit: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray) -> Code:
        """Huffman codes from counts of byte pairs; every byte has a code, those never seen the longest."""
        paths = [Code._paths(row.tolist()) for row in counts]
        width = max(len(p) for row in paths for p in row)
        node, bit = np.zeros((2, 256, 256, width), np.uint8)
        for before, row in enumerate(paths):
            for byte, path in enumerate(row):
                node[before, byte, : len(path)] = [n for n, _ in path]
                bit[before, byte, : len(path)] = [b for _, b in path]
        return Code(np.array([[len(p) for p in row] for row in paths]), node, bit)

    @staticmethod
    def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
        heap: list[tuple] = [(c + 1, i, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        for number in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo = [(heap[0], [])]
        while todo:
            (_, i, sides), path = todo.pop()
            if sides is None:
                paths[i] = path
            else:
                todo += [(side, [*path, (i - 256, bit)]) for bit, side in enumerate(sides)]
        return paths


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words in a row, the byte before each (a space before a word), and each word's size.

    A word is its bytes and a space; the end token is one line feed.
    """
    size = np.array([len(w) + (w != END) for w in words], np.int64)
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    if END in words:
        raw = np.delete(raw, np.cumsum([len(w) + 1 for w in words])[[i for i, w in enumerate(words) if w == END]] - 1)
    before = np.roll(raw, 1)
    before[np.cumsum(size) - size] = 32
    return raw, before, size


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def layout(words: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """The bits of all words in a row: bits per word, the bits, and the slots of each context in turn."""
    raw, before, size = spelled(words)
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(raw)) - first
    lengths = code.length[before, raw]
    place = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
    depth = np.arange(len(place), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    entry = (before.astype(np.int32) << 8 | raw)[place] * np.int32(code.bit.shape[2]) + depth
    bits = code.bit.ravel()[entry]
    nodes = code.node.ravel()[entry].astype(np.uint32) * np.uint32(0xC2B2AE35)
    per_word = np.add.reduceat(lengths, np.cumsum(size) - size) if len(size) else size

    def slots() -> Iterator[np.ndarray]:
        wide = raw.astype(np.uint64) + np.uint64(1)
        for order in range(ORDERS):
            if order < ORDERS - 1:
                context = np.zeros(len(raw), np.uint64)
                for back in range(1, order + 2):
                    earlier = np.zeros(len(raw), np.uint64)
                    earlier[back:] = wide[:-back] if len(raw) > back else wide[:0]
                    context = context * np.uint64(257) + np.where(at >= back, earlier, np.uint64(0))
            else:
                context = np.zeros(len(raw), np.uint64)
                # bytes times powers, summed from the word's start; powers are taken back to the start
                power, back_power = powers(STEP, len(raw)), powers(pow(STEP, -1, 1 << 64), len(raw))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power, dtype=np.uint64)])
                if len(raw):
                    context = (sums[:-1] - sums[first]) * back_power[first]
            mixed = (context * MIX + np.uint64(order + 1)) * MIX
            mixed = (mixed ^ mixed >> np.uint64(29)).astype(np.uint32)
            slot = mixed[place]
            slot += nodes
            slot *= np.uint32(0x9E3779B1)
            slot ^= slot >> np.uint32(15)
            slot *= np.uint32(0x85EBCA77)
            slot >>= np.uint32(32 - SLOT_BITS)
            yield slot.astype(np.int32)

    return per_word, bits, slots()


@dataclass
class Model:
    code: Code
    odds: np.ndarray  # ORDERS x slots, bytes: log-odds of a 1 bit times the slot's gate, in STEPS
    hot: dict[bytes, int]
    total: int
    distinct: int

    def costs(self, words: list[bytes], stream: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of each run of tokens: `stream` are word numbers, a run is first[i] ... + count[i]."""
        per_word, bits, slots = layout(words, self.code)
        inputs = np.empty((len(bits), ORDERS), np.int8)
        for k, slot in enumerate(slots):
            inputs[:, k] = self.odds[k].take(slot)
        begin = np.cumsum(per_word) - per_word
        # positions of all bits of the stream in the words' bits
        lengths = per_word[stream]
        ends = np.cumsum(lengths)
        where = np.repeat((begin[stream] - (ends - lengths)).astype(np.int32), lengths)
        where += np.arange(len(where), dtype=np.int32)
        run_begin = np.concatenate([[0], ends])[first]
        run_bits = np.concatenate([[0], ends])[first + count] - run_begin
        parts = -(-run_bits // SEGMENT)
        run = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        off = run_begin[run] + nth * SEGMENT
        length = np.minimum(SEGMENT, run_bits[run] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        cost = np.zeros(len(run))
        cost[order] = mix(inputs, bits, where, off[order], length[order])
        return np.bincount(run, cost, minlength=len(first)) / math.log(10)


def mix(inputs: np.ndarray, bits: np.ndarray, where: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log probability of each lane's bits; lanes stand longest first.

    `inputs` are bytes, one row of ORDERS for each bit of the words, and travel as one number a row.
    """
    lanes, block = len(off), 64
    rows = np.ascontiguousarray(inputs).view(np.int32).ravel()
    truth = bits.astype(np.float32)
    weights = np.full((ORDERS, lanes), START_WEIGHT * STEPS, np.float32)
    centre = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 2))
    refined = np.tile(centre.astype(np.float32), lanes)
    cell = np.arange(lanes) * CELLS + CELLS // 2
    total = np.zeros(lanes)
    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if lanes else 1), side="right")
    product = np.empty((ORDERS, lanes), np.float32)
    kept = np.empty((block, lanes), np.float32)
    for begin in range(0, len(live), block):
        counts = live[begin : begin + block].tolist()
        at = off[: counts[0], None] + np.arange(begin, begin + len(counts))
        at = where.take(at, mode="clip").T.astype(np.int64, order="C")
        kept[:] = 0
        for t, m in enumerate(counts):
            here = at[t, :m]
            x = rows.take(here).view(np.int8).reshape(m, ORDERS).T.astype(np.float32, order="C")
            y = truth.take(here)
            w = weights[:, :m]
            s = np.multiply(w, x, out=product[:, :m]).sum(axis=0)
            np.minimum(np.maximum(s, -7.9, out=s), 7.9, out=s)
            cells = np.rint(s * np.float32(2)).astype(np.int64)
            cells += cell[:m]
            p = np.exp(-s, out=s)
            p += np.float32(1)
            np.reciprocal(p, out=p)
            r = refined.take(cells)
            miss, wide = np.subtract(y, p), np.subtract(y, r)
            # the probability given to the bit is one less the mean of the two misses
            np.abs(miss + wide, out=kept[t, :m])
            miss *= np.float32(RATE * STEPS * STEPS)
            x *= miss
            w += x
            wide *= np.float32(REFINE)
            wide += r
            refined[cells] = wide
        total += np.log1p(kept[: len(counts)] * np.float32(-0.5)).sum(axis=0, dtype=np.float64)
    return total


def held_out(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def token_counts(docs: DataFrame, folds: int) -> DataFrame:
    """(w, c): how often each token occurs in the training documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "c"])

        for batch in chunks(batches, 0):
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            if len(found) > 200_000:  # bounded memory; Spark adds up what is sent more than once
                yield out()
                found = Counter()
        yield out()

    train = docs.filter(~held_out(folds)).select(F.col("text").cast("string").alias("text"))
    return train.mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, folds: int = 10) -> tuple[Model, DataFrame]:
    """The model and the table of token counts."""
    counts = cut(token_counts(docs, folds))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = counts.filter(F.length("w") <= HOT_BYTES).orderBy(F.col("c").desc(), "w").limit(HOT).toArrow()

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16)
        for batch in batches:
            if batch.num_rows:
                raw, before, size = spelled(batch.column(0).to_pylist())
                weight = np.repeat(batch.column(1).to_numpy(), size)
                seen += np.bincount(before.astype(np.int64) << 8 | raw, weight, minlength=1 << 16)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at].astype(np.int64))], ["at", "n"])

    frequency = np.zeros(1 << 16, np.int64)
    for at, n in counts.mapInArrow(pairs, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        frequency[at] = n
    code = Code.fit(frequency.reshape(256, 256))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ORDERS << SLOT_BITS))

        def add(words: list[bytes], weights: list[np.ndarray]) -> None:
            per_word, bits, slots = layout(words, code)
            weight = np.repeat(np.concatenate(weights), per_word).astype(np.float64)
            for k, slot in enumerate(slots):
                part = slice(k << SLOT_BITS, (k + 1) << SLOT_BITS)
                for bit in (0, 1):
                    seen[bit, part] += np.bincount(slot, weight * (bits == bit), minlength=1 << SLOT_BITS)

        words: list[bytes] = []
        weights: list[np.ndarray] = []
        held = 0
        for batch in batches:
            words += batch.column(0).to_pylist()
            weights.append(batch.column(1).to_numpy())
            held += batch.nbytes
            if held > 1 << 20:
                add(words, weights)
                words, weights, held = [], [], 0
        if words:
            add(words, weights)
        at = np.flatnonzero(seen.any(axis=0))
        for some in np.array_split(at, max(1, len(at) // 100_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *(pa.array(seen[bit, some].astype(np.int64)) for bit in (0, 1))], ["slot", "n0", "n1"]
            )

    summed = counts.mapInArrow(contexts, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = summed.toArrow()  # at most ORDERS << SLOT_BITS rows
    odds = np.zeros(ORDERS << SLOT_BITS, np.int8)
    n0, n1 = table["n0"].to_numpy(), table["n1"].to_numpy()
    gated = np.log((n1 + 0.02) / (n0 + 0.02)).clip(-8, 8) * (n0 + n1) / (n0 + n1 + HALF_OPEN)
    odds[table["slot"].to_numpy()] = np.rint(gated / STEPS)
    words = dict(zip(hot["w"].to_pylist(), hot["c"].to_pylist()))
    return Model(code, odds.reshape(ORDERS, -1), words, int(total), int(distinct)), counts


def parts_of(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents' tokens in parts of at most PART tokens a document: (documents, tokens)."""
    which: list[int] = []
    lists: list[list[bytes]] = []
    for i, text in enumerate(texts):
        words = tokens(text)
        for begin in range(0, len(words), PART):
            if len(words) > PART and which:
                yield which, lists
                which, lists = [], []
            which.append(i)
            lists.append(words[begin : begin + PART])
    if which:
        yield which, lists


def score_texts(model: Model, texts: list[str | None]):
    """Per text: tokens, known hot tokens, their summed log10 counts, log10 probability; and the rare words."""
    n = len(texts)
    n_tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    logs, score = np.zeros(n), np.zeros(n)
    rare: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
    for which, lists in parts_of(texts):
        flat = list(itertools.chain.from_iterable(lists))
        words = list(dict.fromkeys(flat))
        number = dict(zip(words, range(len(words))))
        stream = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(x) for x in lists])
        doc = np.repeat(np.array(which), sizes)
        count = np.array([model.hot.get(w, 0) for w in words])
        value = np.log10(count + ADD)
        common = count[stream] > 0
        n_tokens += np.bincount(doc, minlength=n)
        known += np.bincount(doc[common], minlength=n)
        logs += np.bincount(doc[common], value[stream[common]], minlength=n)
        pair, times = np.unique(doc[~common] * len(words) + stream[~common], return_counts=True)
        rare.append((pair // len(words), [words[i] for i in (pair % len(words)).tolist()], times))
        costs = model.costs(words, stream, np.cumsum(sizes) - sizes, sizes)
        score += np.bincount(np.array(which), costs, minlength=n)
    return n_tokens, known, logs, score, rare


LEAD = "struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,known:bigint,logs:double,score:double>"


def score_documents(docs: DataFrame, folds: int = 10, fitted: tuple[Model, DataFrame] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of every whole text.

    score is the mixing model's log10 probability of the tokens' bytes (each word and a space, then the
    end). Learns from documents whose crc32(doc_id) mod `folds` is not 0.

    Null or empty text: the end alone. A null id counts as held out. Rows equal in id and text are one
    document of the result, though each of them trains. Without training documents all counts are 0
    and bytes are coded by an untrained model. An empty table gives an empty result; other columns are ignored.
    """
    model, counts = fitted or fit(docs, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "known", "logs", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 4, 2 << 20):
            n_tokens, known, logs, score, rare = score_texts(m, batch.column(4).to_pylist())
            k1, k2 = batch.column(2), batch.column(3)
            lead = pa.StructArray.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(known), pa.array(logs), pa.array(score)], names
            )
            # a key with spaces is no word, so the row finds no count; it differs by document, so such rows spread
            alone = pa.array([b" %d %d" % pair for pair in zip(k1.to_pylist(), k2.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [k1, k2, alone, pa.array(np.zeros(len(alone), np.int64)), lead], ["_k1", "_k2", "w", "n", "lead"]
            )
            for at, words, times in rare:
                if len(at):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [k1.take(at), k2.take(at), pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.nulls(len(at), lead.type)],
                        ["_k1", "_k2", "w", "n", "lead"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held_out"), *row_key("text"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"_k1 long, _k2 long, w binary, n long, lead {LEAD}")
    met = scored.join(counts, "w", "left")
    times = F.col("times")
    per_doc = met.groupBy("_k1", "_k2").agg(
        F.count("lead").alias("times"), F.max("lead.doc_id").alias("doc_id"), F.max("lead.held_out").alias("held_out"),
        F.max("lead.n_tokens").alias("n_tokens"), F.max("lead.known").alias("known"), F.max("lead.logs").alias("logs"),
        F.max("lead.score").alias("score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("rare_logs"),
    )
    space = math.log10(model.total + ADD * (model.distinct + 1))
    base = F.col("logs") + F.col("rare_logs") / times - F.col("n_tokens") * F.lit(space)
    return per_doc.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.expr("rare_known div times")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
