"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z lower-cased, runs without ASCII white space),
joined by one space and closed by an end mark.  Its bytes are cut into
binary choices along Huffman trees, one for each of the most frequent
pairs of preceding bytes, some 2.6 choices a byte.  Three predictors
estimate each choice: the tree's own counts at the choice, and counts in
hashed slots of two longer contexts, four preceding bytes and the word so
far.  Their log-odds are mixed by weights; a gate, the number of
predictors that know the context, says which set of weights holds.
Weights learn online: every ``ROUND`` coded choices move them against
their coding errors.  A table over the mixed probability, which learns
online as well, refines it; the mean of both codes the choice.  The score
is the log10 of the product, bits per byte follow.

What is learned from the training texts grows with them: word counts, runs
of three bytes (for the trees) and the predictors' slot counts, added up
by Spark.  The slots are a table of fixed size (``SLOT_BITS``, 2 MB a
predictor), as hashed contexts are, so tasks get it by broadcast.  Weights start the same
in every stretch of ``LANE`` bytes: stretches are scored side by side, a
very long text is many of them, and no score depends on which other texts
are in the batch.

The base score is the add-one unigram model.  Counts of the most frequent
words (at most ``TOP_WORDS``) go to the tasks, all other words of a text
meet their counts in a join.

Defined results: a null or empty text is one end mark; a null id counts as
a training text; with nothing to learn from, base scores are 0 and every
choice costs one bit; repeated rows are scored alike and all returned; an
empty table gives none; columns named like an output are replaced, other
columns pass through.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import free_name, release_memory, table, utf8_slices, written
from tabloom.llm.shingles import _LOWER, _SPACE, _powers, word_hashes

#: Slots of a predictor: 2 ** SLOT_BITS.
SLOT_BITS = 21
#: Bytes over which weights learn before they start afresh.
LANE = 1024
#: Bytes mixed at a time.
GROUP_BYTES = 1 << 19
#: Most words whose counts every task holds (16 bytes each).
TOP_WORDS = 1_000_000
#: Words in a text are looked up in slices of so many bytes.
SLICE_BYTES = 2 << 20

END = 0xFF  # no byte of UTF-8
REACH = 4  # bytes that a context looks back
PREDICTORS = 2
#: Pairs of preceding bytes with a tree of their own.
OWN_TREES = 1024
#: Choices after which a lane's weights learn.
ROUND = 32
BLOCK_BITS = 15
START_WEIGHT, RATE = np.float32(0.3), np.float32(0.01)
REFINE_CELLS, REFINE_RATE = 24, np.float32(0.02)
#: Log-odds are held in steps of 1/12 as one byte.
STEP = np.float32(1 / 12)
#: A text byte costs a task about this many times as many bytes of slots; more tasks would only send more of them.
BYTES_A_TASK = 512 << 20


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def spelled(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of texts: REACH end marks, the words with one space between, an end mark; and each text's start."""
    x = _LOWER[data]
    kept = np.flatnonzero(~_SPACE[x])
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(kept, off)))
    opens = np.append(True, (np.diff(kept) > 1) | (np.diff(row) > 0)) if len(kept) else np.zeros(0, bool)
    first = np.append(True, np.diff(row) > 0) if len(kept) else opens
    spaced = opens & ~first
    place = np.cumsum(spaced, dtype=np.int32)  # spaces before, the marks of the texts, and the bytes themselves
    place += np.int32(REACH + 1) * row
    place += np.arange(REACH, REACH + len(kept), dtype=np.int32)
    spaces = np.bincount(row[spaced], minlength=n)
    sizes = np.bincount(row, minlength=n) + spaces + REACH + 1
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    out[place] = x[kept]
    for k in range(REACH):
        out[starts + k] = END
    out[starts + sizes - 1] = END
    return out, starts


def _fold(x: np.ndarray) -> np.ndarray:
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


_UP = 0x9E3779B97F4A7C15


def contexts(seq: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Hashed context of each byte from ``lo`` to ``hi`` for each predictor; ``lo`` is at least REACH."""
    mark = (seq[:lo][::-1][:1 << 16] == 0x20) | (seq[:lo][::-1][:1 << 16] == END)
    found = np.flatnonzero(mark)
    begin = lo - int(found[0]) if len(found) else int(np.flatnonzero((seq[:lo] == 0x20) | (seq[:lo] == END))[-1]) + 1
    back = lambda k: seq[lo - k: hi - k].astype(np.uint32)
    four = back(1) | back(2) << np.uint32(8) | back(3) << np.uint32(16) | back(4) << np.uint32(24)
    own = seq[begin:hi]
    up, down = _powers(len(own) + 1)
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], dtype=np.uint64, out=sums[1:])
    after = np.append(True, (own[:-1] == 0x20) | (own[:-1] == END))  # the first byte of each word
    opens = np.flatnonzero(after)
    word = np.repeat(opens, np.diff(np.append(opens, len(own))))[lo - begin:]
    at = np.arange(lo - begin, hi - begin)
    so_far = ((sums[at] - sums[word]) * down[word] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    return [_fold(four * np.uint32(0x2545F491) + np.uint32(1)), _fold(so_far.astype(np.uint32))]


class Codes:
    """Binary choices of each byte: a Huffman tree for each of the most frequent pairs of preceding bytes, else for the one preceding byte."""

    def __init__(self, triples: np.ndarray, counts: np.ndarray):
        """``triples``: (byte before, preceding byte, byte) as one number each, and their counts."""
        before, byte = triples >> 8, triples & 255
        total = np.bincount(before, weights=counts, minlength=65536)
        after_one = np.zeros((256, 256))
        np.add.at(after_one, (before & 255, byte), counts)
        every = after_one.sum(axis=0) / max(1.0, counts.sum())
        own = np.argsort(-total, kind="stable")[:OWN_TREES]
        own = np.sort(own[total[own] > 0])
        self.tree = np.arange(65536, dtype=np.int32) & 255
        self.tree[own] = 256 + np.arange(len(own), dtype=np.int32)
        order = np.argsort(before, kind="stable")
        ends = np.searchsorted(before[order], np.arange(65537))
        shape = (256 + len(own), 256)
        self.length, self.start = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        nodes: list[int] = []
        odds: list[float] = []
        for tree in range(shape[0]):
            seen = np.zeros(256)
            if tree < 256:
                seen = after_one[tree]
                likely = every
            else:
                pair = int(own[tree - 256])
                mine = order[ends[pair]: ends[pair + 1]]
                seen[byte[mine]] = counts[mine]
                likely = after_one[pair & 255] / max(1.0, after_one[pair & 255].sum()) + every / 100
            # every byte has a code, seen or not
            for b, path in self._paths(seen, likely / 4 + 1e-4, tree):
                self.length[tree, b], self.start[tree, b] = len(path), len(nodes)
                nodes += [n for n, _ in path]
                odds += [o for _, o in path]
        raw = np.array(nodes, np.uint64)
        # hash of the choice's node, and its outcome in the lowest bit
        hashed = ((raw >> np.uint64(1)) * np.uint64(_UP) + np.uint64(0x1234567)) >> np.uint64(64 - SLOT_BITS)
        self.choice = (hashed << np.uint64(1) | raw & np.uint64(1)).astype(np.uint32)
        self.odds = np.clip(np.rint(np.array(odds) / STEP), -127, 127).astype(np.int8)

    @staticmethod
    def _paths(seen: np.ndarray, likely: np.ndarray, tree: int) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(byte, [(node and outcome, the node's log-odds)]) of a tree."""
        met = seen.tolist()
        heap = [(c, i) for i, c in enumerate((seen + likely).tolist())]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        while len(heap) > 1:
            (ca, a), (cb, b) = heapq.heappop(heap), heapq.heappop(heap)
            kids.append((a, b))
            met.append(met[a] + met[b])
            heapq.heappush(heap, (ca + cb, 255 + len(kids)))
        open_: list[tuple[int, list]] = [(heap[0][1], [])]
        while open_:
            node, path = open_.pop()
            if node < 256:
                yield node, path
                continue
            a, b = kids[node - 256]
            odds = math.log((met[b] + 0.4) / (met[a] + 0.4))
            name = (tree * 256 + node - 256) << 1
            open_ += [(a, [*path, (name, odds)]), (b, [*path, (name | 1, odds)])]

    def choices(self, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each choice in ``choice`` and ``odds``, the byte it belongs to, and where each byte's choices end; ``before``: two bytes as one number."""
        code = self.tree.take(before) * np.int32(256) + own
        n = self.length.ravel().take(code)
        ends = np.cumsum(n, dtype=np.int64)
        each = np.repeat(np.arange(len(n)), n)
        at = (self.start.ravel().take(code) - ends + n).take(each, mode="clip")
        at += np.arange(len(at))
        return at, each, ends


def _lanes(starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each stretch of LANE coded bytes."""
    first = starts + REACH
    size = np.append(starts[1:], total) - first
    n = -(-size // LANE)
    text = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    lo = first[text] + k * LANE
    return lo, np.minimum(LANE, size[text] - k * LANE), text


def _groups(lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of lanes of some GROUP_BYTES."""
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(lo, lo[a] + GROUP_BYTES)))
        yield a, b
        a = b


def _met(codes: Codes, seq: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each hashed predictor with the outcome in the lowest bit, the choices' places in ``codes``, and each lane's first choice and number of choices."""
    begin, end = int(lo[0]), int(lo[-1] + size[-1])
    inside = np.zeros(end - begin + 1, np.int8)
    inside[lo - begin] += 1
    np.subtract.at(inside, lo + size - begin, 1)
    own = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    before = seq[begin - 2: end - 2].astype(np.int32) << 8 | seq[begin - 1: end - 1]
    at, each, ends = codes.choices(before.take(own), seq[begin:end].take(own))
    choice = codes.choice.take(at, mode="clip")
    slots = [(c.take(own) << np.uint32(1)).take(each, mode="clip") ^ choice for c in contexts(seq, begin, end)]
    ends = np.append(0, ends)
    own_at = np.cumsum(size) - size
    return slots, at, ends[own_at], ends[own_at + size] - ends[own_at]


def _coded(codes: Codes, seq: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each hashed predictor, outcomes, the trees' log-odds, and each lane's first choice and number of choices."""
    slots, at, first, count = _met(codes, seq, lo, size)
    return [s >> np.uint32(1) for s in slots], (slots[0] & np.uint32(1)).astype(np.int8), codes.odds.take(at, mode="clip"), first, count


def mixed_bits(x: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits of each lane: ``x`` (choices x inputs, log-odds in STEPs, and last twice the gate plus the outcome), each lane's first choice and their number.

    All lanes take their next ROUND choices at the same time; each has its
    own weights and its own refinement, which learn after every round.
    """
    order = np.argsort(-count, kind="stable")
    place, sizes = first[order].astype(np.int64), count[order].astype(np.int64)
    lanes, gates = len(count), x.shape[1]
    weights = [np.full(lanes * gates, START_WEIGHT, np.float32) for _ in range(gates - 1)]
    cell = (np.arange(REFINE_CELLS) - REFINE_CELLS / 2 + 0.5) * 16 / REFINE_CELLS
    refine = np.tile((1 / (1 + np.exp(-cell))).astype(np.float32), lanes)
    wide = np.float32(8 * (1 - 1e-6))
    bits = np.zeros(lanes)
    steps = np.arange(ROUND)
    every = (place[:, None] + steps).ravel()  # of the first round: each lane's choices, its first weight and its middle cell
    all_gates, all_cells = (np.repeat(np.arange(lanes) * k + m, ROUND) for k, m in ((gates, 0), (REFINE_CELLS, REFINE_CELLS // 2)))
    for t in range(0, int(sizes[0]) if lanes else 0, ROUND):
        n = int(np.searchsorted(-sizes, -t))
        m = int(np.searchsorted(-sizes, -t - ROUND, side="right"))  # lanes with a whole round left; the next ones end in it
        at, k, c = every[: n * ROUND], all_gates[: n * ROUND], all_cells[: n * ROUND]
        if m < n:
            there = np.flatnonzero(steps < (sizes[m:n] - t)[:, None]) + m * ROUND
            at, k, c = (np.concatenate([v[: m * ROUND], v.take(there)]) for v in (at, k, c))
        at = at + t
        *given, last = x.take(at, axis=0, mode="clip").T  # every index is in its array: "clip" saves a check
        own = [v * STEP for v in given]
        y = (last & 1).astype(np.float32)
        k = k + (last >> 1)
        z = weights[0].take(k, mode="clip")
        z *= own[0]
        for w, v in zip(weights[1:], own[1:], strict=True):
            more = w.take(k, mode="clip")
            more *= v
            z += more
        np.minimum(np.maximum(z, -wide, out=z), wide, out=z)
        c = c + np.floor(z * np.float32(REFINE_CELLS / 16)).astype(np.int64)
        np.exp(np.negative(z, out=z), out=z)
        z += np.float32(1)
        p = np.reciprocal(z, out=z)
        r = refine.take(c, mode="clip")
        coded = np.log(np.abs((p + r) * np.float32(0.5) - (np.float32(1) - y)))
        bits[:m] -= coded[: m * ROUND].reshape(m, ROUND).sum(axis=1, dtype=np.float64)
        if m < n:
            bits[m:n] -= np.bincount(there // ROUND - m, weights=coded[m * ROUND:], minlength=n - m)
        refine[: n * REFINE_CELLS] += np.bincount(c, weights=(y - r) * REFINE_RATE, minlength=n * REFINE_CELLS).astype(np.float32)
        y -= p
        y *= RATE
        for w, v in zip(weights, own, strict=True):
            v *= y
            w[: n * gates] += np.bincount(k, weights=v, minlength=n * gates).astype(np.float32)
    out = np.empty(lanes)
    out[order] = bits / np.log(2)
    return out


def text_bits(codes: Codes, tables: np.ndarray, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bits of each text of a slice."""
    seq, starts = spelled(off, data)
    lo, size, text = _lanes(starts, len(seq))
    out = np.zeros(len(starts))
    for a, b in _groups(lo, size):
        slots, bit, odds, first, count = _coded(codes, seq, lo[a:b], size[a:b])
        x = np.empty((len(bit), PREDICTORS + 2), np.int8)
        gate = np.zeros(len(bit), np.int8)
        for i, v in enumerate([odds, *(t.take(s, mode="clip") for t, s in zip(tables, slots, strict=True))]):
            x[:, i] = v
            gate += v != 0
        x[:, -1] = 2 * gate + bit
        out += np.bincount(text[a:b], weights=mixed_bits(x, first, count), minlength=len(out))
    return out


_COUNTS = "kind int, key long, n long"
WORD, TRIPLE, TEXTS = range(3)


def corpus_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, n): words by hash, runs of three bytes and the number of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_texts = 0

        def packed(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64, copy=False)), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            n_texts += batch.num_rows
            for _, _, off, data in utf8_slices(batch.column(0), SLICE_BYTES):
                key, n = np.unique(word_hashes(off, data)[0], return_counts=True)
                yield packed(WORD, key.view(np.int64), n)
                seq, starts = spelled(off, data)
                own = np.ones(len(seq), bool)
                for k in range(REACH):
                    own[starts + k] = False
                at = np.flatnonzero(own)
                three = seq[at].astype(np.uint32)
                for k in (1, 2):
                    three |= seq[at - k].astype(np.uint32) << np.uint32(8 * k)
                key, n = np.unique(three, return_counts=True)
                yield packed(TRIPLE, key, n)
        yield packed(TEXTS, np.zeros(1, np.int64), np.array([n_texts]))
        release_memory()

    return texts.select(text_col).mapInArrow(run, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def slot_counts(texts: DataFrame, text_col: str, codes: Any) -> DataFrame:
    """(predictor, block, slots, zeros, ones): counts of the slots that a task has met, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = codes.value, [np.zeros(2 << SLOT_BITS, np.uint32) for _ in range(PREDICTORS)]
        for batch in batches:
            for _, _, off, data in utf8_slices(batch.column(0), SLICE_BYTES):
                seq, starts = spelled(off, data)
                lo, size, _ = _lanes(starts, len(seq))
                for a, b in _groups(lo, size):
                    for have, s in zip(counts, _met(own, seq, lo[a:b], size[a:b])[0], strict=True):
                        np.add.at(have, s.astype(np.int64), np.uint32(1))
        for i, have in enumerate(counts):
            both = have.reshape(-1, 2)
            met = np.flatnonzero(both.any(axis=1))
            cuts = np.searchsorted(met >> BLOCK_BITS, np.arange((1 << SLOT_BITS - BLOCK_BITS) + 1)).tolist()
            rows = [(i, b, *_narrow(met[x:y], both[met[x:y]])) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)],
                    names=["predictor", "block", "slots", "zeros", "ones"],
                )
        del counts[:]
        release_memory()

    return texts.select(text_col).mapInArrow(run, "predictor int, block int, slots binary, zeros binary, ones binary")


def _narrow(slots: np.ndarray, counts: np.ndarray) -> list[bytes]:
    size = np.uint16 if counts.max() < 1 << 16 else np.uint32
    return [(slots & (1 << BLOCK_BITS) - 1).astype(np.uint16).tobytes(), counts[:, 0].astype(size).tobytes(), counts[:, 1].astype(size).tobytes()]


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of an outcome of 1 in STEPs; 0 where nothing is known."""
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    return np.clip(np.rint(odds / STEP), -127, 127).astype(np.int8)


def slot_tables(counts: DataFrame) -> DataFrame:
    """(predictor, block, odds): the tasks' counts of each block added up one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 1 << BLOCK_BITS), np.int64)

        def packed():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([log_odds(*sums).tobytes()])], names=["predictor", "block", "odds"]
            )

        for batch in batches:
            for i, b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now != (i, b):
                    yield packed()
                    sums[:] = 0
                now = (i, b)
                slots = np.frombuffer(raw[0], np.uint16)
                for k in range(2):
                    sums[k, slots] += np.frombuffer(raw[1 + k], np.uint16 if len(raw[1 + k]) == len(raw[0]) else np.uint32)
        if now is not None:
            yield packed()

    dealt = counts.repartition("predictor", "block").sortWithinPartitions("predictor", "block")
    return dealt.mapInArrow(run, "predictor int, block int, odds binary")


@dataclass
class Model:
    words: DataFrame  # (key, n): counts of words by hash that aren't among the top ones
    tokens: int  # words and end marks of the training texts
    distinct: int
    shared: Any  # broadcast: codes, tables, top words' hashes (sorted) and counts, count of end marks


def learn(texts: DataFrame, text_col: str = "text", top_words: int = TOP_WORDS) -> Model:
    """Model of ``texts``: every text counts, whole."""
    spark = texts.sparkSession
    counts = written(corpus_counts(texts, text_col), "lm-counts")
    n_texts = counts.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    triples = counts.where(F.col("kind") == TRIPLE).select("key", "n").toArrow()  # of UTF-8 bytes: some ten thousand, 2^24 at most
    codes = Codes(triples["key"].to_numpy(), triples["n"].to_numpy())
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.count("*"), F.sum("n")).first()
    # the least count whose words and those above it are no more than top_words
    by_count = words.select(F.least("n", F.lit(1 << 16)).alias("n")).groupBy("n").count().orderBy(F.desc("n")).collect()
    least, have = (1 << 16) + 1, 0
    for n, several in by_count:  # one row for each count up to 65 536
        if have + several > top_words:
            break
        least, have = n, have + several
    top = words.where(F.col("n") >= least).toArrow() if have else None
    keys = top["key"].to_numpy() if top else np.zeros(0, np.int64)
    order = np.argsort(keys)
    top_counts = top["n"].to_numpy()[order] if top else np.zeros(0, np.int64)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(sum(triples["n"].to_pylist())) // BYTES_A_TASK)
    parts = slot_counts(texts.coalesce(tasks), text_col, spark.sparkContext.broadcast(codes))
    tables = np.zeros((PREDICTORS, 1 << SLOT_BITS), np.int8)
    for i, b, odds in slot_tables(parts).collect():  # PREDICTORS x 2 MB
        tables[i, b << BLOCK_BITS: (b + 1) << BLOCK_BITS] = np.frombuffer(odds, np.int8)
    shared = spark.sparkContext.broadcast((codes, tables, keys[order], top_counts, n_texts))
    return Model(words.where(F.col("n") < least), (total[1] or 0) + n_texts, total[0] + bool(n_texts), shared)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with n_tokens, n_known, base_score, score (log10) and bits_per_byte."""
    new = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "bits_per_byte": "double"}
    keep = [c for c in docs.columns if c not in new and c != text_col]
    row, rare, times = (free_name(keep, x) for x in ("_row", "_rare", "_times"))
    shared, scale = model.shared, model.tokens + model.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables, keys, counts, n_texts = shared.value
        for batch in batches:
            for lo, hi, off, data in utf8_slices(batch.column(text_col), SLICE_BYTES):
                n = hi - lo
                words, own = word_hashes(off, data)
                h, inverse = np.unique(words.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                c = np.where(keys[at] == h, counts[at], 0) if len(keys) else np.zeros(len(h), np.int64)
                each = c[inverse]
                known = np.bincount(own, weights=each > 0, minlength=n).astype(np.int64) + (n_texts > 0)
                logs = np.log10((c + 1) / scale)
                base = np.bincount(own, weights=np.where(each > 0, logs[inverse], 0), minlength=n) + np.log10((n_texts + 1) / scale)
                bits = text_bits(codes, tables, off, data)
                size = np.maximum(1, np.diff(off))
                # words that aren't among the top ones: distinct for each text, with their number
                left = np.flatnonzero(each == 0)
                pair, number = np.unique(own[left] * np.int64(len(h)) + inverse[left], return_counts=True)
                ends = np.searchsorted(pair, np.arange(n + 1) * np.int64(len(h))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (h[pair % max(1, len(h))], number.astype(np.int64))]
                tokens = np.bincount(own, minlength=n) + 1
                made = [pa.array(v) for v in (tokens, known, base, -bits * np.log10(2), bits / size)]
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made, *lists], names=[*keep, *new, rare, times])
        release_memory()

    given = docs.select(*keep, text_col)
    kinds = {**new, rare: "array<long>", times: "array<long>"}
    schema = given.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema
    scored = written(given.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "lm-scored")
    pairs = scored.select(row, F.explode(F.arrays_zip(F.col(rare).alias("key"), F.col(times).alias("times"))).alias("w")).select(row, "w.key", "w.times")
    seen = F.coalesce("n", F.lit(0))
    found = pairs.join(model.words, "key", "left").groupBy(row).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(scale)))).alias("_base")
    )
    both = scored.drop(rare, times).join(found.withColumnsRenamed({"_known": rare, "_base": times}), row, "left")
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return both.select(*keep, "n_tokens", add("n_known", rare), add("base_score", times), "score", "bits_per_byte")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(in_training(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "bits_per_byte",
    )
