"""Language-model scoring against the model written out byte by byte."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def rows(spark):
    own = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "Ünï", "x" * 90]) for _ in range(60_000))
    return own + [(9000, None), (9000, None), (9001, ""), (9002, " \t\n "), (9003, "one"), (9003, "one"), (None, "no id"), (9004, long), (9005, "\x00\x1c é  É　日本"), (9006, "y" * 50_000)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lm"))
    spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, score int, _row string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def test_counts_and_base(spark, folder, rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = Counter()
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in own), len(train)])
        want[i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own) + 1, sum(w in count for w in own) + 1, n, round(base, 5)] += 1
    got = lm.op13_lm_scoring(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    # few top words: the others meet their counts in the join
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few = lm.score(docs, lm.learn(docs.where(lm.in_training(docs.doc_id)), top_words=50))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in few.collect()) == Counter({(k[0], k[2], k[3], k[5]): 0 for k in want}) + Counter(
        (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got
    )
    assert {r["_row"] for r in few.collect()} == {"clash"} and "score" in few.columns
    same = [r.score for r in got if r.doc_id == 9003]
    assert len(same) == 2 and same[0] == same[1]


def slow_bits(codes, tables, text):
    """The model one choice at a time, over bytes joined as the contract's words are."""
    seq = [lm.END] * lm.REACH + list(" ".join(words(text)).encode()) + [lm.END]
    u32 = lambda x: x & 0xFFFFFFFF
    fold = lambda x: u32(x * 0x9E3779B1) >> (32 - lm.SLOT_BITS)
    total, wide = 0.0, 8 * (1 - 1e-6)
    for at in range(lm.REACH, len(seq)):
        if (at - lm.REACH) % lm.LANE == 0:
            weights, delta = [[0.3] * 3 for _ in range(4)], [[0.0] * 3 for _ in range(4)]
            refine, change, done = [1 / (1 + math.exp(-(k - 11.5) * 16 / 24)) for k in range(24)], [0.0] * 24, 0
        four = u32(seq[at - 1] | seq[at - 2] << 8 | seq[at - 3] << 16 | seq[at - 4] << 24)
        word, k = 0, at
        while seq[k - 1] not in (0x20, lm.END):
            k -= 1
        for j, x in enumerate(seq[k:at]):
            word = (word + (x + 1) * pow(lm._UP, j, 1 << 64)) % (1 << 64)
        word = (word * 0xD6E8FEB86659FD93 % (1 << 64)) >> 32
        slots = [fold(u32(four * 0x2545F491 + 1)), fold(word)]
        tree = codes.tree[seq[at - 2] << 8 | seq[at - 1]]
        start, n = int(codes.start[tree, seq[at]]), int(codes.length[tree, seq[at]])
        for c, odds in zip(codes.choice[start: start + n].tolist(), codes.odds[start: start + n].tolist(), strict=True):
            x = [odds / 12, *(int(tables[i][s ^ (c >> 1)]) / 12 for i, s in enumerate(slots))]
            y, gate = c & 1, sum(v != 0 for v in x)
            z = max(-wide, min(wide, sum(p * q for p, q in zip(weights[gate], x, strict=True))))
            p, cell = 1 / (1 + math.exp(-z)), math.floor(z * 1.5) + 12
            total -= math.log2(abs((p + refine[cell]) / 2 - (1 - y)))
            change[cell] += (y - refine[cell]) * 0.02
            for i in range(3):
                delta[gate][i] += (y - p) * 0.01 * x[i]
            done += 1
            if done % lm.ROUND == 0:
                refine, change = [a + b for a, b in zip(refine, change, strict=True)], [0.0] * 24
                weights = [[a + b for a, b in zip(u, v, strict=True)] for u, v in zip(weights, delta, strict=True)]
                delta = [[0.0] * 3 for _ in range(4)]
    return total


def arrow_slice(texts):
    data = [(t or "").encode() for t in texts]
    return np.cumsum([0, *map(len, data)]), np.frombuffer(b"".join(data), np.uint8)


def test_mixing_against_one_choice_at_a_time(monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 700))) for _ in range(9)] + ["", None, "  A  b ", "zzz\t\tzzz", "w" * 3000]
    counts = [np.zeros((1 << lm.SLOT_BITS, 2)) for _ in range(lm.PREDICTORS)]
    off, data = arrow_slice(texts[:6])
    seq, starts = lm.spelled(off, data)
    wide = seq.astype(np.int64)
    monkeypatch.setattr(lm, "OWN_TREES", 9)  # the other pairs share trees
    codes = lm.Codes(*np.unique(wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:], return_counts=True))
    lo, size, _ = lm._lanes(starts, len(seq))
    slots, bit, *_ = lm._coded(codes, seq, lo, size)
    for have, s in zip(counts, slots, strict=True):
        np.add.at(have, (s, bit), 1)
    tables = np.stack([lm.log_odds(c[:, 0], c[:, 1]) for c in counts])
    want = [slow_bits(codes, tables, t) for t in texts]
    for group in (lm.GROUP_BYTES, 1500):  # however the lanes are grouped, and whatever other texts are there
        monkeypatch.setattr(lm, "GROUP_BYTES", group)
        assert np.allclose(lm.text_bits(codes, tables, *arrow_slice(texts)), want, rtol=1e-3)
        assert np.allclose([lm.text_bits(codes, tables, *arrow_slice([t]))[0] for t in texts], want, rtol=1e-3)


def test_every_byte_has_a_code():
    for codes in (lm.Codes(np.zeros(0, np.int64), np.zeros(0, np.int64)), lm.Codes(np.array([0x616263]), np.array([10**12]))):
        assert np.allclose((0.5 ** codes.length.astype(float)).sum(axis=1), 1)


def test_a_learned_text_is_likelier(spark):
    text = "the quick brown fox jumps over the lazy dog " * 30
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    other = spark.createDataFrame([(2, text[:200]), (3, "vz qkx wjq pff zzt " * 10)], "doc_id long, text string")
    bits = {r.doc_id: r.bits_per_byte for r in lm.score(other, lm.learn(docs)).collect()}
    assert bits[2] < 2 < bits[3]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    got = lm.score(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"), lm.learn(none)).collect()
    assert all(r.base_score == 0 and r.score < 0 and r.n_known == 0 for r in got)
    assert lm.score(none, lm.learn(none)).collect() == []


def test_lanes_mix_alone_and_slots_are_counted_as_they_come(spark):
    """Lanes that end within a round cost what they cost alone; a task's slot counts are those of its choices."""
    rng = np.random.default_rng(4)
    count = np.array([70, 1, 32, 64, 33, 200, 31])
    x = rng.integers(-50, 50, (int(count.sum()), 4)).astype(np.int8)
    x[::3, 1] = 0
    x[:, 3] = 2 * (x[:, :3] != 0).sum(axis=1) + rng.integers(0, 2, len(x))
    first = np.cumsum(count) - count
    alone = [lm.mixed_bits(x[a: a + n], np.array([0]), np.array([n]))[0] for a, n in zip(first, count, strict=True)]
    assert np.allclose(lm.mixed_bits(x, first, count), alone, rtol=1e-6)
    texts = ["one two  three", None, "", "two two " * 300]
    seq, starts = lm.spelled(*arrow_slice(texts))
    lo, size, _ = lm._lanes(starts, len(seq))
    codes = lm.Codes(np.array([0x206F6E, 0x74776F]), np.array([5, 9]))
    want = [np.zeros((1 << lm.SLOT_BITS, 2), np.int64) for _ in range(lm.PREDICTORS)]
    slots, bit, *_ = lm._coded(codes, seq, lo, size)
    for have, s in zip(want, slots, strict=True):
        np.add.at(have, (s, bit), 1)
    got = [np.zeros_like(w) for w in want]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for r in lm.slot_counts(docs, "text", spark.sparkContext.broadcast(codes)).collect():
        at = (r.block << lm.BLOCK_BITS) + np.frombuffer(r.slots, np.uint16).astype(np.int64)
        for k, raw in enumerate((r.zeros, r.ones)):
            got[r.predictor][at, k] += np.frombuffer(raw, np.uint16)
    assert all((g == w).all() for g, w in zip(got, want, strict=True))
