import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill.llm import lm

SCHEMA = "doc_id long, text string, score double"
HELD = lambda name: F.crc32(name) % 7 == 2


def rows_of(n=150):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["The", "THE", "É", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (None, "w1 w2"), (5, rows[5][1]), (1002, "w1\tw2\x0bw3 x " * 3000)]


def brute(rows, order, mu):
    docs = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        docs.append((zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, words))
    grams = [Counter() for _ in range(order + 1)]
    starts = sum(not h for h, _ in docs)
    for held, words in docs:
        if not held:
            seq = ["<s>"] * (order - 1) + words + ["</s>"]
            for k in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    grams[n][tuple(seq[k - n + 1 : k + 1])] += 1
    total, seen = sum(grams[1].values()), len(grams[1])

    def p(seq, k, n):
        if n == 1:
            c = grams[1][tuple(seq[k : k + 1])]
            return max(c - 0.75, 0) / total + 0.75 * seen / total / (seen + 1)
        state = starts if all(x == "<s>" for x in seq[k - n + 1 : k]) else grams[n - 1][tuple(seq[k - n + 1 : k])]
        return (grams[n][tuple(seq[k - n + 1 : k + 1])] + mu[n] * p(seq, k, n - 1)) / (state + mu[n])

    out = []
    for held, words in docs:
        seq = ["<s>"] * (order - 1) + words + ["</s>"]
        at = range(order - 1, len(seq))
        base = sum(math.log10((grams[1][tuple(seq[k : k + 1])] + 1) / (total + seen + 1)) for k in at)
        known = sum(tuple(seq[k : k + 1]) in grams[1] for k in at)
        out.append((held, len(words) + 1, known, total, round(base, 6), round(sum(math.log10(p(seq, k, order)) for k in at), 6)))
    return out


@pytest.mark.parametrize("order,block", [(1, 900), (2, 500), (3, 1 << 22), (3, 2000), (4, 1500)])
def test_against_brute_force(spark, order, block):
    rows, mu = rows_of(), (None, None, 8.0, 3.0, 3.0)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], SCHEMA)
    got = lm.score_texts(df, HELD, order=order, mu=mu[:4], block_bytes=block).collect()
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute(rows, order, mu), strict=True)), key=lambda x: (str(x[0]), x[2], x[5]))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: (str(x[0]), x[2], x[5]))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-4)


def test_probabilities_sum_to_one():
    """Of the last backoff; a state's arcs and failure weight keep the sum by construction."""
    counts = np.array([1, 1, 2, 5, 40])
    total = lm.unigram(counts, int(counts.sum()), len(counts)).sum() + lm.unigram(np.array([0]), int(counts.sum()), len(counts)).sum()
    assert abs(total - 1) < 1e-12


def test_held_out_beats_the_base_on_repetitive_text(spark):
    rng = random.Random(1)
    chain = {w: rng.sample([f"w{i}" for i in range(200)], 3) for w in (f"w{i}" for i in range(200))}

    def text():
        w, out = "w0", []
        for _ in range(80):
            w = rng.choice(chain[w])
            out.append(w)
        return " ".join(out)

    df = spark.createDataFrame([(i, text(), 0.0) for i in range(400)], SCHEMA)
    got = lm.score_texts(df, HELD, mu=(None, None, 8.0)).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), HELD).collect() == []
    one = lm.score_texts(spark.createDataFrame([(16, "a b", 0.0)], SCHEMA), lambda n: F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0)


def test_sorted_hashes_are_sent_whole():
    rng = np.random.default_rng(3)
    for n, bits in ((1, 44), (7, 20), (5000, 44), (5000, 24), (300, 62)):
        v = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        for low in (3, 6):
            if bits - 8 * low < 20:
                assert (lm._decoded(lm._encoded(v, low), low) == v).all()
    for total in (0, 1, 1 << 20, 1 << 30, 1 << 47):
        bits, low = lm._bits(total, lm.BLOCK_BYTES)
        assert min(64, total.bit_length() + lm.SPARE_BITS) <= bits <= 64 and low <= 8


def test_the_start_is_a_state_that_training_texts_pass(spark):
    texts = [(i, "a b", 0.0) for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2] + [(100 + i, t, 0.0) for i, t in enumerate(["a b", "b a"])]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(texts, SCHEMA), lambda n: n.cast("long") >= 100, mu=(None, None, 1.0)).collect()}
    assert got[100] > -0.2 and got[101] < got[100] - 2


def test_counts_beyond_32_bits():
    big = np.array([2**33 + 5, 7, 0], np.uint64)
    assert lm._unpacked(lm._packed(big)).tolist() == big.tolist() and lm._unpacked(lm._packed(big[:0])).tolist() == []
    got = lm._summed([np.array([1, 5, 9], np.uint64), np.array([5], np.uint64)], [big, np.array([2**33], np.uint64)])
    assert [x.tolist() for x in got] == [[2**33 + 5, 2**33 + 7, 0], [2**33 + 7]]
    with pytest.raises(OverflowError):
        lm._summed([np.array([1], np.uint64)] * 2, [np.array([2**62 + 1], np.uint64)] * 2)
