import math
import os
import random

import numpy as np
import pytest

from tunemill.operators import sequence

MADE = "/tmp/tunemill-test-loads"


def recurrent():
    """A model whose class goes to the workers by value, as they cannot import this file."""

    class Recurrent:
        """Each probability depends on all tokens before; padding is seen, if a batch has any."""

        def encode(self, text):
            return np.array([ord(c) % 50 for c in text], np.int64)

        def nll(self, ids, lengths):
            state, out = np.zeros(len(ids)), np.zeros((len(ids), ids.shape[1] - 1))
            for t in range(ids.shape[1] - 1):
                state = np.tanh(0.7 * state + 0.01 * ids[:, t])
                out[:, t] = 1.0 + state * ids[:, t + 1] / 50
            return out

    return Recurrent


LOAD = recurrent()


def brute(text):
    ids = [ord(c) % 50 for c in text or ""]
    if len(ids) < 2:
        return 0, None, None, 0, math.inf, math.inf
    state, nll = 0.0, []
    for a, b in zip(ids, ids[1:]):
        state = float(np.tanh(0.7 * state + 0.01 * a))
        nll.append(1.0 + state * b / 50)
    start = int(len(ids) * 0.4)
    own = nll[max(0, start - 1) :]
    mean, response = sum(nll) / len(nll), sum(own) / len(own)
    return len(ids), round(mean, 4), round(response, 4), len(own), round(math.exp(min(mean, 20)), 2), round(math.exp(min(response, 20)), 2)


def texts():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdeé😀 \n") for _ in range(rng.choice([0, 1, 2, 3, 7, 40, 200])))) for i in range(300)]
    return [*rows, (1000, None), (1001, ""), (1002, "x"), (7, rows[7][1]), (None, "no id"), (1003, "long " * 20_000)]


@pytest.mark.parametrize("batch,tokens,buffer,parts", [(64, 65_536, 1 << 20, 2), (1, 10, 1 << 20, 3), (4, 100, 500, 5), (1000, 1 << 30, 1 << 30, 1)])
def test_padding_and_bounds_change_no_score(spark, batch, tokens, buffer, parts):
    df = spark.createDataFrame([(*r, "clash") for r in texts()], "doc_id long, text string, length string").repartition(parts)
    got = sequence.score_sequences(df, LOAD, batch_size=batch, batch_tokens=tokens, buffer_tokens=buffer).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t in texts()), key=str)


def test_batches_stay_within_their_bounds():
    lengths = np.array([10, 10, 20, 50, 100, 100, 400, 900, 2, 2, 2])
    found = list(sequence.batches_by_length(lengths, 4, 300))
    assert sorted(np.concatenate(found).tolist()) == list(range(len(lengths)))
    assert all(len(b) <= 4 and (len(b) * lengths[b].max() <= 300 or len(b) == 1) for b in found)
    assert list(sequence.batches_by_length(np.array([], int), 4, 300)) == []


def test_spans_say_what_the_response_is(spark):
    df = spark.createDataFrame([(1, "abcdef", [(1, 3), (5, 6)]), (2, "abcdef", []), (3, "abcdef", None), (4, "abcdef", [(0, 1)])], "doc_id long, text string, spans array<struct<start:int,stop:int>>")
    got = {r.sample: r for r in sequence.score_sequences(df, LOAD, spans_col="spans").collect()}
    assert [got[i].response_token_count for i in (1, 2, 3, 4)] == [3, 0, 4, 0]
    assert got[2].response_nll == got[2].avg_nll == got[4].response_nll


def test_a_model_is_loaded_once_in_a_worker(spark):
    made = recurrent()

    def load():
        with open(f"{MADE}-{os.getpid()}", "a") as f:
            f.write("x")
        return made()

    df = spark.range(4000).selectExpr("id doc_id", "'some text' text").repartition(40)
    before = {f: os.path.getsize(f"/tmp/{f}") for f in os.listdir("/tmp") if f.startswith("tunemill-test-loads-")}
    assert sequence.score_sequences(df, load).count() == 4000 and sequence.score_sequences(df, LOAD).selectExpr("sum(length)").first()[0] == 36_000
    sequence.score_sequences(df, load).selectExpr("sum(length)").collect()
    after = {f: os.path.getsize(f"/tmp/{f}") for f in os.listdir("/tmp") if f.startswith("tunemill-test-loads-")}
    grown = sum(after.values()) - sum(before.values())
    assert 1 <= grown <= 2 * len(after) < 40  # once in each worker, and once more after another model


def test_class_bigrams_against_a_plain_count(spark):
    docs = [(1, "the cat, the dog."), (2, "the cat"), (3, None), (4, "a"), (5, "été the cat"), (5, "the cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    load = sequence.class_bigrams(df)
    pairs, firsts = {}, {}
    lists = [[sequence.token_class(t) for t in sequence._token.findall(text or "")] for _, text in docs]
    for c in lists:
        for a, b in zip(c, c[1:]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            firsts[a] = firsts.get(a, 0) + 1
    got = sorted((r.sample, r.avg_nll) for r in sequence.score_sequences(df, load).collect() if r.avg_nll)
    nll = lambda a, b: -math.log((pairs.get((a, b), 0) + 1) / (firsts.get(a, 0) + sequence.CLASSES))
    assert got == sorted((i, round(sum(nll(a, b) for a, b in zip(c, c[1:])) / (len(c) - 1), 4)) for (i, _), c in zip(docs, lists) if len(c) > 1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert sequence.score_sequences(df, sequence.class_bigrams(df)).collect() == []
