import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tunemill.llm import quality

SCHEMA = "doc_id long, text string, score double, label int"


def rows_of(n=700):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 90))) + "."
    bad = lambda: rng.choice(["BUY!! NOW!! ", "a | b | ", "same same ", "x9$$ q#1 "]) * rng.randrange(10, 60)
    return [(i, good() if i % 5 else bad(), int(i % 5 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = rows_of()
    df = spark.createDataFrame([(i, t, 0.0, 7) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q, "clash") for i, _, q in rows if i % 2] + [(None, 1, ""), (3, None, "")], "doc_id long, quality int, text string")
    got = quality.score_quality(df, labels).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = rows_of(300)
    df = spark.createDataFrame([(i, t, 0.0, 7) for i, t, _ in rows], SCHEMA)
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q
    a, b = (spark.createDataFrame([(i, f(i, q)) for i, _, q in rows], "doc_id long, quality int") for f in (lambda i, q: q, flip))
    first, second = ({r.doc_id: r.score for r in quality.score_quality(df, x).collect()} for x in (a, b))
    assert first == second


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0.0, 1), (None, "", 0.0, 1), (2, "w " * 50_000, 0.0, 1), (2, "again", 0.0, 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(df, labels).collect()] == [0.5] * 4
    assert quality.score_quality(df.limit(0), labels).collect() == []
    assert quality.keep_good(df, labels).columns == df.columns


def test_risk_is_not_negative():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.NAMES))).astype(np.float32)
    model = quality.fit_nnpu(x[:200] + 1, np.concatenate([x[200:300] + 1, x[300:] - 1]), 0.5)
    assert (model.score(x[:200] + 1) > 0.5).mean() > 0.9 and (model.score(x[300:] - 1) < 0.5).mean() > 0.9


def test_labels_without_documents_and_repeated_rows_change_nothing(spark, monkeypatch):
    rows = rows_of(300)
    df = spark.createDataFrame([(i, t, 0.0, 7) for i, t, _ in rows], SCHEMA)
    own = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    foreign = spark.range(10_000, 14_000).select("id", F.lit(0).alias("quality"))
    first, second = ({r.doc_id: r.score for r in quality.score_quality(df, x).collect()} for x in (own, own.union(foreign)))
    assert first == second
    monkeypatch.setattr(quality, "SAMPLE", 50)
    table = spark.createDataFrame([(1, [float(i)] * len(quality.NAMES)) for i in range(400)], "doc_id long, x array<float>")
    assert len(quality._sample(table, 10)) <= 100 and 10 < len(quality._sample(table, 400)) <= 100


def test_features_and_scores_against_plain_loops():
    text = "A cat, a cat.\nTHE dog! THE dog!\nA cat, a cat.\n"
    got = dict(zip(quality.NAMES, quality.features(text), strict=True))
    data, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
    shares = [data.count(b) / len(data) for b in set(data)]
    want = {
        "upper": sum(c.isupper() for c in text) / len(data), "stop": sum(c in ".,;:?" for c in text) / len(data), "entropy": -sum(p * np.log2(p) for p in shares), "word_bytes": np.mean([len(w) for w in words]),
        "types": len(set(words)) / len(words), "pair_types": len(set(zip(words, words[1:], strict=False))) / (len(words) - 1), "line_types": len(set(lines)) / len(lines), "top_line": 2 / 3,
        "starts_upper": sum(w[0].isupper() for w in words) / len(words), "all_upper": sum(w.isupper() for w in words) / len(words),
    }
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, len(quality.NAMES))).astype(np.float32)
    model = quality.fit_nnpu(x[:30] + 1, x, 0.4, rounds=40)
    for row, score in zip(x, model.score(x), strict=True):
        z = model.bias + sum(model.weights[f][sum(edge <= row[f] for edge in model.edges[f])] for f in range(len(row)))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9

    def risk(m, prior=0.4):
        zp, zu = m.logit(m.binned(x[:30] + 3)), m.logit(m.binned(x))
        negative = np.mean([np.log1p(np.exp(z)) for z in zu]) - prior * np.mean([np.log1p(np.exp(z)) for z in zp])
        return prior * np.mean([np.log1p(np.exp(-z)) for z in zp]) + max(0.0, negative)

    apart = quality.fit_nnpu(x[:30] + 3, np.concatenate([x[:20] + 3, x[20:50]]), 0.4, rounds=20, step=0.02)
    start = quality.Model(apart.edges, np.zeros_like(apart.weights), float(np.log(0.4 / 0.6)), 0.4)
    assert risk(apart) < risk(start)


def test_the_bound_of_the_sample_holds_at_any_number_of_rows():
    assert quality._share(10) == quality._share(quality.SAMPLE) == 1 << 60
    for n in (10**6, 3 * 10**10, 10**13, 10**15):
        assert abs(quality._share(n) / 2**60 * n - quality.SAMPLE) < 0.01 * quality.SAMPLE
