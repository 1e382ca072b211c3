import hashlib
import re

import numpy as np
import pytest

from tunemill.operators import embedding


def plain(text, size=64, key="features"):
    out = [0.0] * size
    tokens = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\v]", text or "")
    for token in set(tokens):
        h = int(hashlib.md5(f"{key}:{token}".encode()).hexdigest()[:8], 16)
        out[h // 2 % size] += (1 if h % 2 else -1) * tokens.count(token) ** 0.5
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm if norm else 0.0 for x in out]


TEXTS = [(1, "the cat, the dog"), (2, None), (3, ""), (4, "été 日本 é"), (1, "again"), (None, "no id"), (5, "long text " * 50_000), (6, "x" * 300)]


@pytest.mark.parametrize("batch,chars,buffer", [(256, 1 << 20, 1 << 23), (1, 1, 1), (3, 40, 100)])
def test_vectors_against_a_plain_count(spark, monkeypatch, batch, chars, buffer):
    for name, n in (("BATCH", batch), ("BATCH_CHARS", chars), ("BUFFER_CHARS", buffer)):
        monkeypatch.setattr(embedding, name, n)
    df = spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, embedding string").repartition(2)
    got = sorted(((r.doc_id, np.round(r.embedding, 9).tolist()) for r in embedding.embed(df).collect()), key=str)
    assert got == sorted(((i, np.round(plain(t), 9).tolist()) for i, t in TEXTS), key=str)


def test_own_encoder_and_cut(spark):
    def load():
        class Lengths:
            def encode(self, texts):
                return np.array([[len(t), 1.0] for t in texts])

        return Lengths()

    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = [r.embedding[0] for r in embedding.embed(df, load, most_chars=7).collect()]
    assert got == [min(len(t or ""), 7) for _, t in TEXTS]


def test_order_of_texts(spark):
    groups = [["red apple pie", "red apple tart", "red apple cake"], ["deep sea fish", "deep sea crab", "deep sea squid"], ["old stone wall", "old stone gate", "old stone arch"]]
    rows = [(k * 3 + i, groups[i][k]) for i in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.doc_id % 3 for r in embedding.text_order(df, low=0.2, high=0.99).orderBy("chunk", "place").collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 5
    assert embedding.text_order(df.limit(0)).collect() == []
