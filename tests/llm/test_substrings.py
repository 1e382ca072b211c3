import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill.llm import substrings

SCHEMA = "doc_id long, text string, n_bytes int, block int"


def ties(df):
    """The hash of each row, by id and text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return {(r.doc_id, bytes(r.t)): r.tie for r in df.select("doc_id", text.alias("t"), F.xxhash64("doc_id", text).alias("tie")).collect()}


def brute(rows, tie):
    """Rows in order of id (null last), equal ids in order of their hash, then of text."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, tie[rows[k][0], (rows[k][1] or "").encode()], (rows[k][1] or "").encode()))
    seen, out = set(), [None] * len(rows)
    for k in order:
        d = (rows[k][1] or "").encode()
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 99):
            if d[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(d[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (rows[k][0], len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, text(rng.randrange(60)) + rng.choice([*shared, ""])[rng.randrange(40) :] + text(rng.randrange(60))) for i in range(80)]
    rows += [(100 + i, shared[0]) for i in range(6)]
    rows += [(200, "ab" * 500), (201, "a" * 99), (202, "a" * 100), (203, "a" * 350), (204, "line of text that comes again and again\n" * 30), (205, None), (206, ""), (207, "x" * 60_000 + shared[1])]
    return rows + [(3, rows[3][1]), (None, shared[2]), (None, shared[2]), (5, "other " * 40)]


@pytest.mark.parametrize("block,hot,share", [(1 << 22, 16384, 256), (3000, 2, 256), (3000, 2, 7)])
def test_against_brute_force(spark, monkeypatch, block, hot, share):
    monkeypatch.setattr(substrings, "PART_BLOCKS", share)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4 * block)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = rows_of()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    got = substrings.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, ties(df))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("length", [3, 20, 100])
def test_expansion_finds_common_prefixes(length):
    rng = np.random.default_rng(length)
    base = [bytes(rng.integers(97, 99, rng.integers(length, 168))) for _ in range(4)]
    parts = sorted({*base, *(base[0][:i] + base[1][i:] for i in range(0, min(len(base[0]), len(base[1])), 9))})
    parts = [p for p in parts if len(p) >= length]
    doc, row, at = np.arange(len(parts)), np.zeros(len(parts), int), rng.integers(0, 50, len(parts))
    seen = {}
    for d, p in enumerate(parts):
        for o in range(len(p) - length + 1):
            seen.setdefault(p[o : o + length], []).append((doc[d], at[d] + o, d, o))
    want = {(d, o) for v in seen.values() for _, _, d, o in sorted(v)[1:]}
    got = substrings.repeats(parts, doc, row, at, length)
    assert {(int(d), o) for d, s, e in got for o in range(s, e - length + 1)} == want


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("hot,share", [(16384, 256), (2, 7)])
def test_rows_of_one_id_are_spread(spark, monkeypatch, hot, share):
    """Half of all rows have a null id, a quarter one id: they stand in many blocks, and the result is that of brute force."""
    monkeypatch.setattr(substrings, "PART_BLOCKS", share)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 8000)
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(4)
    passage = ["".join(rng.choice("abcde ") for _ in range(160)) for _ in range(3)]
    rows = [(None if i % 2 else 7 if i % 4 == 0 else i, f"{rng.random()} {rng.choice(passage)} {rng.random()} {rng.choice(passage)}"[rng.randrange(30) :]) for i in range(120)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    seen = []
    monkeypatch.setattr(substrings.F, "expr", lambda e, plain=F.expr: seen.append(e) or plain(e))
    got = substrings.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, ties(df))
    block = next(e for e in seen if "tie" in e)
    spread = df.withColumn("tie", F.xxhash64("doc_id", F.col("text").cast("binary"))).selectExpr("doc_id", f"{block} AS b").groupBy("doc_id").agg(F.countDistinct("b").alias("n"), F.min("b").alias("least"))
    assert {r.doc_id: r.n for r in spread.collect()}[None] > 10 and all(r.least >= 0 for r in spread.collect())
