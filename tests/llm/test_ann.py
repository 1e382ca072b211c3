import math
import random

import numpy as np

from tunemill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, k, query):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if query(i):
            s = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in fine if j != i)[:k]
            out[i] = [j for _, j in s]
    return out


def rows_of(n=600):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(300)]
    rows += [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] + [1.0] * 15), (2030, [None] + [1.0] * 15), (2040, [1.0] * 3), (None, same)]
    random.Random(1).shuffle(rows)
    return rows


def test_small_table_is_exact(spark):
    rows = rows_of()
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    want = brute(rows, 5, lambda i: i % 10 == 0)
    got = {}
    for r in ann.nearest(df, lambda c: c % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 200] + 0.1 * rng.standard_normal(16)]) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    want = brute(rows, 5, lambda i: i % 50 == 0)
    got = ann.nearest(df, lambda c: c % 50 == 0, block=64).collect()
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * 5 * len(want)


def test_recall_holds_as_rows_outgrow_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "MOST_BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    want = brute(rows, 5, lambda i: i % 50 == 0)
    got = ann.nearest(df, lambda c: c % 50 == 0).collect()
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * 5 * len(want)


def test_groups_of_blocks_find_what_blocks_find(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "MOST_BLOCK", 16)
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows_of(1500)], SCHEMA)
    assert ann.window(1200)[1] // 2 > 1
    answers = []
    for together in (1, 2, 16):
        monkeypatch.setattr(ann, "GROUP", together)
        answers.append(sorted(map(tuple, ann.nearest(df, lambda c: c % 20 == 0).collect())))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 300


def test_window_is_a_share_of_the_rows():
    for n in (1, 10_000, 200_000, 3_000_000, 10**9):
        block, reach = ann.window(n)
        assert ann.BLOCK <= block <= ann.MOST_BLOCK and (2 * reach + 1) * block >= ann.WINDOW * n


def test_ties_at_the_cut_off(spark):
    rows = [(0, [1.0, 1.0] + [0.0] * 14)] + [(1000 - i, [2.0**i if i % 2 else 0.0, 0.0 if i % 2 else 2.0**i] + [0.0] * 14) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    got = ann.nearest(df, lambda c: c == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [961, 962, 963, 964, 965]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (1, [2.0, 0.0], 0.0), (50, [0.0, 1.0], 0.0)], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, lambda c: c % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert ann.nearest(df.limit(0), lambda c: c % 50 == 0).collect() == []
