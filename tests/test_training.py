import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunemill.operators import interleave, losses, ordering, packing

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def seqs(spark, lists):
    return spark.createDataFrame([(i, len(x), x) for i, x in enumerate(lists)], "seq_id long, length long, input_ids array<long>")


def packed(spark, lists, block, **k):
    pack = packing.pack_sorted if k.pop("ordered", False) else packing.pack_sequential
    rows = packing.blocks(pack(seqs(spark, lists), block, **k), "input_ids").orderBy("block").collect()
    return [list(r.input_ids) for r in rows], [list(r.position_ids) for r in rows]


def test_packing_literals(spark):
    assert packed(spark, [[1, 2], [3, 4], [5, 6]], 4, ordered=True)[0] == [[1, 2, 3, 4], [5, 6]]
    assert packed(spark, [[1, 2, 3], [4, 5]], 64, ordered=True)[1] == [[0, 1, 0, 1, 2]]
    assert packed(spark, [[1, 2, 3], [4, 5]], 64)[0] == [[1, 2, 3, 4, 5]]
    assert packed(spark, [], 8)[0] == []
    assert [len(b) for b in packed(spark, [[i, i] for i in range(10)], 4, ordered=True, buffer=3)[0]] == [4] * 5
    assert packed(spark, [[7] * 10, [8] * 12, [9] * 10], 32)[1][0][10:12] == [0, 1]


@FEW
@given(st.lists(st.lists(st.integers(0, 99), max_size=12), max_size=12), st.integers(1, 9))
def test_packing_keeps_every_token(spark, lists, block):
    got, positions = packed(spark, lists, block)
    assert [x for b in got for x in b] == [x for s in lists for x in s]
    assert all(len(b) == block for b in got[:-1]) and [len(b) for b in got] == [len(p) for p in positions]


def test_shift_labels(spark):
    df = spark.createDataFrame([([10, 11, 12, 13], None), ([5, -100, -100, 8, 9], None), ([1, 2, 3, 4, 5, 6], [0, 1, 2, 0, 1, 2]), ([], None)], "l array<long>, p array<long>")
    assert df.select(packing.shift_labels(F.col("l"))).collect()[0][0] == [11, 12, 13, -100]
    assert df.select(packing.shift_labels(F.col("l"))).collect()[1][0] == [-100, -100, 8, 9, -100]
    assert df.filter("p is not null").select(packing.shift_labels(F.col("l"), F.col("p"))).first()[0] == [2, 3, -100, 5, 6, -100]
    assert df.select(packing.shift_labels(F.col("l"))).collect()[3][0] == []


def lengths(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seq_id long, length long")


def test_length_groups(spark):
    rows = packing.length_groups(lengths(spark, [1, 100, 2, 99, 3, 98, 4, 97]), 4, 8).collect()
    assert {frozenset(r.length for r in rows if r.batch_no == b) for b in (0, 1)} == {frozenset({1, 2, 3, 4}), frozenset({97, 98, 99, 100})}
    rows = packing.length_groups(lengths(spark, range(10)), 4, 16).collect()
    assert {r.turn for r in rows if r["rows"] == 2} == {2}


def test_greedy_batches(spark):
    rows = packing.greedy_batches(lengths(spark, [10, 10, 20, 50, 100, 100, 400, 900]), 4, 300).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r.length)
    assert sorted(x for b in batches.values() for x in b) == [10, 10, 20, 50, 100, 100, 400, 900] and [900] in batches.values()
    assert all(len(b) <= 4 and (len(b) == 1 or len(b) * max(b) <= 300) for b in batches.values())


def test_collate_and_shards(spark):
    df = seqs(spark, [[1] * 5, [2] * 7]).withColumn("labels", F.col("input_ids"))
    for multiple, width in ((64, 64), (1, 7)):
        out = packing.collate(df.withColumn("b", F.lit(1)), ["b"], multiple).orderBy("seq_id").collect()
        assert [len(r.input_ids) for r in out] == [width] * 2 and out[0].labels[5:] == [-100] * (width - 5)
    assert df.select(packing.sequence_shards(F.array(*map(F.lit, range(6))), 3)).first()[0] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(Exception, match="divisible"):
        df.select(packing.sequence_shards(F.array(*map(F.lit, range(5))), 3)).collect()


def test_total_steps(spark):
    rows = spark.range(363).withColumn("rank", F.lit(0))
    assert [packing.total_steps(rows, a, e).first()[0] for a, e in ((1, 1), (8, 1), (1, 3))] == [363, 45, 1089]
    with pytest.raises(Exception, match="fewer than one"):
        packing.total_steps(rows, 400, 1).collect()


def mixed(spark, counts, weights):
    rows = [(s, i) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long")
    return interleave.interleave(df, weights).orderBy("place").collect()


def test_interleave(spark):
    assert len(mixed(spark, {"a": 5}, {"a": 0.5, "empty": 0.5})) == 5
    assert 1 <= len(mixed(spark, {"a": 3, "b": 3}, {"a": 0.5, "b": 0.5})) <= 6
    assert mixed(spark, {}, {"a": 1.0}) == []


@FEW
@given(st.integers(1, 60), st.integers(1, 60), st.floats(0.1, 0.9))
def test_interleave_keeps_proportions_until_one_ends(spark, a, b, w):
    got = [r.source for r in mixed(spark, {"a": a, "b": b}, {"a": w, "b": 1 - w})]
    assert got.count("a") == a or got.count("b") == b
    for n in range(1, len(got) + 1):
        assert abs(got[:n].count("a") - w * n) <= 1.5


def test_tour_is_a_permutation_and_repeats(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((3, 16))
    rows = [(i, [float(x) for x in centres[i % 3] + 0.05 * rng.standard_normal(16)]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (ordering.similarity_order(df, 0.3, 0.9999).orderBy("chunk", "place").collect() for _ in range(2))
    assert a == b and sorted(r.vec_id for r in a) == list(range(15))
    assert sum(x.vec_id % 3 == y.vec_id % 3 for x, y in zip(a, a[1:], strict=False)) >= 8
    for n in (0, 1, 2):
        assert ordering.similarity_order(df.filter(F.col("vec_id") < n)).count() == n
    assert ordering.tour(np.zeros((0, 4)), 0, 1, 0) == []


def test_band_neighbours_see_all_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(round(x, 1)) for x in rng.standard_normal(4)]) for i in rng.permutation(45).tolist()]
    rows += [(100 + i, v) for i, v in rows[:5]]  # ties of different chunks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {}
    for i, u in unit.items():
        s = {j: round(float(u @ v), 9) for j, v in unit.items() if j != i}
        want[i] = (sum(0.3 <= x <= 0.5 for x in s.values()), min(s, key=lambda j: (-s[j], j)), max(s.values()))
    for chunk in (7, 50, 1000):
        got = {r.vec_id: (r.in_band, r.nearest, r.similarity) for r in ordering.band_neighbours(df, 0.3, 0.5, chunk=chunk).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i][:2] == want[i][:2] and math.isclose(got[i][2], want[i][2], abs_tol=1e-8)
    assert ordering.band_neighbours(df.limit(0), 0.3, 0.5).count() == 0 == ordering.band_neighbours(df.limit(1), 0.3, 0.5).count()


def clusters(n=3000, k=12, d=16, spread=0.05):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((k, d))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    return [(i, (centers[i % k] + spread * rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("low,high", [(0.3, 0.5), (0.97, 1.0), (-1.0, -0.4)])
def test_band_queries_skip_cells_and_miss_nothing(spark, monkeypatch, low, high):
    rows = clusters()
    nan = float("nan")
    odd = [(None, [1.0] * 16), (9000, None), (9020, [0.0] * 16), (9040, [nan] * 16), (9060, [1.0] * 3), (9080, []), (40, rows[40][1]), (40, rows[7][1])]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows + odd], "vec_id long, embedding array<double>, id string, q int").repartition(3)
    kept = rows + odd[-2:]
    ids = np.array([i for i, _ in kept])
    unit = np.array([v for _, v in kept])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = []
    for i, u in zip(ids, unit):
        if i % 20 == 0:
            s = np.round(unit @ u, 9)
            others = ids != i
            best = s[others].max()
            want.append((int(i), int(((s >= low) & (s <= high) & others).sum()), int(ids[others & (s == best)].min()), round(float(best), 6)))
    for room in (ordering.QUERY_BYTES, 20_000):
        monkeypatch.setattr(ordering, "QUERY_BYTES", room)
        got = ordering.band_neighbours(df, low, high, queries=lambda i: i % 20 == 0, with_work=True).collect()
        assert sorted((r.vec_id, r.in_band, r.nearest, round(r.similarity, 6)) for r in got) == sorted(want)
    compared = sum(r.compared for r in got)
    assert compared < len(want) * len(kept) * (0.6 if low > 0.9 else 0.95), compared / len(want) / len(kept)


def test_losses(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 2) for _ in range(12)], rng.randrange(12)) for i in range(20)]
    df = losses.with_softmax(spark.createDataFrame(rows, "i long, logits array<double>, label int"))
    got = df.select("i", "ce", "p_label", losses.entropy(F.col("p")).alias("h"), losses.deft_gate(F.col("p"), F.col("p_label")).alias("g"), losses.kl(F.col("p"), F.col("p")).alias("kl")).collect()
    for r, (_, z, y) in zip(sorted(got, key=lambda r: r.i), rows, strict=True):
        e = np.exp(np.array(z) - max(z))
        p = e / e.sum()
        assert math.isclose(r.ce, -math.log(p[y]), rel_tol=1e-9) and math.isclose(r.h, -(p * np.log(p)).sum(), rel_tol=1e-9)
        assert math.isclose(r.g, p[y] ** (p * p).sum(), rel_tol=1e-9) and abs(r.kl) < 1e-9
    two = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(sum(r[0]), 6) for r in two.select(losses.slerp(F.col("a"), F.col("b"), 0.5)).collect()] == [round(math.sqrt(2), 6), 1.0, 1.0]
