import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tunemill.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, n int"


def brute(rows, k, rounds, size, largest=centroids.LARGEST):
    kept = []
    for i, v in rows:
        if v is None or len(v) != size or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in v):
            continue
        v = [int(np.floor(x * 64)) for x in v]
        if max(map(abs, v), default=0) <= largest:
            kept.append((i, v))
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda v: min(range(len(at)), key=lambda c: (away(v, at[c]), c))
    for _ in range(rounds):
        mine = [assign(v) for _, v in kept]
        for c in range(len(at)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, c, away(v, at[c]), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, v in kept for c in [assign(v)]]
    sums = {}
    for _, c, d, _ in out:
        sums[c] = sums.get(c, 0) + d
    return sorted(((i, c, d, sums[c], sum(sums.values()), h) for i, c, d, h in out), key=str)


def odd_rows(size):
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, [0.5] * (size + 1)), (902, []), (903, [nan] + [0.0] * (size - 1)), (904, [inf] * size), (905, [None] * size), (906, [1e300] * size), (907, [3e6] * size), (908, [-2e6] * size)]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5)])
def test_against_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    size = 4
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1 / 64, -1 / 64, rng.gauss(0, 1), 1000.0]) for _ in range(size)]) for i in range(300)]
    rows += [(i, [0.5] * size) for i in range(300, 450)] + [(None, [0.1] * size), (None, [0.2] * size), (7, rows[7][1]), (7, [0.0] * size)] + odd_rows(size)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    got = centroids.cluster(df, size=size, centroids=16).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 16, 3, size)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=str) == brute(rows, 16, 3, 64)
    assert centroids.cluster(df.limit(0)).collect() == []
    assert centroids.cluster(df.selectExpr("vec_id", "cast(null as array<double>) embedding")).collect() == []


def test_screening_never_drops_the_nearest():
    """Large norms and near ties, where single precision is far from exact."""
    rng = np.random.default_rng(5)
    for scale in (1, 1 << 10, 1 << 20, centroids.LARGEST - 50):
        base = rng.integers(-scale, scale + 1, 64)
        c = base + rng.integers(-2, 3, (16, 64))
        x = base + rng.integers(-3, 4, (500, 64))
        x[:50] = (c[0] + c[1]) // 2
        number, distance, decided_exactly = centroids.nearest(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert scale < 1 << 20 or decided_exactly > 400


def test_well_separated_vectors_need_no_exact_distances():
    rng = np.random.default_rng(6)
    c = rng.integers(-64, 65, (16, 64))
    assert centroids.nearest(c + rng.integers(-3, 4, (16, 64)), c)[2] == 0


def test_components_at_both_ends_of_the_range(spark):
    df = spark.createDataFrame([(i, [2.0**21 * (1 if i % 2 else -1)] * 64, "x", 1) for i in range(6)], SCHEMA)
    got = centroids.cluster(df, centroids=2).collect()
    assert {r.distance for r in got} == {0} and {r.cluster for r in got} <= {0, 1}


def test_repeated_first_centroids_go_to_the_smallest_number(spark):
    df = spark.createDataFrame([(i, [1.0] * 64 if i % 3 else [float(i)] * 64, "x", 1) for i in range(60)], SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=str) == brute(rows, 16, 3, 64)


def test_integer_vectors_of_single_precision_and_slices():
    column = pa.array([[0.5] * 2, None, [1.0], [-0.01, 3.0], [float("nan"), 0.0]], pa.list_(pa.float32()))
    rows, x = centroids.integer_vectors(column.slice(2), 2)
    assert rows.tolist() == [1] and x.tolist() == [[-1, 192]]
    assert centroids.integer_vectors(column, 2)[0].tolist() == [0, 3]
