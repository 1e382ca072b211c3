import random

import numpy as np
import pytest

from tunemill.functions import skew
from tunemill.llm import components, jaccard

SCHEMA = "doc_id long, text string, component_id long, n long"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (sets[a] == sets[b] or (rows[a][0] is not None and rows[b][0] is not None)):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), i if not sets[a] else min(ids, default=None)))
    return sorted(out, key=str)


def variants(rng, words, n):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rows_of(seed=1):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60 + 20 * g)]
        texts += variants(rng, base, 25) + [" ".join(base)] * 3
    texts += [" ".join([f"u{k}w{i}" for i in range(40)] + passage) for k in range(40)]
    texts += [None, "", "  \t", "one", "One", "one two three four", "a b c d e", "A B C D E", " ".join(["same"] * 500), " ".join(["same"] * 9), "w " * 20_000]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "one two three four"), (None, "nobody else says this at all"), (3, "a b c d e"), (4, rows[4][1])]


@pytest.mark.parametrize("tile", [1024, 8])
def test_against_brute_force(spark, tile):
    rows = rows_of(tile)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA).repartition(3)
    got = jaccard.near_groups(df, tile=tile).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_boilerplate_asks_few_tiles(spark):
    rng = random.Random(3)
    heads, docs = [], []
    for k in range(400):  # pairs share an n-gram of their own, all of one size class one of boilerplate
        docs.append((k, 0, k % 40, 100 if k % 2 else 300))
        heads += [(k, 1000 + k // 4 * 2 + k % 2), (k, k % 2)]
    rng.shuffle(heads)
    docs_df = spark.createDataFrame(docs, "node long, block long, tile int, n long")
    every = spark.createDataFrame(heads, "node long, gram long")
    own = every.filter("gram >= 1000")
    size = {d[0]: d[3] for d in docs}
    for table, ratio in ((own, 20), (every, 2)):
        grams = {}
        for r in table.collect():
            grams.setdefault(r.gram, []).append(r.node)
        want = {(a, b % 40) for g in grams.values() for a in g for b in g if 0.8 * size[a] <= size[b] <= size[a] / 0.8}
        got = jaccard.asked_tiles(docs_df, docs_df, table, 80).collect()
        assert sorted((r.node, r.tile) for r in got) == sorted(want)
        assert len(got) <= 400 * 40 // ratio


def test_long_texts_fill_no_tile(spark, monkeypatch):
    rng = random.Random(11)
    long = [f"l{i}" for i in range(900)]
    texts = variants(rng, long, 30) + variants(rng, [f"s{i}" for i in range(60)], 30) + [" ".join([f"u{k}w{i}" for i in range(300)] + long[:200]) for k in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    monkeypatch.setattr(jaccard, "LOAD", 100)
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    got = jaccard.near_groups(df, tile=16).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_hot_shingles_and_hubs(spark, monkeypatch):
    for module in (skew, components, jaccard):
        monkeypatch.setattr(module, "HOT", 5)
    monkeypatch.setattr(skew.hot_safe_join, "__defaults__", (5, None))
    rows = rows_of(6)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    got = jaccard.near_groups(df, tile=8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5)
    links = [(500, i) for i in range(400, 440)] + [(i, i + 1) for i in range(20)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys([500, *range(400, 440)], 400), **dict.fromkeys(range(21), 0)}


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(30)]
    b = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(20)] + [np.arange(10_000)]
    got = jaccard.overlaps(a, b)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b))


def test_drop_near(spark):
    rows = rows_of(5)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)
    out = jaccard.drop_near(df)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, _, c in brute(rows) if i is None or c == i}


def test_empty(spark):
    assert jaccard.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in jaccard.near_groups(spark.createDataFrame([(1, None, 0, 0)], SCHEMA)).collect()] == [(1, 0, 1, 1)]
