import re

import pytest
from pyspark.sql import functions as F

from tunemill.llm.mixing import mix_plan, mixed

SCHEMA = "doc_id long, text string, source string, size long"


def rows_of(n=400):
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}"
        out.append((i, " ".join(["w"] * (i * 7 % 60)) if i % 11 else None, source, -1))
    return out


def targets(rows):
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(size.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            return size, out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= full


def test_targets_and_bounds(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_plan(df)["taken"].collect()
    size, want = targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(12, 0.02 * want[s])
    again = mix_plan(df.repartition(7))["taken"].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_low_discrepancy(spark):
    plan = mix_plan(spark.createDataFrame(rows_of(), SCHEMA), block_words=5)
    slots = plan["schedule"].orderBy("slot").toPandas()
    share = (slots.source == "hot").mean()
    for n in range(50, len(slots), 50):
        assert abs((slots.source[:n] == "hot").sum() - share * n) <= 5
    words = plan["blocks"].groupBy("source", "block").agg(F.sum("words").alias("w")).toPandas()
    assert (words.w <= 5).all() and (words.w == 5).mean() > 0.9


def test_small_sources_beside_a_hot_one(spark):
    small = {f"s{n:04d}": n for n in (1, 3, 50, 90, 300, 700, 2000, 5000)}
    rows = [(k, "w " * 20_000, "hot", -1) for k in range(500)]
    for name, n in small.items():
        sizes = [n // 4, n - n // 4]
        rows += [(len(rows) + j, "w " * size, name, -1) for j, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    taken = {r.source: r for r in mix_plan(df)["taken"].groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert taken.keys() == {"hot", *small}
    for r in taken.values():
        assert abs(r.taken - r.target) <= max(0.5, 0.02 * r.target)


def test_mixed_repeats_whole_documents(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert all(t.collect() == [] for t in mix_plan(empty).values()) and mixed(empty).collect() == []
    odd = spark.createDataFrame([(1, None, None, 0), (1, "a b", "x", 0), (None, "c", "x", 0), (1, "a b", "x", 0)], SCHEMA)
    got = mix_plan(odd)["taken"].collect()
    assert len(got) == 4 and all(r.taken <= 2 * r.size for r in got)
    only = spark.createDataFrame([(1, " \t", "x", 0)], SCHEMA)
    assert mix_plan(only)["taken"].first().taken == 0
