import hashlib

from pyspark.sql import functions as F

from tunemill.llm.exact_dedup import drop_exact, exact_groups

SCHEMA = "doc_id long, text string, keep_id long, digest string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "only"), (5, "a "), (6, "é" * 50_000), (7, "é" * 50_000), (8, "b"), (8, "b"), (9, "x")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in ROWS], SCHEMA)
    assert sorted(map(tuple, exact_groups(df).collect()), key=str) == brute(ROWS)


def test_digest_collisions_are_told_apart(spark):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in ROWS], SCHEMA)
    found = exact_groups(df, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found if r.doc_id) == sorted(x[:4] for x in brute(ROWS) if x[0])


def test_large_group_and_salts(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_groups(df, salts=7)
    assert found.filter("kept").count() == 5000 - 1667 + 1
    assert found.filter("keep_id = 4998").agg(F.max("group_size")).first()[0] == 1667


def test_drop_keeps_columns_and_one_row_each(spark):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in ROWS], SCHEMA)
    out = drop_exact(df)
    assert out.columns == df.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in ROWS})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).collect() == [] and drop_exact(df).collect() == []
