"""Cases of the fourth round's findings."""

import math
import random

import duckdb
import numpy as np
import pytest

from tunemill.plans import q_streams
from tunemill.streaming import buffers, processors


@pytest.fixture
def folders(monkeypatch):
    found, run_once = [], processors.run_once
    monkeypatch.setattr(processors, "run_once", lambda stream, mode, folder, *a, **k: found.append(folder) or run_once(stream, mode, folder, *a, **k))
    return found


@pytest.fixture
def wide(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _parts(spark, folder):
    return {r.numPartitions for r in spark.read.format("state-metadata").load(f"{folder}/checkpoint").collect()}


def test_many_runs_share_few_states(spark, tmp_path, folders, wide):  # F1
    spark.range(3000).selectExpr("id AS event_id", "id % 1500 AS user_id", "id * 0.5D AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: tuple(r) for r in q_streams.stream_recent_values(spark, str(tmp_path)).collect()}
    assert len(got) == 3000 and got[7] == (7, 7, 1, 3.5, 3.5, 3.5) and got[1507] == (7, 1507, 2, 378.5, 3.5, 753.5)
    state = spark.read.format("statestore").option("path", f"{folders[0]}/checkpoint").option("stateVarName", "recent").load()
    assert 0 < state.count() <= 256
    assert _parts(spark, folders[0]) == {16}


def test_recent_values_equal_their_sql_over_batches(spark, tmp_path, monkeypatch):  # F1
    draw = random.Random(5)
    user = lambda i: None if i % 11 == 0 else 3 if i % 2 else draw.randrange(40)
    value = lambda i: None if i % 7 == 0 or 100 < i < 230 else math.nan if i % 31 == 0 or i > 560 else draw.randrange(-999, 9999) / 100
    rows = [(i or None, user(i), value(i)) for i in range(600)]
    draw.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(map(repr, db.execute(q_streams.ORACLE_SQL["stream_recent_values"]).fetchall()))
    for most in (10**6, 130):
        monkeypatch.setattr(buffers, "BATCH_ROWS", most)
        assert sorted(repr(tuple(r)) for r in q_streams.stream_recent_values(spark, str(tmp_path)).collect()) == want


def test_the_latest_values_are_summed_exactly():  # F1
    values = np.array([1e16, 1.0, -1e16, 3.0, math.inf, 2.0, 1.0, 0.5])
    place, at = np.arange(8), np.array([2, 3, 5, 7])
    n, mean, least, most = buffers._latest(values, np.array([True] * 6 + [False, True]), place, at, 3)
    assert n.tolist() == [3, 3, 3, 2] and mean.tolist() == [1 / 3, math.fsum([1.0, -1e16, 3.0]) / 3, math.inf, 1.25]
    assert least.tolist() == [-1e16, -1e16, 2.0, 0.5] and most.tolist() == [1e16, 3.0, math.inf, 2.0]


def test_a_batch_in_order_is_read_by_many_tasks(spark, tmp_path):  # F2
    table = spark.range(200).selectExpr("199 - id AS event_id", "id % 3 AS user_id")
    stream = buffers.in_order(table, "event_id", f"{tmp_path}/rows", 80)
    assert len(list(tmp_path.glob("rows/*.parquet"))) == 3 * buffers.BATCH_FILES
    processors.run_once(stream, "append", f"{tmp_path}/s", [])
    rows = spark.read.parquet(f"{tmp_path}/s/batches").selectExpr("batch", "event_id").groupBy("batch").agg({"event_id": "min", "*": "count"}).collect()
    assert sorted((r.batch, r["min(event_id)"], r["count(1)"]) for r in rows) == [(0, 0, 80), (1, 80, 80), (2, 160, 40)]


def test_the_shuffle_keeps_few_states_for_its_shards(spark, tmp_path, monkeypatch, folders, wide):  # F2
    spark.range(400).selectExpr("id AS event_id", "id % 3 AS user_id", "id * 0.5D AS value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(q_streams, "BUFFER", 20)
    got = q_streams.stream_shuffle_buffer(spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in got) == list(range(400)) and _parts(spark, folders[0]) == {16}
    for s in range(q_streams.SHARDS):
        mine = sorted((r.position, r.event_id) for r in got if r.shard == s)
        ids, buffer, want = sorted(i for _, i in mine), [], []
        assert [p for p, _ in mine] == list(range(len(ids)))
        for i, at in zip(ids, buffers.slots(q_streams.SEED, s, 0, len(ids), 20), strict=True):
            if len(buffer) < 20:
                buffer.append(i)
            else:
                want.append(buffer[at])
                buffer[at] = i
        assert [i for _, i in mine][: len(want)] == want


def test_slots_are_the_hash_of_whole_numbers():  # F2
    mask = (1 << 64) - 1
    for seed, shard, first, size in ((11, 7, 0, 1000), (-3, 2, 10**12, 8), (2**40, 0, 2**62, 2**32 - 1), (0, 5, 3, 1)):
        want = []
        for i in range(first, first + 50):
            x = (seed * 0xD1B54A32D192ED03 + shard * 0x8CB92BA72F3D8DD7 + (i + 1) * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            want.append(((x ^ (x >> 31)) * size) >> 64)
        assert list(buffers.slots(seed, shard, first, 50, size)) == want


def test_the_shuffle_gives_rows_of_all_types_as_they_came(spark, tmp_path):  # F2
    columns = """id AS event_id, if(id % 4 = 0, null, concat('s', id)) AS word, if(id % 5 = 0, null, named_struct('a', id, 'b', array(id, null))) AS parts,
        timestamp_micros(id * 86400000001) AS at, cast(id / 7 AS decimal(20, 6)) AS exact, if(id % 3 = 0, null, id + 9007199254740993) AS large,
        if(id % 2 = 0, double('nan'), null) AS value, timestamp_ntz '2024-03-31 02:30:00' AS wall"""
    for k in range(2):
        spark.range(k * 60, k * 60 + 60).createOrReplaceTempView("r04_ids")
        spark.sql(f"SELECT {columns} FROM r04_ids").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        left = processors.run_once(buffers.shuffle_buffer(stream, 6, "event_id", 3), "append", f"{tmp_path}/s", [], rocksdb=True)
        got = left.unionByName(buffers.left_in_buffer(spark, f"{tmp_path}/s")).drop("shard", "position")
        assert got.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
