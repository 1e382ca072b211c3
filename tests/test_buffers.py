"""Bounded buffers of a stream against plain walks, with a stop and a restart between files."""

from collections import deque

from tunemill.streaming import buffers, processors

SCHEMA = "run string, event_id long, value double"


def _files(spark, folder, parts):
    for k, rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={k}")


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def _parts():
    run = lambda i: None if i % 5 == 0 else f"r{i % 3}"
    rows = [(run(i), i, None if i % 7 == 0 else float(i * 13 % 17)) for i in range(90)]
    return [(k, rows[k * 30 : k * 30 + 30][::-1]) for k in range(3)]


def test_recent_values_go_on_after_a_restart(spark, tmp_path):
    source, folder, parts = str(tmp_path / "in"), str(tmp_path / "s"), _parts()
    once = lambda: processors.run_once(buffers.recent_values(_stream(spark, source), 4), "append", folder, [], rocksdb=True)
    _files(spark, source, parts[:2])
    once()
    _files(spark, source, parts[2:])
    got = {r.event_id: (r.run, r.n, r.mean, r.least, r.most) for r in once().collect()}
    last, want = {}, {}
    for run, i, v in sorted(sum((rows for _, rows in parts), []), key=lambda r: r[1]):
        d = last.setdefault(run, deque(maxlen=4))
        d.append(v)
        known = [x for x in d if x is not None]
        want[i] = (run, len(d), sum(known) / len(known) if known else None, min(known, default=None), max(known, default=None))
    assert got == want


def test_shuffle_buffer_is_that_of_a_walk(spark, tmp_path):
    source, folder, parts = str(tmp_path / "in"), str(tmp_path / "s"), _parts()
    once = lambda: processors.run_once(buffers.shuffle_buffer(_stream(spark, source), 8, "event_id", 3, seed=7), "append", folder, [], rocksdb=True)
    _files(spark, source, parts[:1])
    once()
    _files(spark, source, parts[1:])
    left = once().collect()
    kept = buffers.left_in_buffer(spark, folder, seed=7).collect()
    shard = {r.event_id: r.shard for r in left + kept}
    assert sorted(shard) == list(range(90)) and len(left) + len(kept) == 90 and len(kept) == 24
    rows = {r[1]: r for _, part in parts for r in part}
    assert all((r.run, r.event_id, r.value) == rows[r.event_id] for r in left + kept)
    for s in range(3):
        ids = [i for i in range(90) if shard[i] == s]
        buffer, want = [], []
        for i, at in zip(ids, buffers.slots(7, s, 0, len(ids), 8)):
            if len(buffer) < 8:
                buffer.append(i)
            else:
                want.append(buffer[at])
                buffer[at] = i
        assert [r.event_id for r in sorted((r for r in left if r.shard == s), key=lambda r: r.position)] == want
        tail = sorted((r for r in kept if r.shard == s), key=lambda r: r.position)
        assert {r.event_id for r in tail} == set(buffer) and [r.position for r in tail] == list(range(len(want), len(ids)))
    assert len({tuple(buffers.slots(seed, 0, 0, 50, 8)) for seed in range(5)}) == 5 and set(buffers.slots(1, 0, 0, 500, 8)) == set(range(8))
