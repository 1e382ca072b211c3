"""The source of growing logs: lines of ranges, a stream that goes on at a byte, and checkpoint folders."""

import pytest

from tunemill.sources import logs, readers, sinks
from tunemill.streaming import processors


def _read(df):
    return sorted((r.file, r["at"], r.line) for r in df.collect())


@pytest.mark.parametrize("step", [1, 3, 7, 64, 1 << 20])
def test_lines_of_ranges_are_those_of_the_file(spark, tmp_path, step):
    logs.register(spark)
    texts = {"a.log": "one\n\n\nthree é 漢\r\n" + "x" * 200 + "\nlast", "b.log": "", "c.log": "\n", "_hidden": "no\n", "d.txt": "no\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = _read(spark.read.format(logs.NAME).option("glob", "*.log").option("rangeBytes", step).load(str(tmp_path)))
    want = []
    for name in ("a.log", "c.log"):
        at = 0
        for line in texts[name].encode().splitlines(keepends=True) if name == "a.log" else [b"\n"]:
            want.append((name, at, line.decode().rstrip("\r\n")))
            at += len(line)
    assert got == sorted(want)


def test_long_lines_and_missing_folder(spark, tmp_path):
    logs.register(spark)
    (tmp_path / "a").write_text("y" * 300_000 + "\nz\n")
    got = _read(spark.read.format(logs.NAME).option("rangeBytes", 50_000).load(str(tmp_path)))
    assert [(len(line), at) for _, at, line in got] == [(300_000, 0), (1, 300_001)]
    assert _read(spark.read.format(logs.NAME).load(str(tmp_path / "none"))) == []


def test_a_restarted_stream_reads_no_line_twice(spark, tmp_path):
    logs.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    once = lambda: _read(processors.run_once(spark.readStream.format(logs.NAME).load(str(folder)), "append", str(tmp_path / "s"), []))
    (folder / "a.log").write_text("1\n2\nhal")
    assert once() == [("a.log", 0, "1"), ("a.log", 2, "2")]
    with (folder / "a.log").open("a") as f:
        f.write("f\n4\n")
    (folder / "b.log").write_text("5\n")
    want = [("a.log", 0, "1"), ("a.log", 2, "2"), ("a.log", 4, "half"), ("a.log", 9, "4"), ("b.log", 0, "5")]
    assert once() == want and once() == want


def test_checkpoint_folders(spark, tmp_path):
    given = (("r1", 9, "training_meta.json"), ("r1", 10, "dcp/.metadata"), ("r1", 200, "weights"), ("r2", 3, "model/model.safetensors.index.json"), ("r2", 2, "training_meta.json"), ("r3", 1, "weights"))
    for run, step, name in (*given, ("r1", "best", "training_meta.json")):
        at = tmp_path / run / f"step-{step}" / name
        at.parent.mkdir(parents=True)
        at.write_text("x")
    (tmp_path / "r3" / "step-7").write_text("a file")
    found = lambda run="*": readers.scan_checkpoints(spark, str(tmp_path), run)
    assert sorted((r.run, r.step, r.complete) for r in found().collect()) == sorted((r, s, name != "weights") for r, s, name in given)
    assert {r.run: r.step for r in readers.latest_checkpoint(found()).collect()} == {"r1": 10, "r2": 3}
    assert sorted(r.step for r in found("r2").collect()) == [2, 3]
    assert sinks.prune_checkpoints(spark, str(tmp_path), 0) == 0 and sinks.prune_checkpoints(spark, str(tmp_path), 1, run="r2") == 1
    assert sinks.prune_checkpoints(spark, str(tmp_path), 2) == 1
    assert sorted((r.run, r.step) for r in found().collect()) == [("r1", 10), ("r1", 200), ("r2", 3), ("r3", 1)]
    assert (tmp_path / "r1" / "step-best").exists() and not (tmp_path / "r1" / "step-9").exists()
    assert readers.scan_checkpoints(spark, str(tmp_path / "none")).collect() == []
