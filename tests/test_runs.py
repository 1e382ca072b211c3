import bisect
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunemill.functions.runs import Runs
from tunemill.operators import metrics as M
from tunemill.operators import stateful as S
from tunemill.operators import tuning
from tunemill.sources import readers

INF = float("inf")


def series(spark, n=900, seed=1):
    """A run with half of all rows, a null run, short ones, NaN, infinite and null values."""
    rng = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        run = rng.choice([1, 1, 1, 1, 2, 3, None, rng.randrange(10, 40)])
        at[run] = at.get(run, 0) + rng.choice([1, 1, 2, 7])
        value = rng.choice([float("nan"), INF, -INF, None, rng.randrange(40) / 4, rng.randrange(40) / 4, 900.0, 0.0])
        rows.append((run, at[run], value if rng.random() < 0.3 else rng.randrange(40) / 4))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run long, step long, value double").repartition(3)


def same(a, b):
    assert a.columns == b.columns or sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted((tuple(repr(round(x, 7) if isinstance(x, float) else x) for x in r) for r in df.select(sorted(a.columns)).collect()))
    got, want = rows(a), rows(b)
    assert got == want


@pytest.mark.parametrize("limit", [20, 23, 64, 101, 10_000])
def test_cut_runs_equal_plain_windows(spark, limit):
    df = series(spark)
    w = Window.partitionBy("run").orderBy("step")
    frame = w.rowsBetween(-19, 0)
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"no": F.row_number().over(w).cast("bigint"), "n": F.count("value").over(frame), "most": F.max("value").over(frame), "lag": F.lag("step", 20).over(w),
                           "low": F.min("value").over(far), "high": F.max("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), "sum": F.sum("step").over(far)})
    got = Runs(df, "run", "step", limit).number("no")
    got = got.near(20, lambda w: {"n": F.count("value").over(w.rowsBetween(-19, 0)), "most": F.max("value").over(w.rowsBetween(-19, 0)), "lag": F.lag("step", 20).over(w)})
    got = got.running("low", "min", F.col("value")).running("high", "max", F.col("step"), current=False).running("sum", "sum", F.col("step"))
    same(got.frame(), want)


@pytest.mark.parametrize("f", [
    lambda df, n: M.spikes(df, limit=n), lambda df, n: M.behaviour_spikes(df, limit=n), lambda df, n: M.rolling(df, window=25, limit=n), lambda df, n: M.diverging(df, limit=n),
    lambda df, n: M.new_minima(df, limit=n), lambda df, n: M.patience(df, 4, run_rows=n),
])
def test_metrics_of_a_cut_run_equal_those_of_a_whole_one(spark, f):
    df = series(spark, seed=4)
    same(f(df, 27), f(df, 10**6))
    assert f(df.limit(0), 27).collect() == []


def test_a_hot_run_spans_many_tasks(spark):
    df = spark.range(30_000).select((F.col("id") % 3 * (F.col("id") % 1000)).alias("run"), F.col("id").alias("step"), F.rand(1).alias("value"))
    hot = Runs(df, "run", "step", 1000).hot
    sizes = [r["count"] for r in hot.groupBy("run", "_block").count().collect()]
    assert len(sizes) >= 10 and max(sizes) == 1000
    at = hot.select("run", "_no").distinct().count()
    assert at == sum(sizes)


def test_a_frame_longer_than_a_block_is_refused(spark):
    with pytest.raises(ValueError, match="longer"):
        Runs(series(spark), "run", "step", 10).near(11, lambda w: {})


def folds(spark, n, kind, seed=3):
    rng = random.Random(seed)
    values = {"plain": lambda: rng.lognormvariate(0, 1), "spiky": lambda: rng.choice([1e-13, 0.0, 0.01, 1.0, 500.0]) * rng.random(), "flat": lambda: rng.choice([1.0, 1.5, 2.25])}[kind]
    rows = [(1, i, values()) for i in range(n)] + [(None, i, values()) for i in range(n // 3)] + [(2, i, 0.0) for i in range(n // 2)] + [(3, 0, 4.0), (4, 1, None)]
    rows += [(5, i, float("nan") if i == 9 else 2.0) for i in range(n // 2)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run long, step long, value double").repartition(2)


def close(a, b):
    rows = lambda df: sorted((tuple(repr(float(f"{x:.9g}")) if isinstance(x, float) else repr(x) for x in r) for r in df.collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kind,cut", [("spiky", 1), ("plain", 19), ("flat", 33)])
def test_folds_of_blocks_equal_a_walk(spark, kind, cut):
    df = folds(spark, 60, kind)
    close(S.adaptive_clip(df, run_rows=cut), S.adaptive_clip(df))
    close(S.ramped_ema(df, decay=0.9, run_rows=cut), S.ramped_ema(df, decay=0.9))


@pytest.mark.parametrize("kind", ["plain", "spiky", "flat"])
def test_maps_compose_at_every_place(kind):
    rng = random.Random(kind)
    x = [{"plain": rng.lognormvariate(0, 1), "spiky": rng.choice([0.01, 1.0, 500.0]) * (0.01 + rng.random()), "flat": rng.choice([1.0, 1.5, 2.25])}[kind] for _ in range(300)]
    ema, clips, states = x[0], 0, []
    for v in x:
        states.append((ema, clips))
        ema, clips = 0.95 * ema + (1 - 0.95) * min(v, 1.5 * ema), clips + (v > 1.5 * ema)
    for cut in range(300):
        m = S.Knots(min(x), max(x))
        for v in x[cut:]:
            m.clipped_average(v, 1.5, 0.95)
        at, to, count = m.kept()
        k = min(max(bisect.bisect_right(at, states[cut][0]) - 1, 0), len(count) - 1)
        assert abs(np.interp(states[cut][0], at, to) - ema) < 1e-9 * ema and states[cut][1] + count[k] == clips, cut


def test_a_long_block_forgets_its_start():
    rng = random.Random(1)
    m = S.Knots(1e-6, 1e6)
    for _ in range(5000):
        m.clipped_average(rng.lognormvariate(0, 1), 1.5, 0.95)
    assert m.to[-1] - m.to[0] < 1e-12 and len(m.at) < 2000


def test_expired_checkpoints(spark):
    df = spark.createDataFrame([(r, s) for r in (1, 2, None) for s in (5, 1, 3, 9)] + [(4, 7)], "run long, step long")
    kept = lambda k: sorted(((r.run or 0, r.step) for r in M.expired_checkpoints(df, k).collect()))
    assert kept(3) == [(0, 1), (1, 1), (2, 1)] and kept(1) == [(r, s) for r in (0, 1, 2) for s in (1, 3, 5)] and len(kept(0)) == 13


def test_lines_have_their_number_within_the_file(spark, tmp_path):
    for name, n in (("a.log", 2000), ("b.log", 3), ("c.log", 0)):
        (tmp_path / name).write_text("".join(f"{name} line {i + 1}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = readers.read_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2003 and all(r.line == f"{r.file.rsplit('/', 1)[1]} line {r.no}" for r in got)


def test_rows_of_a_history_without_steps_are_numbered(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(0, 50, 1, 4).selectExpr("cast(id as double) `train/loss`").write.parquet(path)
    got = sorted((r.step, r.value) for r in readers.read_history(spark, path).collect())
    assert [s for s, _ in got] == list(range(50)) and sorted(v for _, v in got) == [float(i) for i in range(50)]


@pytest.mark.parametrize("limit", [200_000, 5])
def test_curve_points_are_those_of_the_whole_curve(spark, limit):
    lengths = {"a": 1, "b": 2, "c": 3, "d": 11, None: 40}
    rows = [(r, 10 * i, None if r == "b" else float(i * 37 % 41)) for r, n in lengths.items() for i in range(n)]
    got = {r.run: tuple(r.curve) for r in tuning.curve_points(spark.createDataFrame(rows, "run string, step long, value double"), limit=limit).collect()}
    for run, n in lengths.items():
        curve = [v for r, _, v in rows if r == run]
        assert got[run] == (n, curve[0], curve[n // 2], curve[-min(max(3, n // 3), n)], curve[-1])
    assert len(got) == 5 and tuning.curve_points(spark.createDataFrame([], "run string, step long, value double")).collect() == []
