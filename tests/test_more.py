"""Sources, sinks, settings, jobs, folds and the smaller operators, against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill import config, jobs
from tunemill.functions.ranks import first_rows, global_rank, nth_values, running_total
from tunemill.functions.skew import hot_safe_join
from tunemill.operators import inspection, losses, metrics, packing, scoring, stateful, tools, tuning
from tunemill.session import scratch_dir, small, spread, written
from tunemill.sources import readers, sinks
from tunemill.streaming import processors

INF = float("inf")


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 3}, {"x": 4}]')
    spark.createDataFrame([(5,), (6,)], "x long").write.parquet(str(tmp_path / "prepared_dir" / "dataset.parquet"))
    xs = lambda df: sorted(r.x for r in df.collect())
    assert xs(readers.resolve(spark, str(tmp_path / "a.jsonl"))) == [1, 2]
    assert xs(readers.resolve(spark, str(tmp_path / "b.json"))) == [3, 4]
    names = readers.Registry()
    names.add("mine", str(tmp_path / "a.jsonl"), "train")
    assert xs(readers.resolve(spark, "mine", "train", names)) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n{"x": ')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "x long").collect()
    stream = readers.resolve(spark, str(tmp_path / "prepared_dir" / "dataset.parquet"), streaming=True, schema="x long")
    assert stream.isStreaming


def test_eval_sources_fall_back(spark, tmp_path):
    (tmp_path / "local.jsonl").write_text("".join(f'{{"x": {i}}}\n' for i in range(9)))
    local = {"dataset": "no_such_table", "local": str(tmp_path / "local.jsonl"), "samples": 4}
    assert [r.x for r in readers.read_eval_source(spark, local, "x long").collect()] == [0, 1, 2, 3]
    assert readers.read_eval_source(spark, {**local, "mode": "other"}, "x long").count() == 0
    assert readers.read_eval_source(spark, {"dataset": "no_such_table"}, "x long").count() == 0


def test_prepared_data_manifests_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b/c"), (2, "d")], "x long, source string")
    base = str(tmp_path / "out")
    sinks.save_prepared(rows, base, "jsonl")
    path = sinks.save_prepared(rows, base)
    assert path.endswith(".parquet") and readers.find_prepared(spark, base) == path
    assert sorted(r.x for r in readers.resolve(spark, base).collect()) == [1, 2]
    sinks.write_manifest(spark.createDataFrame([(2,)], "n long"), str(tmp_path / "manifest"))
    assert sinks.read_manifest(spark, str(tmp_path / "manifest")).first().n == 2 and sinks.read_manifest(spark, str(tmp_path / "none")) is None
    sinks.save_sources(rows, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["_dir=a_b_c", "_dir=d"]


def test_cache(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"x": 1}\n')
    print_of = lambda **k: sinks.fingerprint(spark, [str(tmp_path / "in.jsonl")], **k)
    one, two, base = print_of(length=8), print_of(length=9), str(tmp_path / "cache")
    assert one == print_of(length=8) != two
    made = []
    build = lambda: made.append(1) or spark.createDataFrame([(len(made),)], "n long")
    assert sinks.cache_state(spark, base, one) == (False, "no data")
    assert [sinks.materialize(build, spark, base, f).first().n for f in (one, one, two)] == [1, 1, 2]
    assert sinks.cache_state(spark, base, two) == (True, "valid") and sinks.cache_state(spark, base, one) == (False, "fingerprint differs")
    with pytest.raises(ValueError):
        sinks.materialize(lambda: spark.createDataFrame([], "n long"), spark, base, one)
    assert sinks.materialize(build, spark, base, two).first().n == 2


def test_metric_history(spark, tmp_path):
    with sinks.MetricSink(spark, str(tmp_path / "m"), "r1", every=2) as sink:
        sink.log({"train/loss": 2.0}, 1)
        sink.log({"other": 1.0}, 2)
        assert not sink.rows  # two steps, one flush
        sink.log({"train/loss": 1.5}, 3)
    history = lambda: [(r.run, r.step, r.value) for r in readers.read_history(spark, str(tmp_path / "m")).orderBy("run", "step").collect()]
    assert history() == [("r1", 1, 2.0), ("r1", 3, 1.5)]
    with sinks.MetricSink(spark, str(tmp_path / "m"), "r1") as again, sinks.MetricSink(spark, str(tmp_path / "m"), "r/2") as other:
        again.log({"train/loss": 1.25}, 3)  # the run went back to a checkpoint before step 3
        again.log({"train/loss": float("nan")}, 1)
        other.log({"train/loss": 7.0}, 3)
    assert history() == [("r/2", 3, 7.0), ("r1", 3, 1.25)]
    spark.createDataFrame([(1, 2.0), (2, None)], "`train/global_step` long, `train/loss` double").write.parquet(str(tmp_path / "wide"))
    assert [(r.step, r.value) for r in readers.read_history(spark, str(tmp_path / "wide")).collect()] == [(1, 2.0)]


def test_failing_metrics_are_kept_and_reported_three_times(spark, tmp_path, caplog):
    (tmp_path / "m").write_text("a file where the folder should be")
    sink = sinks.MetricSink(spark, str(tmp_path / "m"), "r", every=1)
    for step in range(5):
        sink.log({"a": 1.0}, step)
    sink.log({"a": "no number"}, 5)
    assert sink.failures == 7 and len([r for r in caplog.records if "metrics not written" in r.message]) == 3
    (tmp_path / "m").unlink()
    sink.close()
    assert sorted(r.step for r in readers.read_history(spark, str(tmp_path / "m"), "a").collect()) == list(range(5))


def test_replayed_batches_change_no_metric(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "m")
    put = lambda k, rows: spark.createDataFrame(rows, "run string, step long, metric string, value double").coalesce(1).write.parquet(f"{source}/part={k}")
    stream = lambda: spark.readStream.schema("run string, step long, metric string, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    history = lambda: sorted((r.run, r.step, r.value) for r in readers.read_history(spark, path, "x").collect())
    put(0, [("a", 1, "x", 1.0), ("a", 2, "x", None), ("a", 2, "y", 5.0)])
    sinks.stream_metrics(stream(), path, str(tmp_path / "c0"))
    put(1, [("a", 1, "x", 3.0), ("b", 1, "x", 2.0)])
    sinks.stream_metrics(stream(), path, str(tmp_path / "c0"))
    first = history()
    assert first == [("a", 1, 3.0), ("b", 1, 2.0)]
    sinks.stream_metrics(stream(), path, str(tmp_path / "c1"))  # without the progress: both batches again
    assert history() == first and spark.read.parquet(path).count() == 5


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data:\n  max_seq_length: 128\n  packing: true\npreprocess: {budget: 7}\nother: 1\n")
    for args in ([str(path)], ["--config", str(path)], [f"--config={path}"]):
        s = config.Settings.read([*args, "--data.seed=5", "--preprocess.min_ppl", "2.5", "--data.streaming"])
        assert (s.data.max_seq_length, s.data.packing, s.data.seed, s.data.streaming, s.preprocess.budget, s.preprocess.min_ppl) == (128, True, 5, True, 7, 2.5)
    assert config.Settings.read([]) == config.Settings()
    (tmp_path / "s.yaml").write_text("sources:\n  - {name: a, weight: 2}\n  - {name: b}\n")
    (tmp_path / "l.yaml").write_text("- {name: a}\n")
    assert [x["name"] for x in config.read_sources(str(tmp_path / "s.yaml"))] == ["a", "b"] and config.read_sources(str(tmp_path / "l.yaml")) == [{"name": "a"}]
    grid = config.ablation_grid({"data": {"seed": 1}}, {"base": {}, "long": {"data.max_seq_length": 4096}})
    assert grid["base"].data.max_seq_length == 8192 and grid["long"].data.max_seq_length == 4096 and grid["long"].data.seed == 1


def test_jobs(tmp_path):
    done, path = [], tmp_path / "state" / "s.json"

    def failing(state):
        done.append("b")
        if len(done) < 3:
            raise RuntimeError
        return {"best_lr": state["x"] * 2}

    phases = {"a": lambda s: done.append("a") or {"x": 2}, "b": failing}
    with pytest.raises(RuntimeError):
        jobs.run_phases(phases, path)
    assert jobs.run_phases(phases, path)["best_lr"] == 4 and done == ["a", "b", "b"]
    assert jobs.report(jobs.load_state(path), tmp_path / "report.json", model="m")["best_lr"] == 4
    assert json.loads((tmp_path / "report.json").read_text())["model"] == "m" and jobs.load_state(tmp_path / "none") == {}
    first = jobs.run_id(tmp_path, "n", reuse=False)
    assert jobs.run_id(tmp_path, "n", reuse=True) == first != jobs.run_id(tmp_path, "n", reuse=False)
    (tmp_path / "run_id.json").write_text("broken")
    assert jobs.run_id(tmp_path, "n", reuse=True) != first
    assert [jobs.will_resume(*x) for x in (("", "c"), ("auto", None), ("auto", "c"), ("path", None))] == [False, False, True, True]


def test_jobs_on_the_shared_file_system(spark, tmp_path):
    path, done = f"file:{tmp_path}/deep/s.json", []
    phases = {"a": lambda s: done.append("a") or {"x": "é"}, "b": lambda s: done.append("b") or {"y": s["x"] * 2}}
    assert jobs.run_phases(phases, path, spark)["y"] == "éé" == jobs.run_phases(phases, path, spark)["y"] and done == ["a", "b"]
    (tmp_path / "deep" / "s.json").rename(tmp_path / "deep" / "s.json.new")  # as a crash before the last step leaves it
    assert jobs.load_state(path, spark)["completed_phases"] == ["a", "b"] and jobs.load_state(f"{path}.none", spark) == {}
    first = jobs.run_id(f"file:{tmp_path}", "n", False, spark)
    assert jobs.run_id(f"file:{tmp_path}", "n", True, spark) == first == jobs.run_id(tmp_path, "n", True)


def test_ranks_without_one_task(spark, monkeypatch):
    rows = written(spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("x"), "id"), "t")
    plain = {n: sorted(map(tuple, f().collect())) for n, f in (("run", lambda: running_total(rows, ["g", "x", "id"], "id", "s")), ("nth", lambda: nth_values(rows, "x", by="g", a=0.5, b=0.9)), ("one", lambda: nth_values(rows, "x", a=0.5)))}
    top = [r.id for r in first_rows(rows, ["x", "id"], 20).orderBy("rank").collect()]
    monkeypatch.setattr("tunemill.functions.ranks.WINDOW_ROWS", 10)
    again = {n: sorted(map(tuple, f().collect())) for n, f in (("run", lambda: running_total(rows, ["g", "x", "id"], "id", "s")), ("nth", lambda: nth_values(rows, "x", by="g", a=0.5, b=0.9)), ("one", lambda: nth_values(rows, "x", a=0.5)))}
    assert plain == again and top == [r.id for r in first_rows(rows, ["x", "id"], 20).orderBy("rank").collect()]
    for g, a, b in plain["nth"]:
        xs = sorted(float(i * 37 % 101) for i in range(500) if i % 3 == g)
        assert (a, b) == (xs[int(len(xs) * 0.5)], xs[int(len(xs) * 0.9)])
    assert nth_values(rows.filter("id < 0"), "x", a=0.5).first().a is None


def test_skew_safe_join_and_small(spark, monkeypatch):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = written(spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, 7)], "k long, v long")), "t")
    for how in ("inner", "left"):
        want = sorted(left.join(right, "k", how).select("id", F.coalesce("v", F.lit(-1)).alias("v")).collect())
        for limit in (500_000, 0):
            monkeypatch.setattr("tunemill.session.BROADCAST_ROWS", limit)
            assert sorted(hot_safe_join(left, right, ["k"], how, 50).select("id", F.coalesce("v", F.lit(-1)).alias("v")).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr("tunemill.session.BROADCAST_BYTES", 100)
    assert small(right) is right and scratch_dir(spark) and spread(spark.range(8, numPartitions=1)).rdd.getNumPartitions() > 1


def test_scores_do_not_depend_on_the_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a . b"), (3, ""), (4, None), (5, "z")], "doc_id long, text string")
    near = sorted(scoring.score(docs).collect())
    monkeypatch.setattr("tunemill.session.BROADCAST_ROWS", 0)
    assert sorted(scoring.score(docs).collect()) == near
    known = docs.withColumn("p", F.when(F.col("doc_id") == 1, 3))
    got = {r.sample: r.response_token_count for r in scoring.score(known, prefix_col="p").collect()}
    assert got[1] == 1 and got[2] == 2
    chars = {r.sample: r.length for r in scoring.score(docs, tokenizer=lambda t: F.split(t, " ")).collect()}
    assert chars[1] == 4


def test_greedy_batches_are_those_of_a_walk(spark):
    rng = np.random.default_rng(5)
    for top, limit in ((12, 40), (60, 50), (3, 7)):
        lengths = rng.integers(0, top, 150).tolist()
        got = packing.greedy_batches(spark.createDataFrame(list(enumerate(lengths)), "seq_id long, length long"), 4, limit).collect()
        want, batch, size = [], 0, 0
        for n, i in sorted((n, i) for i, n in enumerate(lengths)):
            if size and (size >= 4 or (size + 1) * n > limit):
                batch, size = batch + 1, 0
            size += 1
            want.append((i, batch))
        assert sorted((r.seq_id, r.batch) for r in got) == sorted(want)
    assert packing.greedy_batches(spark.createDataFrame([], "seq_id long, length long"), 4, 10).count() == 0


def test_folds_keep_order_nulls_and_null_keys(spark):
    rows = spark.createDataFrame([(None, 2, 3.0), (None, 1, 1.0), ("a", 1, None), ("a", 2, 5.0), ("b", 1, 2.0)], "run string, step long, value double")
    got = {r.run: (r.n, r.ema) for r in stateful.ramped_ema(rows, decay=0.5).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0), "b": (1, 2.0)}
    assert stateful.ramped_ema(rows.limit(0)).collect() == []
    flat = spark.createDataFrame([("r", i, 1.0) for i in range(120)] + [("s", i, 1.0 / (i + 1)) for i in range(120)], "run string, step long, value double")
    assert [(r.run, r.start, r.stop) for r in stateful.plateaus(flat).collect()] == [("r", 0, 119)]



def test_label_inspection(spark):
    text = "a <tool_response>b c</tool_response> d ```output\ne f``` [Tool Output]g"
    df = spark.createDataFrame([(text, "x <think>y z</think>  w", 10)], "t string, r string, n long")
    row = df.select(
        inspection.observed_text(F.col("t")).alias("parts"), inspection.observed_labels(F.col("t")).alias("seen"), inspection.strip_reasoning_labels(F.col("r")).alias("kept"),
        inspection.cursor_spans(F.lit("u: hi; b: hi; u: no"), F.array(F.lit("hi"), F.lit("hi"), F.lit("gone"), F.lit("no"))).alias("spans"),
        inspection.response_mask(F.col("n"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>")).alias("late"), inspection.response_mask(F.lit(0), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("none"),
    ).first()
    assert row.parts == ["b c", "g", "e f"] and [x for x in row.seen if x != -100] == [1, 1, 1, 1, 1]
    assert [x for x in row.kept if x != -100] == [1, 1] and row.late == [False] * 4 + [True] * 6 and row.none == []
    assert [tuple(s) for s in row.spans] == [(3, 5), (10, 12), (-1, -1), (17, 19)]


def test_stable_rank_and_cosine(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((7, 4))
    rows = spark.createDataFrame([("m", i, v.tolist()) for i, v in enumerate(m)] + [("z", 0, [0.0, 0.0])], "name string, i long, v array<double>")
    got = {r.name: r.stable_rank for r in metrics.stable_ranks(rows, "name", "i", "v").collect()}
    assert abs(got["m"] - (m**2).sum() / np.linalg.norm(m, 2) ** 2) < 1e-9 and got["z"] == 0.0
    assert metrics.sampled_layers(12) == [0, 4, 6, 8, 11] and metrics.sampled_layers(1) == [0] and metrics.sampled_layers(0) == []
    a = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))
    assert tuple(rows.select(losses.flat_cosine(a, a), losses.flat_cosine(a, F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))))).first()) == (1.0, 0.0)


def test_trials_errors_and_logs(spark):
    def trial(lr, steps):
        if lr > 1:
            raise RuntimeError
        return {"final_loss": lr * steps}

    assert [tuple(r) for r in tuning.run_trials(spark, [0.5, 2.0], 4, trial).collect()] == [(0.5, 2.0, False), (2.0, INF, True)]
    errors = spark.createDataFrame([(i, 0, 0, "e", "d") for i in range(5)], "sample long, turn long, call long, error string, detail string")
    assert [(r.sample, r.truncated) for r in tools.first_errors(errors, 3).collect()] == [(0, True), (1, True), (2, True)]
    assert {r.truncated for r in tools.first_errors(errors, 5).collect()} == {False}
    lines = spark.createDataFrame([("x", i, s) for i, s in enumerate(["INFO {'loss': 2.5, 'step': 4}", '{"train/loss": 1.5, "train/global_step": 5, "a": {"b": 1}}', "step: 9 loss: 3"])] + [("y", 0, "Step 3, loss=nan"), ("y", 1, "step=4 | loss: 1e-3")], "run string, no long, line string")
    got = sorted((r.run, r.step, str(r.loss)) for r in metrics.parse_losses(lines, ["run"], "no").collect())
    assert got == [("x", 9, "3.0"), ("y", 4, "0.001")]
    only = sorted((r.step, r.loss) for r in metrics.parse_losses(lines.filter("run = 'x' AND no < 2"), ["run"], "no").collect())
    assert only == [(4, 2.5), (5, 1.5)]
    steps = spark.createDataFrame([("[x] step=3 loss=nan lr=1e-05 tok/s=10.5 grad_norm=-inf dt=2.5s",), ("step=4 loss=1.0",), ("grad_norm=1 tok/s=2 lr=3 loss=4 step=5",)], "line string")
    a, b = metrics.parse_steps(steps).orderBy("step").collect()
    assert (a.step, str(a.loss), a.lr, a.tokens_per_sec, a.grad_norm, a.step_time) == (3, "nan", 1e-5, 10.5, -INF, 2.5) and (b.step, b.loss, b.step_time) == (5, 4.0, 0.0)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    schema = "run string, event_id long, value double"
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    put(0, [("a", i, float(i)) for i in range(6)] + [("b", 1, 1.0)])
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = lambda: {r.run: r["count"] for r in processors.run_once(processors.spike_states(stream(), warmup=3), "update", str(tmp_path / "s"), ["run"]).collect()}
    assert run() == {"a": 6, "b": 1}
    put(1, [("a", i, 2.0) for i in range(6, 9)])
    assert run() == {"a": 9, "b": 1}
    whole = processors.run_once(processors.step_windows(stream().withColumnRenamed("event_id", "step"), 3), "complete", str(tmp_path / "c"), []).collect()
    assert sum(r.n for r in whole) == 10
    assert processors.run_once(stream().filter("run = 'b'"), "append", str(tmp_path / "a"), []).count() == 1


def test_shards_cover_all_rows(spark):
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    for contiguous in (False, True):
        parts = [[r.doc_id for r in packing.row_shard(docs, "doc_id", i, 3, contiguous).collect()] for i in range(3)]
        assert sorted(sum(parts, [])) == list(range(10)) and max(map(len, parts)) - min(map(len, parts)) <= 1
    assert global_rank(docs.limit(0), ["doc_id"]).collect() == []
