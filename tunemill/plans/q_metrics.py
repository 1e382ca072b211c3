"""Metric, log, fold, tuning and streaming queries over events; a run is a user, its steps the user's events in order."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunemill.functions.runs import Runs
from tunemill.operators import metrics as M
from tunemill.operators import stateful as S
from tunemill.operators import tuning as T
from tunemill.plans.q_selection import table
from tunemill.session import scratch_dir
from tunemill.sources import readers as R
from tunemill.streaming import processors as P


def _series(spark, sf_dir, cut=False):
    """With `cut`, steps are numbered without one task for a user."""
    events = table(spark, sf_dir, "events")
    if cut:
        rows = Runs(events, "user_id", ["ts", "event_id"]).number("step").frame()
    else:
        rows = events.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    return rows.select(F.col("user_id").alias("run"), "step", "value", "event_id", "event_type")


def _holed(spark, sf_dir, cut=False):
    """The series with NaN and infinite values."""
    v = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 89 == 0, float("inf")).otherwise(F.col("value"))
    return _series(spark, sf_dir, cut).withColumn("value", v)


def loss_spikes(spark, sf_dir):
    return M.spikes(_holed(spark, sf_dir, cut=True)).groupBy("run").agg(F.count(F.when(F.col("spike"), 1)).alias("spikes"))


def behavior_spikes(spark, sf_dir):
    return M.behaviour_spikes(_series(spark, sf_dir, cut=True)).groupBy("run").agg(F.count(F.when(F.col("spike"), 1)).alias("spikes"))


def rolling_health(spark, sf_dir):
    # 1e-9 is added since means of two-decimal values can lie half-way between rounded ones, on either side by order of summing
    return M.rolling(_series(spark, sf_dir, cut=True)).select("run", "step", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean", "std", "cv")])


def entropy_trend(spark, sf_dir):
    return M.halves_trend(_series(spark, sf_dir), floor=10.0).select("run", "n", F.round("trend", 6).alias("trend"), "collapsed")


def divergence(spark, sf_dir):
    return M.diverging(_holed(spark, sf_dir, cut=True))


def plateau_ranges(spark, sf_dir):
    return S.plateaus(_series(spark, sf_dir), least=15)


def best_checkpoint(spark, sf_dir):
    return M.new_minima(_series(spark, sf_dir, cut=True)).filter("is_best").select("run", "step", "value")


def patience_stop(spark, sf_dir):
    rows = M.patience(_series(spark, sf_dir, cut=True), 10)
    return rows.groupBy("run").agg(F.min(F.when(F.col("stop"), F.col("step"))).alias("stop_step"), F.max("waited").cast("bigint").alias("longest_wait"))


def noise_scale(spark, sf_dir):
    return M.noise_scale(_holed(spark, sf_dir)).select("run", "n", F.round("noise_scale", 5).alias("noise_scale"))


def critical_batch(spark, sf_dir):
    return M.critical_batch(_series(spark, sf_dir), 65536)


def loss_report(spark, sf_dir):
    out = M.loss_report(_holed(spark, sf_dir))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("initial", "final")})


def token_efficiency(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("ratio", F.col("value") / F.greatest(F.col("value") + 10, F.lit(1.0)))
    w = Window.partitionBy("run").orderBy("step").rowsBetween(-99, 0)
    return rows.select("run", "step", F.round(F.avg("ratio").over(w), 6).alias("efficiency"))


def _log_lines(spark, sf_dir):
    s = _series(spark, sf_dir)
    n = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("step="), n("step"), F.lit(" loss="), F.when(F.col("event_id") % 97 == 0, "nan").otherwise(n("value")), F.when(F.col("run") % 2 == 0, F.concat(F.lit(" ce="), n("value"))).otherwise(""),
        F.lit(" lr=1e-05 tok/s="), n("event_id"), F.lit(" grad_norm="), F.when(F.col("run") % 5 == 0, "20.5").otherwise("0.5"), F.when(F.col("run") % 3 == 0, F.lit(" dt=2.0s")).otherwise(""),
    )
    return s.select("run", F.col("step").alias("no"), F.when(F.col("event_id") % 53 == 0, "saving checkpoint").otherwise(line).alias("line"))


def parse_training_log(spark, sf_dir):
    rows = M.parse_steps(_log_lines(spark, sf_dir))
    return rows.select("run", "step", F.when(~F.isnan("loss"), F.col("loss")).alias("loss"), "lr", "tokens_per_sec", "grad_norm", "step_time")


def run_summary(spark, sf_dir):
    rows = M.parse_steps(_log_lines(spark, sf_dir)).filter("not isnan(loss)")
    return M.run_summary(rows, max_steps=100)


def parse_losses(spark, sf_dir):
    """Three formats by run: step lines, JSON lines, bare numbers."""
    s = _series(spark, sf_dir)
    v = F.col("value").cast("string")
    k = F.col("run") % 3
    line = F.when(k == 0, F.concat(F.lit("step="), F.col("step"), F.lit(" | loss="), v)).when(k == 1, F.concat(F.lit('{"train/loss": '), v, F.lit(', "train/global_step": '), F.col("step"), F.lit("}"))).otherwise(v)
    return M.parse_losses(s.select("run", F.col("step").alias("no"), line.alias("line")), ["run"], "no")


def corpus_loss(spark, sf_dir):
    rows = _series(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("value").alias("loss"), (F.col("event_id") % 50 + 1).alias("tokens"))
    return M.weighted_loss(rows, ["source"]).select("source", F.round("avg_loss", 6).alias("avg_loss"), "tokens")


def _sources(spark):
    return spark.createDataFrame([("click", 2.0, 0.5), ("view", 1.0, None), ("error", 0.5, 5.0), ("absent", 1.0, 1.0)], "source string, weight double, floor double")


def eval_multi_source(spark, sf_dir):
    rows = _series(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("value").alias("loss"), (F.col("event_id") % 50 + 1).alias("tokens"))
    out = M.evaluate_sources(rows, _sources(spark))
    return out.select(F.round("composite", 6).alias("composite"), "n_regressed", "regressed")


def keep_latest_k(spark, sf_dir):
    """All but the newest three checkpoints of each run; every step is one."""
    return M.expired_checkpoints(_series(spark, sf_dir, cut=True), 3).select("run", "step")


def latest_checkpoint(spark, sf_dir):
    """The newest checkpoint with its marker."""
    rows = _series(spark, sf_dir, cut=True).select("run", "step", F.col("event_id").alias("path"), (F.col("event_id") % 3 > 0).alias("complete"))
    return R.latest_checkpoint(rows).withColumnRenamed("path", "checkpoint")


def gradient_report(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 20 == 0, 0.0).when(F.col("event_id") % 20 == 1, 1e-8).otherwise(F.col("value")))
    return M.gradient_report(rows, "event_type").withColumn("total_norm", F.round("total_norm", 4))


def weight_drift(spark, sf_dir):
    per = _series(spark, sf_dir).groupBy(F.col("run").alias("name")).agg(F.max_by("value", "step").alias("last"), F.min_by("value", "step").alias("first"))
    out = M.drift(per.select("name", F.col("last").alias("norm")), per.select("name", F.col("first").alias("norm")))
    return out.select(F.round("mean_drift", 5).alias("mean_drift"), F.round("max_drift", 5).alias("max_drift"), "n")


def layer_norms(spark, sf_dir):
    """Mean norm by layer group taken from the parameter's name, and the ratio of the largest to the smallest."""
    name = F.concat(F.lit("model.layers."), F.col("run") % 12, F.lit(".mlp.weight"))
    rows = _series(spark, sf_dir).withColumn("layer", F.regexp_extract(name, r"layers?\.(\d+)\.", 1).cast("bigint"))
    per = rows.groupBy("layer").agg(F.avg(F.abs("value")).alias("norm"))
    ratio = F.max("norm").over(Window.partitionBy()) / F.greatest(F.min("norm").over(Window.partitionBy()), F.lit(1e-8))
    return per.select("layer", F.round("norm", 5).alias("norm"), F.round(ratio, 5).alias("ratio"))


def step_metrics(spark, sf_dir):
    return P.step_windows(_series(spark, sf_dir), 10).select("run", "window", "n", F.round("mean", 5).alias("mean"))


def spike_detector_fold(spark, sf_dir):
    return S.spike_detector(_series(spark, sf_dir), z=2.0, warmup=20).select("run", "count", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"), "spikes")


def adagc_fold(spark, sf_dir):
    return S.adaptive_clip(_series(spark, sf_dir, cut=True)).select("run", "n", F.round("ema", 5).alias("ema"), "clips")


def _rounded(name, digits):
    """As the SQL rounds doubles: the scaled double to the nearest whole number, halves away from zero."""
    scaled = F.col(name) * 10.0**digits
    near = F.rint(scaled)
    return (F.when(F.abs(scaled - near) == 0.5, scaled + 0.5 * F.signum(scaled)).otherwise(near) / 10.0**digits).alias(name)


def source_weight_fold(spark, sf_dir):
    out = S.source_weights(_series(spark, sf_dir).withColumn("loss", F.col("value") + 50), source="run")
    return out.select("run", _rounded("weight", 6), _rounded("best", 4), "rises", "decays", _rounded("prob", 8))


def ema_fold(spark, sf_dir):
    return S.ramped_ema(_series(spark, sf_dir, cut=True), decay=0.9).select("run", "n", F.round("ema", 5).alias("ema"))


def _trials(spark, sf_dir):
    """One sweep per user % 20; a trial per rate, its loss a parabola in log10(lr) plus the run's mean."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("sweep"), (F.col("event_id") % 7).alias("k"), "value")
    t = e.groupBy("sweep", "k").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"))
    lr = F.pow(F.lit(10.0), -6 + F.col("k") * 0.4)
    loss = F.pow(F.log10(lr) + 4.6, 2) + 2 + F.when(F.col("sweep") % 4 == 0, F.col("m") / 10).otherwise(F.col("m") / 1000)
    return t.select("sweep", lr.alias("lr"), loss.alias("final_loss"), (F.col("k") == 6).alias("diverged"))


def parabola_fit(spark, sf_dir):
    out = T.parabola_minimum(_trials(spark, sf_dir).filter("not diverged"), ["sweep"])
    return out.select("sweep", "n", F.round(F.log10("lr_min"), 4).alias("log_lr"), F.round("r2", 5).alias("r2"))


def best_trial(spark, sf_dir):
    rows = _trials(spark, sf_dir)
    score = F.when(F.col("diverged"), F.lit(float("inf"))).otherwise(F.col("final_loss"))
    out = rows.groupBy("sweep").agg(F.min_by("lr", F.struct(score, "lr")).alias("lr"), F.count(F.when(~F.col("diverged"), 1)).alias("valid"))
    return out.select("sweep", F.round(F.log10(F.when(F.col("valid") > 0, F.col("lr")).otherwise(2e-5)), 5).alias("log_lr"), "valid")


def coarse_candidates(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 13 + 0.5).cast("double").alias("params_b"), ((F.col("event_id") % 100 + 1) * 5000).cast("double").alias("tokens"))
    out = T.coarse_candidates(runs)
    return out.select("event_id", F.round("offset", 1).alias("offset"), F.round(F.log10("lr"), 5).alias("log_lr"))


def horizon_correction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("curv", (F.col("event_id") % 21 - 10) / 50.0)
    alpha = T.horizon_exponent(F.col("curv"))
    lr = T.corrected_lr(F.lit(2e-5), F.lit(100.0), (F.col("event_id") % 200 * 37).cast("double"), alpha)
    return rows.select("event_id", F.round(alpha, 6).alias("alpha"), F.round(lr * 1e6, 6).alias("lr_micro"))


def scaling_law_lr(spark, sf_dir):
    rows, k = table(spark, sf_dir, "events"), F.col("event_id") % 300
    lr = T.scaling_law_lr((F.col("event_id") % 70 + 1).cast("double"), (k * 4096 + 4096).cast("double"), (k * 10 + 10).cast("double"))
    return rows.select("event_id", F.round(lr * 1e6, 5).alias("lr_micro"))


def early_stop(spark, sf_dir):
    rows = T.curve_points(_holed(spark, sf_dir, cut=True))
    return rows.select("run", T.early_stop(F.col("curve"), F.col("curve.n") * 2, F.lit(30.0)).alias("stop"))


def trial_scores(spark, sf_dir):
    rows, last = T.curve_points(_series(spark, sf_dir, cut=True)), F.col("curve.last")
    return rows.select("run", F.round(T.curve_curvature(F.col("curve")), 5).alias("curvature"), F.round(T.trial_score(last, F.col("curve"), F.lit(False)), 5).alias("score"), F.round(T.loss_reduction(F.col("curve.first"), last), 5).alias("reduction"))


def lr_schedule(spark, sf_dir):
    """Factor of the rate at each step of each run, as if runs had 60 steps."""
    kinds = ("cosine", "linear", "constant", "power_decay", "wsd")
    return _series(spark, sf_dir, cut=True).select("run", "step", *[F.round(T.schedule(F.col("step"), 60, k), 6).alias(k) for k in kinds])


def seq_len_curriculum(spark, sf_dir):
    step = F.col("step") * 100
    return _series(spark, sf_dir, cut=True).select("run", "step", T.curriculum_length(step, 1024, 8192, 5000).alias("max_len"), T.accumulation_at(step / 6000, 1, 16).alias("accumulation"))


def layer_lr(spark, sf_dir):
    """Each event is a parameter of some layer."""
    return table(spark, sf_dir, "events").select("event_id", F.round(T.layer_lr(1e-4, 0.9, F.col("event_id") % 33, F.lit(32)) * 1e6, 6).alias("lr_micro"))


def chunk_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("tokens"))
    return rows.select("doc_id", T.chunk_count(F.col("tokens"), 152064).alias("chunks"), T.even_chunk_count(F.col("tokens"), 152064).alias("even_chunks"))


def sweep_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("drift", (F.col("event_id") % 10) / 10.0)
    return rows.groupBy(F.col("event_type").alias("config")).agg(F.round(F.min(T.sweep_score(F.col("value"), F.col("drift"))), 4).alias("score"), F.min_by("event_id", F.struct(T.sweep_score(F.col("value"), F.col("drift")), "event_id")).alias("best"))


def lr_ablation_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("base", (F.col("event_id") % 50 + 1) * 1e-6)
    return rows.select("event_id", F.posexplode(T.lr_grid(F.col("base"))).alias("pos", "lr")).select("event_id", "pos", F.round(F.col("lr") * 1e6, 4).alias("lr_micro"))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")


def _streamed(build, mode, keys=()):
    def query(spark, sf_dir):
        return P.run_once(build(_stream(spark, sf_dir)), mode, f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}", list(keys))

    return query


def stream_spike_state(spark, sf_dir):
    build = lambda s: P.spike_states(s.withColumnRenamed("user_id", "run"), z=2.0, warmup=20)
    out = _streamed(build, "update", ["run"])(spark, sf_dir)
    return out.select("run", "count", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"), "spikes")


QUERIES = {f.__name__: f for f in (
    loss_spikes, behavior_spikes, rolling_health, entropy_trend, divergence, plateau_ranges, best_checkpoint, patience_stop, noise_scale, critical_batch, loss_report, token_efficiency, parse_training_log,
    run_summary, parse_losses, corpus_loss, eval_multi_source, keep_latest_k, latest_checkpoint, gradient_report, weight_drift, layer_norms, step_metrics, spike_detector_fold, adagc_fold, source_weight_fold,
    ema_fold, parabola_fit, best_trial, coarse_candidates, horizon_correction, scaling_law_lr, early_stop, trial_scores, lr_schedule, seq_len_curriculum, layer_lr, chunk_counts, sweep_scores, lr_ablation_grid,
)} | {
    "stream_tumbling": _streamed(P.tumbling, "complete"), "stream_sliding": _streamed(P.sliding, "complete"), "stream_session": _streamed(P.sessions, "complete"),
    "stream_spike_state": stream_spike_state,
}

_S = "s AS (SELECT user_id AS run, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS step, value AS v, event_id, event_type FROM events)"
_H = _S + ", h AS (SELECT run, step, CASE WHEN event_id % 97 = 0 THEN 'nan'::double WHEN event_id % 89 = 0 THEN 'inf'::double ELSE v END AS v, event_id FROM s)"
_FIN = "f AS (SELECT run, step, v, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM h WHERE isfinite(v))"
_LOG = _S + ", l AS (SELECT *, event_id % 53 = 0 AS gone, event_id % 97 = 0 AS bad FROM s)"
_TRIALS = """t AS (SELECT user_id % 20 AS sweep, event_id % 7 AS k, avg(value) AS m FROM events GROUP BY ALL),
    r AS (SELECT sweep, k, -6 + k * 0.4::double AS x, pow(-6 + k * 0.4::double + 4.6, 2) + 2 + CASE WHEN sweep % 4 = 0 THEN m / 10 ELSE m / 1000 END AS y, k = 6 AS diverged FROM t)"""
_FOLD = "WITH RECURSIVE {0}, f AS (SELECT {1} FROM s WHERE step = 1 UNION ALL SELECT {2} FROM f JOIN s ON s.run = f.run AND s.step = f.step + 1) "
_LAST = "(SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM f) WHERE k = 1"
_SPIKES = """WITH RECURSIVE {0}, f AS (SELECT run, step, v AS mean, 0::double AS var, 0::bigint AS spikes FROM s WHERE step = 1 UNION ALL
        SELECT run, step, CASE WHEN step <= 20 THEN mean + (x - mean) / step WHEN z < 2 THEN em ELSE mean END,
               CASE WHEN step <= 20 THEN var + (x - mean) * (x - (mean + (x - mean) / step)) WHEN z < 2 THEN 0.99::double * v0 + 0.01::double * (x - em) * (x - em) ELSE v0 END,
               CASE WHEN step > 20 AND z > 2 THEN spikes + 1 ELSE spikes END
        FROM (SELECT q.*, 0.99::double * mean + 0.01::double * x AS em, (x - mean) / greatest(CASE WHEN sqrt(v0) < 1e-8 THEN abs(mean) * 0.1 ELSE sqrt(v0) END, 1e-300) AS z
              FROM (SELECT s.run, s.step, s.v AS x, mean, var, spikes, CASE WHEN s.step = 21 THEN var / 20 ELSE var END AS v0 FROM f JOIN s ON s.run = f.run AND s.step = f.step + 1) q) y)
        SELECT run, step AS count, round(mean, 5) AS mean, round(var, 4) AS var, spikes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM f) WHERE k = 1"""
ORACLE_SQL = {
    "loss_spikes": f"WITH {_H}, {_FIN}, w AS (SELECT run, v, avg(v) OVER p AS m, count(*) OVER p AS c FROM f WINDOW p AS (PARTITION BY run ORDER BY step ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT run, count(*) FILTER (c = 20 AND m > 0 AND v > 3 * m) AS spikes FROM w GROUP BY run",
    "behavior_spikes": f"WITH {_S}, w AS (SELECT run, step, v, avg(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM s) SELECT run, count(*) FILTER (step > 20 AND v > 3 * m) AS spikes FROM w GROUP BY run",
    "rolling_health": f"WITH {_S}, w AS (SELECT run, step, count(*) OVER p AS n, avg(v) OVER p AS m, stddev_samp(v) OVER p AS d FROM s WINDOW p AS (PARTITION BY run ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT run, step, CASE WHEN n > 1 THEN round(m + 1e-9, 5) END AS mean, CASE WHEN n > 1 THEN round(d + 1e-9, 5) END AS std, CASE WHEN n > 1 THEN round(d / greatest(abs(m), 1e-8) + 1e-9, 5) END AS cv FROM w",
    "entropy_trend": f"""WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b FROM s), c AS (SELECT run, count(*) AS n, avg(v) AS m, least(count(*), 20) AS q FROM k WHERE b <= 100 GROUP BY run),
        t AS (SELECT c.run, c.n, c.m, avg(v) FILTER (b > q - q // 2) AS a, avg(v) FILTER (b <= q - q // 2) AS z FROM k JOIN c ON c.run = k.run WHERE b <= q GROUP BY ALL)
        SELECT run, n, round((z - a) / greatest(abs(a), 1e-8), 6) AS trend, m < 10 AS collapsed FROM t WHERE n >= 10""",
    "divergence": f"""WITH {_H}, {_FIN}, t AS (SELECT *, floor(n * 0.8::double) AS st, v > lag(v) OVER (PARTITION BY run ORDER BY step) AS up FROM f WHERE i >= floor(n * 0.8::double))
        SELECT run, count(*) AS tail, count(*) FILTER (up) AS rising, max(st) > 0 AND count(*) > 10 AND count(*) FILTER (up) > count(*) * 0.7 AS diverging FROM t GROUP BY run""",
    "plateau_ranges": f"""WITH RECURSIVE {_S}, c AS (SELECT run, greatest(15, count(*) // 10) AS lim, max(step) AS last FROM s GROUP BY run),
        f AS (SELECT run, step, v AS best, step AS begin_, NULL::bigint AS b, NULL::bigint AS e FROM s WHERE step = 1 UNION ALL
              SELECT s.run, s.step, CASE WHEN s.v < best * 0.999 THEN s.v ELSE best END, CASE WHEN s.v < best * 0.999 THEN s.step ELSE begin_ END,
                     CASE WHEN s.v < best * 0.999 AND s.step - begin_ > lim THEN begin_ END, CASE WHEN s.v < best * 0.999 AND s.step - begin_ > lim THEN s.step - 1 END
              FROM f JOIN s ON s.run = f.run AND s.step = f.step + 1 JOIN c ON c.run = f.run)
        SELECT run, b AS start, e AS stop FROM f WHERE b IS NOT NULL UNION ALL SELECT f.run, begin_, last FROM f JOIN c ON c.run = f.run AND c.last = f.step WHERE last + 1 - begin_ > lim""",
    "best_checkpoint": f"WITH {_S} SELECT run, step, v AS value FROM s QUALIFY v < coalesce(min(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::double)",
    "patience_stop": f"""WITH {_S}, b AS (SELECT *, v < coalesce(min(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::double) AS best FROM s),
        g AS (SELECT *, sum(best::int) OVER (PARTITION BY run ORDER BY step) AS g FROM b), w AS (SELECT run, step, row_number() OVER (PARTITION BY run, g ORDER BY step) - 1 AS w FROM g)
        SELECT run, min(step) FILTER (w >= 10) AS stop_step, max(w) AS longest_wait FROM w GROUP BY run""",
    "noise_scale": f"WITH {_H} SELECT run, count(*) AS n, CASE WHEN count(*) >= 2 AND avg(v) >= 1e-12 THEN round(count(*) * var_samp(v) / (avg(v) * avg(v)), 5) END AS noise_scale FROM h WHERE isfinite(v) GROUP BY run",
    "critical_batch": f"""WITH {_S}, a AS (SELECT run, count(*) AS n, CASE WHEN count(*) >= 10 AND avg(v) >= 1e-10 THEN var_pop(v) / (avg(v) * avg(v)) END AS r FROM s GROUP BY run),
        e AS (SELECT *, greatest(1024, least(floor(r * 0.5 * 65536), 10000000)) AS t FROM a)
        SELECT run, n, round(r, 4) AS noise_ratio, CASE WHEN r IS NOT NULL THEN cast(t AS bigint) END AS estimated_tokens,
            CASE WHEN n < 10 THEN 'insufficient_data' WHEN r IS NULL THEN 'zero_gradients' WHEN 65536 / t > 2 THEN 'batch_too_large' WHEN 65536 / t < 0.3 THEN 'batch_too_small' ELSE 'batch_optimal' END AS advice FROM e""",
    "loss_report": f"""WITH {_H}, x AS (SELECT *, nullif(v, 'nan'::double) AS w FROM h) SELECT run, count(*) AS steps, first(w ORDER BY step) AS initial, last(w ORDER BY step) AS final, coalesce(min(v) FILTER (isfinite(v)), 0) AS lowest,
        coalesce(max(v) FILTER (isfinite(v)), 0) AS highest, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf, count(*) FILTER (NOT isfinite(v)) = 0 AS healthy FROM x GROUP BY run""",
    "token_efficiency": f"WITH {_S} SELECT run, step, round(avg(v / greatest(v + 10, 1)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS efficiency FROM s",
    "parse_training_log": f"WITH {_LOG} SELECT run, step, CASE WHEN NOT bad THEN v END AS loss, 1e-05::double AS lr, event_id::double AS tokens_per_sec, CASE WHEN run % 5 = 0 THEN 20.5 ELSE 0.5 END::double AS grad_norm, CASE WHEN run % 3 = 0 THEN 2.0 ELSE 0 END::double AS step_time FROM l WHERE NOT gone",
    "run_summary": f"""WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS b, count(*) OVER (PARTITION BY run) AS n FROM l WHERE NOT gone AND NOT bad),
        a AS (SELECT run, count(*) AS n, max(step) AS cs, arg_max(v, step) AS l, arg_min(v, step) AS f, avg(v) FILTER (b <= 10) AS r,
                avg(v) FILTER (CASE WHEN n >= 20 THEN b > 10 AND b <= 20 ELSE b > n - greatest(n // 2, 1) END) AS e, avg(event_id) FILTER (b <= 10) AS tok, min(event_id) FILTER (b <= 10) AS lo, max(event_id) FILTER (b <= 10) AS hi FROM k GROUP BY run),
        t AS (SELECT *, (r - e) / greatest(e, 1e-8) AS trend, CASE WHEN run % 3 = 0 AND cs < 100 THEN (100 - cs) * 2.0::double END AS eta FROM a)
        SELECT run, CASE WHEN (trend > 0.1 AND n > 20) OR run % 5 = 0 OR (n > 5 AND lo < hi * 0.5) THEN 'WARNING' ELSE 'HEALTHY' END AS status, cs AS current_step, round(l, 4) AS current_loss, round(tok, 0) AS tokens_per_sec,
            round(trend * 100, 2) AS loss_trend_pct, n AS total_steps, round((f - l) / greatest(f, 1e-8) * 100, 1) AS improvement_pct, round(eta, 0) AS eta_seconds,
            CASE WHEN eta IS NULL THEN 'unknown' WHEN eta < 60 THEN printf('%.0fs', eta) ELSE printf('%.1fm', eta / 60) END AS eta_human FROM t""",
    "parse_losses": f"WITH {_S} SELECT run, step, v AS loss FROM s",
    "corpus_loss": "SELECT event_type AS source, round(sum(value) / greatest(sum(event_id % 50 + 1), 1), 6) AS avg_loss, cast(sum(event_id % 50 + 1) AS bigint) AS tokens FROM events GROUP BY 1",
    "eval_multi_source": """WITH p AS (SELECT event_type AS source, sum(value) / sum(event_id % 50 + 1) AS l FROM events GROUP BY 1), c(source, w, floor_) AS (VALUES ('click', 2.0::double, 0.5::double), ('view', 1.0, NULL), ('error', 0.5, 5.0), ('absent', 1.0, 1.0))
        SELECT round(sum(w * coalesce(l, 0)) / sum(w), 6) AS composite, count(*) FILTER (l > floor_) AS n_regressed, coalesce(string_agg(source, ',' ORDER BY source) FILTER (l > floor_), '') AS regressed FROM c LEFT JOIN p USING (source)""",
    "keep_latest_k": f"WITH {_S} SELECT run, step FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) > 3",
    "latest_checkpoint": f"WITH {_S} SELECT run, max(step) AS step, arg_max(event_id, step) AS checkpoint FROM s WHERE event_id % 3 > 0 GROUP BY run",
    "gradient_report": "WITH g AS (SELECT event_type, CASE event_id % 20 WHEN 0 THEN 0 WHEN 1 THEN 1e-8 ELSE value END::double AS v FROM events) SELECT event_type, count(*) FILTER (v = 0) AS dead, count(*) FILTER (v > 0 AND v < 1e-7) AS tiny, count(*) FILTER (v > 100) AS huge, round(sqrt(sum(v * v)), 4) AS total_norm FROM g GROUP BY 1",
    "weight_drift": f"WITH {_S}, p AS (SELECT arg_max(v, step) AS l, arg_min(v, step) AS f FROM s GROUP BY run), d AS (SELECT abs(l - f) / greatest(abs(f), 1e-8) AS d FROM p) SELECT round(avg(d), 5) AS mean_drift, round(max(d), 5) AS max_drift, count(*) AS n FROM d",
    "layer_norms": f"WITH {_S}, p AS (SELECT run % 12 AS layer, avg(abs(v)) AS n FROM s GROUP BY 1) SELECT layer, round(n, 5) AS norm, round(max(n) OVER () / greatest(min(n) OVER (), 1e-8), 5) AS ratio FROM p",
    "step_metrics": f"WITH {_S} SELECT run, step // 10 AS \"window\", count(*) AS n, round(avg(v), 5) AS mean FROM s GROUP BY ALL",
    "spike_detector_fold": _SPIKES.format(_S),
    "stream_spike_state": _SPIKES.format(_S.replace("ORDER BY ts, event_id", "ORDER BY event_id")),
    "adagc_fold": _FOLD.format(_S, "run, step, v AS ema, 0::bigint AS clips", "s.run, s.step, CASE WHEN s.step < 20 THEN greatest(ema, s.v) WHEN s.v < 1e-12 THEN ema ELSE 0.95::double * ema + (1 - 0.95::double) * least(s.v, 1.5 * ema) END, CASE WHEN s.step >= 20 AND s.v > 1.5 * ema THEN clips + 1 ELSE clips END") + f"SELECT run, step AS n, round(ema, 5) AS ema, clips FROM {_LAST}",
    "source_weight_fold": _FOLD.format(_S, "run, step, 1.0::double AS w, v + 50 AS best, 0::bigint AS rises, 0::bigint AS decays",
        """s.run, s.step, CASE WHEN (s.v + 50 - best) / greatest(abs(best), 1e-8) < -0.01 THEN least(w * 1.15::double, 1.0) WHEN (s.v + 50 - best) / greatest(abs(best), 1e-8) > 0.01 THEN greatest(w * 0.7::double, 0.1::double) ELSE w END,
        CASE WHEN (s.v + 50 - best) / greatest(abs(best), 1e-8) < -0.01 THEN s.v + 50 ELSE best END, CASE WHEN (s.v + 50 - best) / greatest(abs(best), 1e-8) > 0.01 THEN rises + 1 ELSE 0 END,
        CASE WHEN (s.v + 50 - best) / greatest(abs(best), 1e-8) > 0.01 THEN decays + 1 ELSE decays END""") + f"SELECT run, round(w, 6) AS weight, round(best, 4) AS best, rises, decays, round(w / sum(w) OVER (), 8) AS prob FROM {_LAST}",
    "ema_fold": _FOLD.format(_S, "run, step, v AS ema", "s.run, s.step, least(0.9::double, 1 - 1.0::double / s.step) * ema + (1 - least(0.9::double, 1 - 1.0::double / s.step)) * s.v") + f"SELECT run, step AS n, round(ema, 5) AS ema FROM {_LAST}",
    "parabola_fit": f"""WITH {_TRIALS}, o AS (SELECT sweep, count(*) AS n, avg(x) AS mx, min(x) AS lo, max(x) AS hi, avg(y) AS my FROM r WHERE NOT diverged GROUP BY sweep),
        q AS (SELECT r.sweep, n, mx, lo, hi, r.x - mx AS u, y - my AS w FROM r JOIN o USING (sweep) WHERE NOT diverged),
        m AS (SELECT sweep, n, mx, lo, hi, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(u*w) AS uw, sum(u*u*w) AS uuw, sum(w*w) AS ww FROM q GROUP BY ALL),
        ab AS (SELECT *, (uuw * s2 - uw * s3) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) AS a, (uw * (s4 - s2 * s2 / n) - uuw * s3) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) AS b FROM m),
        z AS (SELECT *, mx - b / (2 * a) AS xm, (a * uuw + b * uw) / ww AS r2 FROM ab)
        SELECT sweep, n, CASE WHEN n >= 3 AND a > 0 AND xm >= lo - 1 AND xm <= hi + 1 AND r2 >= 0.7 THEN round(xm, 4) END AS log_lr, round(r2, 5) AS r2 FROM z""",
    "best_trial": f"WITH {_TRIALS} SELECT sweep, round(arg_min(x, CASE WHEN diverged THEN 'inf'::double ELSE y END), 5) AS log_lr, count(*) FILTER (NOT diverged) AS valid FROM r GROUP BY sweep",
    "coarse_candidates": """WITH c AS (SELECT event_id, greatest(5e-6, least(5e-4, 8.5e-5 * pow(event_id % 13 + 0.5::double, -0.5) * (((event_id % 100 + 1) * 0.05::double) / pow(1 + (event_id % 100 + 1) * 0.05::double, 1.5) * pow(2.0::double, 1.5)))) AS c FROM events),
        o AS (SELECT event_id, c, unnest([-1.2, -0.6, 0.0, 0.6, 1.2])::double AS d FROM c) SELECT event_id, round(d, 1) AS "offset", round(log10(greatest(1e-7, least(5e-3, pow(10, log10(c) + d)))), 5) AS log_lr FROM o""",
    "horizon_correction": """WITH a AS (SELECT event_id, greatest(0.04::double, least(0.20::double, 0.088::double * 0.7::double + (event_id % 21 - 10) / 50.0::double * 0.5)) AS a, event_id % 200 AS m FROM events)
        SELECT event_id, round(a, 6) AS alpha, round(1e6 * CASE WHEN m * 37 <= 100 THEN 2e-5::double ELSE greatest(2e-5::double / 5, least(2e-5::double * 5, 2e-5::double * pow(100.0::double / (m * 37), a))) END, 6) AS lr_micro FROM a""",
    "scaling_law_lr": "SELECT event_id, round(1e6 * greatest(1e-6, least(1e-4, 0.003::double * pow(event_id % 70 + 1, -0.5) * pow((event_id % 300 * 4096 + 4096) / 524288.0::double, -0.12) * pow((event_id % 300 * 10 + 10) / 5000.0::double, -0.1))), 5) AS lr_micro FROM events",
    "early_stop": f"""WITH {_H}, c AS (SELECT run, list(v ORDER BY step) AS c FROM h GROUP BY run), d AS (SELECT *, len(c) AS n, c[len(c)] AS l, greatest(3, len(c) // 3) AS b FROM c)
        SELECT run, CASE WHEN NOT isfinite(l) THEN true WHEN n < 5 THEN false ELSE (n >= b AND l > c[n - b + 1] * 1.1) OR l > 30 * 1.05 OR l >= c[1] * 0.99 END AS stop FROM d""",
    "trial_scores": f"""WITH {_S}, c AS (SELECT run, list(v ORDER BY step) AS c FROM s GROUP BY run), d AS (SELECT *, len(c) AS n, CASE WHEN len(c) < 3 THEN 0 ELSE (c[1] + c[len(c)] - 2 * c[len(c) // 2 + 1]) / greatest(abs(c[1]), 1e-8) END AS k FROM c)
        SELECT run, round(k, 5) AS curvature, round(c[n] + greatest(0, k) * 0.1, 5) AS score, round(CASE WHEN c[1] <= 0 THEN '-inf'::double ELSE (c[1] - c[n]) / c[1] END, 5) AS reduction FROM d""",
    "lr_schedule": f"""WITH {_S}, t AS (SELECT run, step, least((step - 6) / 54.0::double, 1) AS p FROM s)
        SELECT run, step, round(CASE WHEN step < 6 THEN step / 6.0::double ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * p)) END, 6) AS cosine, round(CASE WHEN step < 6 THEN step / 6.0::double ELSE greatest(0.1, 1 - p * 0.9) END, 6) AS linear,
            round(CASE WHEN step < 6 THEN step / 6.0::double ELSE 1 END, 6) AS constant, round(CASE WHEN step < 6 THEN step / 6.0::double ELSE 0.1 + 0.9 * pow(1 - p, 4) END, 6) AS power_decay,
            round(CASE WHEN step < 6 THEN step / 6.0::double WHEN p < 0.8 THEN 1 ELSE 0.1 + 0.9 * pow(greatest(1 - (p - 0.8) / 0.2, 0), 4) END, 6) AS wsd FROM t""",
    "seq_len_curriculum": f"""WITH {_S}, t AS (SELECT run, step, step * 100 AS i FROM s)
        SELECT run, step, cast(CASE WHEN i >= 5000 THEN 8192 ELSE least(pow(2, floor(10 + i / 5000.0::double * 3)), 8192) END AS bigint) AS max_len, cast(greatest(1, least(16, 1 + floor(15 * (i / 6000.0::double)))) AS bigint) AS accumulation FROM t""",
    "layer_lr": "SELECT event_id, round(1e-4::double * pow(0.9::double, 32 - event_id % 33) * 1e6, 6) AS lr_micro FROM events",
    "chunk_counts": "WITH g AS (SELECT doc_id, n_chars * 152064.0::double * 4 / 1e9 AS g FROM documents) SELECT doc_id, cast(greatest(1, least(64, ceil(g / 2))) AS bigint) AS chunks, cast(least(64, pow(2, ceil(log2(greatest(1, least(64, ceil(g))))))) AS bigint) AS even_chunks FROM g",
    "sweep_scores": "WITH x AS (SELECT event_type AS config, event_id, value + CASE WHEN event_id % 10 > 3 THEN (event_id % 10) / 10.0::double ELSE 0 END AS s FROM events) SELECT config, round(min(s), 4) AS score, (array_agg(event_id ORDER BY s, event_id))[1] AS best FROM x GROUP BY config",
    "lr_ablation_grid": "SELECT event_id, cast(p AS int) AS pos, round((event_id % 50 + 1) * [0.5, 1.0, 2.0, 5.0][p + 1]::double, 4) AS lr_micro FROM events, range(4) r(p)",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_session": """WITH p AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS new FROM events),
        g AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM p)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "stream_sliding": "WITH d AS (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) SELECT CASE WHEN date_diff('day', DATE '1970-01-01', d::date) % 1 = 0 THEN d END AS start, count(*) AS n, round(avg(value), 4) AS mean FROM d GROUP BY ALL",
}
