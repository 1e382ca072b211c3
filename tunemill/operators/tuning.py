"""Learning-rate sweep mathematics, schedules and curricula as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.functions.ranks import global_rank
from tunemill.functions.runs import RUN_ROWS, Runs
from tunemill.session import small, written

INF = float("inf")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def surge_factor(tokens: Column, peak_at: float = 100_000.0) -> Column:
    r = tokens / peak_at
    return r / F.pow(1 + r, 1.5) * (2.0**1.5)


def coarse_candidates(runs: DataFrame, params_b: str = "params_b", tokens: str = "tokens") -> DataFrame:
    """Five log-spaced rates around the scaling-law centre, clamped."""
    center = clamp(8.5e-5 * F.pow(params_b, -0.5) * surge_factor(F.col(tokens)), 5e-6, 5e-4)
    offsets = F.array(*[F.lit(x) for x in (-1.2, -0.6, 0.0, 0.6, 1.2)])
    return runs.withColumn("center", center).withColumn("offset", F.explode(offsets)).withColumn("lr", clamp(F.pow(F.lit(10.0), F.log10("center") + F.col("offset")), 1e-7, 5e-3))


def curve_points(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", limit: int = RUN_ROWS) -> DataFrame:
    """For each run, what the scores of its curve need: run, and `curve` with n, first, mid, back (the value a third of the
    curve before the end, three steps at least) and last. Values are taken by their number within the run, so no task holds a
    whole curve. Runs without rows have none; a null value stays null."""
    rows = Runs(series.select(F.col(run).alias("_run"), F.col(step).alias("_step"), F.col(value).alias("_v")), "_run", ["_step", "_v"], limit).number("_i").frame()
    counts = written(rows.groupBy("_run").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_run", "_of"), "curve-lengths")
    at = {"first": F.lit(1), "mid": F.expr("n div 2 + 1"), "back": F.expr("n - least(greatest(3, n div 3), n) + 1"), "last": F.col("n")}
    picked = rows.join(small(counts), F.col("_run").eqNullSafe(F.col("_of"))).filter(reduce(Column.__or__, (F.col("_i") == p for p in at.values())))
    points = [F.max(F.when(F.col("_i") == p, F.col("_v"))).alias(name) for name, p in at.items()]
    return picked.groupBy("_run").agg(F.max("n").alias("n"), *points).select(F.col("_run").alias(run), F.struct("n", *at).alias("curve"))


def curve_curvature(curve: Column) -> Column:
    n, first, mid, last = (curve[c] for c in ("n", "first", "mid", "last"))
    return F.when(n < 3, F.lit(0.0)).otherwise((first + last - 2 * mid) / F.greatest(F.abs(first), F.lit(1e-8)))


def trial_score(final: Column, curve: Column, diverged: Column) -> Column:
    bad = diverged | F.isnan(final) | (F.abs(final) == INF)
    return F.when(bad, F.lit(INF)).otherwise(final + F.greatest(F.lit(0.0), curve_curvature(curve)) * 0.1)


def loss_reduction(initial: Column, final: Column) -> Column:
    return F.when((initial <= 0) | F.isnan(final) | (F.abs(final) == INF), F.lit(-INF)).otherwise((initial - final) / initial)


def parabola_minimum(trials: DataFrame, keys: list[str], lr: str = "lr", loss: str = "final_loss") -> DataFrame:
    """Per sweep: the minimum of a least-squares parabola of loss over log10(lr), or null if there is none to trust.

    One aggregation gives the sums of the normal equations; Cramer's rule and the fit's R^2 follow from them.
    Trials must be filtered for divergence. Needs three points, a > 0, a minimum within a decade and R^2 >= 0.7."""
    x, y = F.log10(lr), F.col(loss)
    s = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("x1"), F.sum(x * x).alias("x2"), F.sum(x * x * x).alias("x3"), F.sum(x * x * x * x).alias("x4"),
        F.sum(y).alias("y0"), F.sum(x * y).alias("xy"), F.sum(x * x * y).alias("xxy"), F.sum(y * y).alias("yy"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    )
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]}) - {m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]}) + {m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    d = F.expr(det(["x4", "x3", "x2", "x3", "x2", "x1", "x2", "x1", "n"]))
    a = F.expr(det(["xxy", "x3", "x2", "xy", "x2", "x1", "y0", "x1", "n"])) / F.when(F.abs(d) >= 1e-15, d)
    b = F.expr(det(["x4", "xxy", "x2", "x3", "xy", "x1", "x2", "y0", "n"])) / F.when(F.abs(d) >= 1e-15, d)
    s = s.withColumn("a", a).withColumn("b", b).withColumn("c", F.expr("(y0 - a * x2 - b * x1) / n")).withColumn("x_min", F.expr("-b / (2 * nullif(a, 0))"))
    rest = F.expr("yy - 2 * (a * xxy + b * xy + c * y0) + a*a*x4 + 2*a*b*x3 + (b*b + 2*a*c) * x2 + 2*b*c*x1 + n*c*c")
    spread = F.expr("yy - y0 * y0 / n")
    s = s.withColumn("r2", F.when(spread > 1e-15, 1 - rest / spread).otherwise(0.0))
    fine = (F.col("n") >= 3) & (F.col("a") > 0) & (F.col("x_min") >= F.col("lo") - 1) & (F.col("x_min") <= F.col("hi") + 1) & (F.col("r2") >= 0.7)
    return s.select(*keys, "n", F.when(fine, F.pow(F.lit(10.0), "x_min")).alias("lr_min"), "r2")


def horizon_exponent(curvature: Column | None) -> Column:
    return F.lit(0.088) if curvature is None else F.coalesce(clamp(F.lit(0.088 * 0.7) + curvature * 0.5, 0.04, 0.20), F.lit(0.088))


def corrected_lr(lr: Column, sweep_steps: Column, full_steps: Column, exponent: Column, up: float = 5.0) -> Column:
    moved = lr * F.pow(sweep_steps / full_steps, exponent)
    return F.when(full_steps <= sweep_steps, lr).otherwise(F.greatest(lr / 5, F.least(lr * up, moved)))


def scaling_law_lr(params_b: Column, tokens: Column, steps: Column) -> Column:
    return clamp(0.003 * F.pow(params_b, -0.5) * F.pow(tokens / 524288, -0.12) * F.pow(steps / 5000, -0.10), 1e-6, 1e-4)


def early_stop(curve: Column, total_steps: Column, best: Column) -> Column:
    n, last = curve["n"], curve["last"]
    bad = F.isnan(last) | (F.abs(last) == INF)
    rising = (n >= F.greatest(F.lit(3), F.floor(n / 3))) & (last > curve["back"] * 1.1)
    worse = (n >= F.floor(total_steps / 2)) & (last > best * 1.05)
    stuck = (n >= F.floor(total_steps / 4)) & (last >= curve["first"] * 0.99)
    waiting = n < F.greatest(F.lit(5), F.floor(total_steps / 4))
    return F.when(n == 0, F.lit(False)).when(bad, True).when(waiting, False).otherwise(rising | worse | stuck)


def schedule(step: Column, total: int, kind: str, warmup_ratio: float = 0.1, least: float = 0.1) -> Column:
    """Factor of the peak rate at a step: linear warm-up, then cosine, linear, constant, power_decay or wsd."""
    warm = int(total * warmup_ratio)
    p = F.least((step - warm) / max(1, total - warm), F.lit(1.0))
    tail = {
        "constant": F.lit(1.0),
        "cosine": least + (1 - least) * 0.5 * (1 + F.cos(math.pi * p)),
        "power_decay": least + (1 - least) * F.pow(1.0 - p, 4.0),
        "wsd": F.when(p < 0.8, 1.0).otherwise(least + (1 - least) * F.pow(F.greatest(1.0 - (p - 0.8) / (1.0 - 0.8), F.lit(0.0)), 4.0)),
        "linear": F.greatest(F.lit(least), 1 - p * (1 - least)),
    }[kind]
    return F.when(step < warm, step / max(1, warm)).otherwise(tail)


def curriculum_length(step: Column, shortest: int, longest: int, ramp: int) -> Column:
    lo, hi = math.log2(shortest), math.log2(longest)
    return F.when(step >= ramp, longest).otherwise(F.least(F.pow(F.lit(2.0), F.floor(lo + step / max(1, ramp) * (hi - lo))), F.lit(longest))).cast("bigint")


def layer_lr(lr: float, decay: float, layer: Column, layers: Column) -> Column:
    return lr * F.pow(F.lit(decay), layers - layer)


def accumulation_at(progress: Column, start: int, end: int) -> Column:
    """Accumulation that ramps from start to end with the run's progress."""
    return F.greatest(F.lit(start), F.least(F.lit(end), start + F.floor((end - start) * progress))).cast("bigint")


def chunk_count(tokens: Column, vocab: int, target_gb: float = 2.0, most: int = 64) -> Column:
    """Chunks of the loss so that one chunk's 32-bit logits stay within the target."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(tokens * float(vocab) * 4 / 1e9 / target_gb))).cast("bigint")


def even_chunk_count(tokens: Column, vocab: int, target_gb: float = 1.0, most: int = 64) -> Column:
    """chunk_count rounded up to a power of two."""
    return F.least(F.lit(most), F.pow(F.lit(2.0), F.ceil(F.log2(chunk_count(tokens, vocab, target_gb, most).cast("double"))))).cast("bigint")


def sweep_score(val_loss: Column, drift: Column, limit: float = 0.3) -> Column:
    """Validation loss, with drift added where it is over the limit; infinity stays."""
    return F.when(drift > limit, val_loss + drift).otherwise(val_loss)


def lr_grid(base: Column) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 5.0)]), lambda f: base * f)


# Bytes of optimiser state to a parameter, shares that train or stay in memory, and the overhead of all.
OPTIMIZER_BYTES = {"adamw": 12, "muon": 4, "adamw8bit": 6, "paged_adamw8bit": 6, "lion8bit": 2}
TRAINED_SHARE, SELECTIVE_SHARE, OVERHEAD = 0.30, 0.4, 1.10


def memory_estimate(runs: DataFrame) -> DataFrame:
    """runs with their parameters and the peak memory of a device in GB, part by part; all from columns of the settings:

    hidden, layers, heads, intermediate, vocab, seq_len, batch, optimizer, freeze, release (gradients freed at once),
    accumulation, checkpointing (none, selective or full), selective_diff, loss_chunks (0: not chunked), device_gb."""
    c = {n: F.col(n).cast("double") for n in ("hidden", "layers", "heads", "intermediate", "vocab", "seq_len", "batch")}
    gb = lambda x: x / 1e9
    layer = 4 * c["hidden"] * c["hidden"] + 3 * c["hidden"] * c["intermediate"] + 2 * c["hidden"]
    rows = runs.withColumn("params", (c["layers"] * layer + 2 * c["vocab"] * c["hidden"]).cast("bigint"))
    trained = F.when(F.col("freeze"), F.floor(F.col("params") * F.lit(TRAINED_SHARE))).otherwise(F.col("params"))
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in OPTIMIZER_BYTES.items() for x in p]), F.col("optimizer")), F.lit(12))
    kept = c["batch"] * c["seq_len"] * (c["hidden"] * 20 + c["heads"] * 128)
    stored = F.when(F.col("checkpointing") == "none", c["layers"]).when(F.col("checkpointing") == "selective", c["layers"] * SELECTIVE_SHARE).otherwise(F.lit(2.0))
    stored = F.when(F.col("selective_diff") & F.col("freeze"), stored * TRAINED_SHARE).otherwise(stored)
    chunk = F.when(F.col("loss_chunks") > 0, F.floor(c["seq_len"] / F.col("loss_chunks"))).otherwise(c["seq_len"])
    parts = {
        "params_gb": gb(F.col("params") * 2), "optimizer_gb": gb(trained * state), "gradient_gb": F.when(F.col("release") & (F.col("accumulation") <= 1), 0.0).otherwise(gb(trained * 2)),
        "activation_gb": gb(kept * stored), "loss_gb": gb(c["batch"] * chunk * c["vocab"] * 4),
    }
    rows = rows.withColumns(parts)
    rows = rows.withColumn("total_gb", sum((F.col(p) for p in parts), F.lit(0.0)) * OVERHEAD)
    return rows.withColumn("fits", F.col("total_gb") <= F.col("device_gb"))


def ablation_order(results: DataFrame, loss: str = "val_loss", name: str = "name") -> DataFrame:
    """results with their place, the lowest loss first; failed ones (null, NaN) last."""
    known = F.when(~F.isnan(loss), F.col(loss))
    return global_rank(results, [known.asc_nulls_last(), F.asc(name)], "place")


def run_trials(spark: SparkSession, rates: list[float], steps: int, trial: Callable[[float, int], dict]) -> DataFrame:
    """One row per rate (lr, final_loss, diverged) of trials that a callable runs on the driver; one that raises counts
    as diverged."""
    rows = []
    for lr in rates:
        try:
            got = trial(lr, steps)
            rows.append((float(lr), float(got["final_loss"]), bool(got.get("diverged", False))))
        except (ArithmeticError, RuntimeError, ValueError):
            rows.append((float(lr), INF, True))
    return spark.createDataFrame(rows, "lr double, final_loss double, diverged boolean")
