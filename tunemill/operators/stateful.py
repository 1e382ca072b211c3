"""Ordered folds over a key's values: the state machines of training.

Rows are dealt by key and sorted by (key, order); each task walks through its rows and keeps one small state, so a run
of any length needs no more memory than a short one. Averages whose steps are maps of one number need no walk: the rows of
a long run are cut into blocks, each block's steps are composed to one map, and the maps are applied in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions.runs import RUN_ROWS, Runs
from tunemill.session import small, written

INF = float("inf")
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def ordered_fold(
    rows: DataFrame, key: str, order: str, values: list[str], start: tuple, step: Callable[..., tuple], done: Callable[[tuple], list[tuple]], out: str, leaving: Callable[..., tuple | None] | None = None
) -> DataFrame:
    """key and the columns `out` ("name bigint|double, ..."): what done() gives of each key's last state.

    step(state, *values) gives the next state; leaving(state, *values), if there is one, gives a row that is told before
    that step, or None. Rows with a null value are skipped; keys may be null."""
    names = [c.split() for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, told, kind = None, None, [], None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in told], kind)] + [pa.array([r[i + 1] for r in told], _KINDS[k]) for i, (_, k) in enumerate(names)]
            return pa.RecordBatch.from_arrays(columns, names=[key, *(n for n, _ in names)])

        for b in batches:
            kind = b.schema.field(0).type
            for k, *v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or k != now:
                    told += [(now, *r) for r in done(state)] if state is not None else []
                    now, state = k, start
                row = leaving(state, *v) if leaving else None
                if row is not None:
                    told.append((now, *row))
                state = step(state, *v)
                if len(told) >= 10_000:
                    yield batch()
                    told.clear()
        if state is not None:
            told += [(now, *r) for r in done(state)]
        if told:
            yield batch()

    kept = rows.select(key, F.col(order).alias("_o"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values))).na.drop(subset=[f"_v{i}" for i in range(len(values))])
    walk = kept.repartition(key).sortWithinPartitions(key, "_o", *(f"_v{i}" for i in range(len(values)))).drop("_o")
    return walk.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {out}")


#: count, mean, variance (squared deviations while warming up), spikes
SPIKE_START = (0, 0.0, 0.0, 0)


def spike_step(state: tuple, x: float, z: float, warmup: int, decay: float) -> tuple:
    """Running mean and squared deviations for `warmup` values, then moving averages; values from z standard deviations
    on do not update them; over z they are spikes."""
    count, mean, var, spikes = state
    count += 1
    if count <= warmup:
        new = x if count == 1 else mean + (x - mean) / count
        return count, new, 0.0 if count == 1 else var + (x - mean) * (x - new), spikes
    if count == warmup + 1:
        var /= max(count - 1, 1)
    std = var**0.5
    score = (x - mean) / max(std if std >= 1e-8 else abs(mean) * 0.1, 1e-300)
    if score < z:
        mean = decay * mean + (1 - decay) * x
        var = decay * var + (1 - decay) * (x - mean) ** 2
    return count, mean, var, spikes + (score > z)


def spike_detector(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", z: float = 5.0, warmup: int = 50, decay: float = 0.99) -> DataFrame:
    """Per run: count, mean, var and the number of spikes after all values."""
    one = lambda s: [(s[0], float(s[1]), float(s[2]), int(s[3]))]
    return ordered_fold(series, run, step, [value], SPIKE_START, lambda s, x: spike_step(s, x, z, warmup, decay), one, "count bigint, mean double, var double, spikes bigint")


def _blocks(hot: DataFrame, run: str) -> DataFrame:
    return hot.withColumn("_key", F.struct(F.col(run).alias("run"), F.col("_block").alias("block")))


def _unpacked(maps: DataFrame, run: str) -> DataFrame:
    return maps.select(F.col("_key.run").alias(run), F.col("_key.block").alias("_block"), *(c for c in maps.columns if c != "_key"))


class Knots:
    """A map of one number by its values at some places, linear between them, and how often each part was clipped on the way.

    Each step is a map of one number itself, monotone and linear on either side of one value: a place where the map
    reaches that value becomes a knot. A map that has forgotten its start, up to rounding, keeps its ends only."""

    def __init__(self, low: float, high: float):
        self.at = np.array([low, high])
        self.to = self.at.copy()
        self.clips = np.zeros(1)

    def bend(self, value: float) -> None:
        """Makes the place where the map takes this value a knot, if it lies between two."""
        k = int(np.searchsorted(self.to, value, "right"))
        if 0 < k < len(self.to) and self.to[k - 1] < value < self.to[k]:
            share = (value - self.to[k - 1]) / (self.to[k] - self.to[k - 1])
            place = self.at[k - 1] + share * (self.at[k] - self.at[k - 1])
            self.at, self.to, self.clips = np.insert(self.at, k, place), np.insert(self.to, k, value), np.insert(self.clips, k, self.clips[k - 1])

    def most(self, x: float) -> None:
        """The greater of the map and x."""
        self.bend(x)
        self.to = np.maximum(self.to, x)

    def clipped_average(self, x: float, limit: float, beta: float) -> None:
        self.bend(x / limit)
        self.clips = self.clips + (self.to[1:] <= x / limit) * (self.to[:-1] < x / limit)
        self.to = beta * self.to + (1 - beta) * np.minimum(x, limit * self.to)
        if len(self.at) > 2 and self.to[-1] - self.to[0] <= 1e-15 * self.to[-1] and (self.clips == self.clips[0]).all():
            self.at, self.to, self.clips = self.at[[0, -1]], self.to[[0, -1]], self.clips[:1]

    def kept(self) -> tuple[list[float], list[float], list[float]]:
        return self.at.tolist(), self.to.tolist(), self.clips.tolist()


def adaptive_clip(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", warmup: int = 20, limit: float = 1.5, beta: float = 0.95, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per tensor: the threshold average and the number of clipped norms. Its largest norm while warming up, then
    an average of norms clipped at `limit` times it; norms that are nearly zero are skipped.

    A tensor of over `run_rows` norms, all finite and one of the first above zero, is cut into blocks, whose maps are
    piecewise linear; others are walked."""

    def fold(state: tuple, x: float) -> tuple:
        n, ema, clips = state
        ema = x if ema is None else ema
        if n + 1 < warmup:
            return n + 1, max(ema, x), clips
        if x < 1e-12:
            return n + 1, state[1], clips
        return n + 1, beta * ema + (1 - beta) * min(x, limit * ema), clips + (x > limit * ema)

    out = "n bigint, ema double, clips bigint"
    last = lambda s: [(s[0], s[1], int(s[2]))]
    walked = lambda rows: ordered_fold(rows, run, step, [value], (0, None, 0), fold, last, out)
    runs = Runs(series.filter(F.col(value).isNotNull() & F.col(step).isNotNull()), run, [step, value], run_rows)
    if runs.hot is None:
        return walked(runs.cold)
    v = F.col(value)
    finite = (F.abs(v) < INF) & ~F.isnan(v)
    ends = runs.hot.groupBy(F.col(run).alias("_of")).agg(F.min(F.when(v >= 1e-12, v)).alias("_low"), F.max(v).alias("_high"), F.max(F.when(F.col("_no") < max(warmup - 1, 1), v)).alias("_first"), F.min(finite).alias("_fine"))
    ends = ends.select("_of", F.least("_low", "_first").alias("_low"), F.greatest("_high", "_first").alias("_high"), (F.col("_fine") & (F.col("_first") > 0) & (limit >= 1)).alias("_fine"))
    hot = runs.hot.join(small(written(ends, "run-ends")), F.col(run).eqNullSafe(F.col("_of"))).drop("_of")

    def along(m: Knots | None, no: int, x: float, low: float, high: float) -> Knots:
        m = m or Knots(low, high)
        if no == 0:
            m.to = np.full(len(m.to), x)
        if no + 1 < warmup:
            m.most(x)
        elif x >= 1e-12:
            m.clipped_average(x, limit, beta)
        return m

    maps = ordered_fold(_blocks(hot.filter("_fine"), run), "_key", "_no", ["_no", value, "_low", "_high"], (), lambda s, *v: along(s or None, *v), lambda m: [m.kept()], "at array<double>, to array<double>, clips array<double>")
    sizes = hot.groupBy(F.col(run).alias("_of"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    maps = written(_unpacked(maps, run), "maps").join(sizes, F.col(run).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b")))

    def through(state: tuple, at: list[float], to: list[float], clips: list[float], size: int) -> tuple:
        n, ema, sum_of = state
        ema = at[0] if ema is None else ema
        part = min(max(int(np.searchsorted(at, ema, "right")) - 1, 0), len(clips) - 1)
        return n + size, float(np.interp(ema, at, to)), sum_of + clips[part]

    done = ordered_fold(maps, run, "_block", ["at", "to", "clips", "_size"], (0, None, 0), through, last, out)
    return walked(runs.cold.unionByName(hot.filter("not _fine").select(*runs.cold.columns))).unionByName(done)


def source_weights(evals: DataFrame, source: str = "source", step: str = "step", loss: str = "loss", weight: float = 1.0, decay: float = 0.7, recovery: float = 1.15, floor_ratio: float = 0.1, plateau: float = 0.01) -> DataFrame:
    """Per source: weight, best loss, consecutive rises and decays after all evaluations; prob over all sources."""

    def fold(state: tuple, x: float) -> tuple:
        now, best, rises, decays = state
        if best is None:
            return now, x, rises, decays
        change = (x - best) / max(abs(best), 1e-8)
        if change < -plateau:
            return min(now * recovery, weight), x, 0, decays
        if change > plateau:
            return max(now * decay, weight * floor_ratio), best, rises + 1, decays + 1
        return now, best, 0, decays

    out = ordered_fold(evals, source, step, [loss], (weight, None, 0, 0), fold, lambda s: [s], "weight double, best double, rises bigint, decays bigint")
    total = out.agg(F.sum("weight").alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("prob", F.col("weight") / F.col("_total")).drop("_total")


def source_summary(weights: DataFrame, source: str = "source", original: float = 1.0) -> DataFrame:
    """Per source a short and a detailed line of its state; `short` of all joined by " | " is the one-line summary."""
    ratio = F.format_string("%.0f%%", F.bround(F.col("weight") / original * 100, 0))
    short = F.concat(F.col(source).cast("string"), F.lit("="), ratio, F.when(F.col("rises") == 0, "↑").otherwise(F.concat(F.lit("↓"), F.col("rises"))))
    status = F.when(F.col("rises") == 0, "improving").otherwise(F.concat(F.lit("overfitting×"), F.col("rises")))
    # format_string rounds the shortest decimals of a double, halves up; this rounds the double itself
    four = F.udf(lambda x: f"{x:.4f}" if x is not None else None, "string")
    best = F.when(F.col("best").isNull(), "no eval").otherwise(F.concat(F.lit("best="), four("best")))
    detail = F.concat(F.rpad(F.col(source).cast("string"), 20, " "), F.lit(": weight="), four("weight"), F.lit(" ("), ratio, F.lit(" of original), "), status, F.lit(", "), best, F.lit(", decays="), F.col("decays"))
    return weights.select(source, short.alias("short"), detail.alias("detail"))


def ramped_ema(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", decay: float = 0.999, run_rows: int = RUN_ROWS) -> DataFrame:
    """Moving average whose decay ramps up: min(decay, 1 - 1 / (t + 1)). A run of over `run_rows` values is cut into blocks, each a linear map."""

    def fold(state: tuple, x: float) -> tuple:
        n, ema = state
        d = min(decay, 1 - 1 / (n + 1))
        return n + 1, d * ema + (1 - d) * x

    out = "n bigint, ema double"
    runs = Runs(series.filter(F.col(value).isNotNull() & F.col(step).isNotNull()), run, [step, value], run_rows)
    cold = ordered_fold(runs.cold, run, step, [value], (0, 0.0), fold, lambda s: [s], out)
    if runs.hot is None:
        return cold

    def along(state: tuple, no: int, x: float) -> tuple:
        n, factor, rest = state
        d = min(decay, 1 - 1 / (no + 1))
        return n + 1, d * factor, d * rest + (1 - d) * x

    maps = ordered_fold(_blocks(runs.hot, run), "_key", "_no", ["_no", value], (0, 1.0, 0.0), along, lambda s: [s], "size bigint, factor double, rest double")
    through = lambda s, size, factor, rest: (s[0] + size, (factor * s[1] if factor else 0.0) + rest)
    return cold.unionByName(ordered_fold(written(_unpacked(maps, run), "maps"), run, "_block", ["size", "factor", "rest"], (0, 0.0), through, lambda s: [s], out))


def plateaus(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", least: int = 50) -> DataFrame:
    """Per run: ranges of steps without a gain of 0.1 % that are longer than max(least, n / 10)."""
    rows = series.filter(~F.isnan(value) & (F.abs(value) < INF))

    # the number of values, the best one, and where its range began and stands: place, step, last step
    def fold(state: tuple | None, s: int, v: float) -> tuple:
        n, best, begin, at, _ = state
        if n == 0 or v < best * 0.999:
            return n + 1, v, n, s, s
        return n + 1, best, begin, at, s

    ended = lambda state: (state[3], state[4], state[0] - state[2]) if state[0] - state[2] > least else None
    leaving = lambda state, s, v: ended(state) if state[0] and v < state[1] * 0.999 else None
    found = ordered_fold(rows, run, step, [step, value], (0, INF, 0, 0, 0), fold, lambda s: [r] if (r := ended(s)) else [], "start bigint, stop bigint, length bigint", leaving)
    sizes = rows.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    return found.join(sizes, F.col(run).eqNullSafe(F.col("_run"))).filter(F.col("length") > F.floor(F.col("_n") / 10)).select(run, "start", "stop")


def behaviour_signals(series: DataFrame, run: str = "run", step: str = "step", value: str = "value", window: int = 20, factor: float = 3.0) -> DataFrame:
    """Per run: steps that signal collapse (three troubles or more, at a value that is not finite) or a lower rate (at
    any other such value, and at a spike once there are five troubles), and the troubles that are left at the end.

    A trouble is a value that is not finite, or over `factor` times the mean of the last `window` finite ones with
    itself; each healthy value takes one back until there are over `window` finite ones. Window functions find the
    troubles, so that the fold carries one number."""
    bad = F.isnan(value) | (F.abs(value) == INF)
    w = Window.partitionBy(run, "_bad").orderBy(step)
    rows = series.withColumn("_bad", bad)
    spike = (F.row_number().over(w) > window) & (F.col(value) > factor * F.avg(value).over(w.rowsBetween(-window + 1, 0)))
    kind = F.when(F.col("_bad"), 2).when(spike, 1).when(F.row_number().over(w) > window, 0).otherwise(-1)

    def fold(state: tuple, k: int) -> tuple:
        troubles, collapse, lower = state
        troubles = max(0, troubles - 1) if k < 0 else troubles + (k > 0)
        return troubles, collapse + (k == 2 and troubles >= 3), lower + (k == 2 and troubles < 3 or k == 1 and troubles >= 5)

    out = ordered_fold(rows.withColumn("_kind", kind), run, step, ["_kind"], (0, 0, 0), fold, lambda s: [tuple(map(int, s))], "troubles bigint, n_collapse bigint, n_reduce bigint")
    return out
