"""Difficulty buckets, filters, hold-outs, selection under a budget, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions import ranks
from tunemill.functions.ranks import first_rows, global_rank, nth_values, seeded
from tunemill.session import small, written

INF = float("inf")


def classify_difficulty(scored: DataFrame, col: str = "response_ppl", easy: float = 25.0, hard: float = 75.0) -> DataFrame:
    """easy up to the lower percentile, hard from the upper one on, else medium; thresholds see finite scores only."""
    ends = nth_values(scored.filter((F.col(col) < INF)), col, _easy=easy / 100, _hard=hard / 100)
    bucket = F.when(F.col(col) <= F.col("_easy"), "easy").when(F.col(col) >= F.col("_hard"), "hard").otherwise("medium")
    return scored.crossJoin(F.broadcast(ends)).withColumn("bucket", bucket).drop("_easy", "_hard")


def removal_reason(score: Column, length: Column, min_ppl: float = 1.5, max_ppl: float = 500.0, min_length: int = 10, max_length: int = 32768) -> Column:
    """The first rule that removes a sample, or null. NaN passes the score rules; max_ppl <= 0 turns its rule off."""
    known = ~F.isnan(score)
    reason = F.when(known & (score < min_ppl), "too_easy")
    if max_ppl > 0:
        reason = reason.when(known & (score > max_ppl), "too_hard")
    return reason.when(length < min_length, "too_short").when(length > max_length, "too_long")


def filter_samples(scored: DataFrame, use: str = "response", **limits: float) -> DataFrame:
    score = F.coalesce("response_ppl", "ppl") if use == "response" else F.col("ppl")
    return scored.withColumn("reason", removal_reason(F.coalesce(score, F.lit(INF)), F.coalesce(F.col("length"), F.lit(0)), **limits))


def holdout(samples: DataFrame, n: int, id_col: str = "sample", seed: int = 42) -> DataFrame:
    """held_out: a repeatable random n rows; none if n <= 0 or n reaches the number of rows."""
    total = samples.count()
    if n <= 0 or n >= total:
        return samples.withColumn("held_out", F.lit(False))
    return global_rank(samples, [seeded(id_col, seed), F.col(id_col)], "_turn").withColumn("held_out", F.col("_turn") < n).drop("_turn")


def _top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows: a top-k while one task can order them, else by ranks over ranges, of which no task has them all."""
    if n <= ranks.WINDOW_ROWS:
        return rows.orderBy(*order).limit(max(n, 0))
    return first_rows(rows, order, n, "_place").drop("_place")


def random_subset(samples: DataFrame, n: int, id_col: str = "sample", seed: int = 42) -> DataFrame:
    return _top(samples, [seeded(id_col, seed), F.asc(id_col)], n)


def optimal_mix(budget: int) -> tuple[float, float, float, float]:
    """Shares of easy, medium, hard and very hard samples. Fixed values."""
    if budget < 2_000:
        return 0.35, 0.50, 0.15, 0.00
    if budget < 10_000:
        return 0.25, 0.50, 0.20, 0.05
    return 0.20, 0.50, 0.25, 0.05


def select_optimal(samples: DataFrame, budget: int, id_col: str = "sample", ppl: str = "response_ppl") -> DataFrame:
    """A budget over the difficulty buckets, filled up from medium, easy, hard where a bucket is short.

    Adds flow_weight. Within a bucket a higher `ifd` comes first (1.0 where missing), then arrival; very hard
    are the hardest of the hard bucket. No bucket gives more than the budget, so no more of it is ordered."""
    easy, medium, hard, _ = optimal_mix(budget)
    quota = {"easy": int(budget * easy), "medium": int(budget * medium), "hard": int(budget * hard)}
    very_hard = budget - sum(quota.values())
    ifd = F.coalesce(F.col("ifd"), F.lit(1.0)) if "ifd" in samples.columns else F.lit(1.0)
    rows = samples.withColumn("_ifd", ifd)
    by_ifd = [F.desc("_ifd"), F.asc(id_col)]
    pool = None
    for bucket in ("easy", "medium"):
        part = first_rows(rows.filter(F.col("bucket") == bucket), by_ifd, budget, "_place").withColumn("_first", F.col("_place") < quota[bucket])
        pool = part if pool is None else pool.unionByName(part)
    in_hard = rows.filter(F.col("bucket") == "hard")
    top = written(first_rows(in_hard, [F.desc(ppl), F.asc(id_col)], very_hard, "_place").withColumn("_first", F.lit(True)), "very-hard")
    others = in_hard.join(small(top.select(id_col)), id_col, "left_anti")
    rest = first_rows(others, [F.desc("_ifd"), F.desc(ppl), F.asc(id_col)], quota["hard"], "_place").withColumn("_first", F.lit(True))
    spare = first_rows(others, by_ifd, budget, "_place").withColumn("_first", F.lit(False))
    once = written(rest, "hard")
    pool = pool.unionByName(top).unionByName(once).unionByName(spare.join(small(once.select(id_col)), id_col, "left_anti").select(*spare.columns))
    turn = F.when(F.col("_first"), 0).otherwise(F.expr("decode(bucket, 'medium', 1, 'easy', 2, 3)"))
    chosen = first_rows(pool.withColumn("_turn", turn).drop("_place", "_first"), [F.asc("_turn"), *by_ifd], budget, "_place").drop("_place", "_turn", "_ifd")
    return _flow(written(chosen, "chosen"), ppl, F.round)


def _flow(rows: DataFrame, ppl: str, last=lambda c, _: c) -> DataFrame:
    tau = nth_values(rows, ppl, _tau=0.5)
    return rows.crossJoin(F.broadcast(tau)).withColumn("flow_weight", last(F.exp(-F.col(ppl) / F.greatest(F.col("_tau"), F.lit(1e-6))), 4)).drop("_tau")


def select_by_budget(samples: DataFrame, budget: int, strategy: str = "optimal", id_col: str = "sample", ppl: str = "response_ppl", seed: int = 42) -> DataFrame:
    """`budget` rows by strategy; all rows as they are if there are no more."""
    if budget >= samples.count():
        return samples
    if strategy == "optimal":
        return select_optimal(samples, budget, id_col, ppl)
    if strategy == "flow":
        return _top(_flow(samples, ppl), [F.desc("flow_weight"), F.asc(id_col)], budget)
    if strategy == "balanced":
        each = budget // 3
        parts = {b: first_rows(samples.filter(F.col("bucket") == b), [F.asc(id_col)], budget, "_place") for b in ("easy", "medium", "hard")}
        low = parts["easy"].filter(F.col("_place") < each).unionByName(parts["hard"].filter(F.col("_place") < each))
        mid = parts["medium"]
        left = budget - low.count() - min(each, mid.count())
        return low.unionByName(mid.filter(F.col("_place") < each + left)).drop("_place")
    if strategy == "medium_focus":
        rows = samples.crossJoin(F.broadcast(nth_values(samples, ppl, _mid=0.5)))
        return _top(rows, [F.asc(F.abs(F.col(ppl) - F.col("_mid"))), F.asc(id_col)], budget).drop("_mid")
    if strategy == "curriculum":
        return first_rows(samples, [F.asc(ppl), F.asc(id_col)], budget, "score_rank")
    if strategy == "hard_focus":
        return _top(samples, [F.desc(ppl), F.asc(id_col)], budget)
    return random_subset(samples, budget, id_col, seed)


def source_manifest(samples: DataFrame, weights: DataFrame | None = None, ppl: str = "response_ppl") -> DataFrame:
    """Per source: rows, upper-median score, bucket counts, overfit risk, normalised weight, epoch multiplier; where the samples
    have `hes`, also median_hes, the upper median of those above zero, 0 without any."""
    counts = samples.groupBy("source").agg(
        F.count(F.lit(1)).alias("num_samples"), *[F.count(F.when(F.col("bucket") == b, 1)).alias(f"n_{b}") for b in ("easy", "medium", "hard")]
    )
    median = nth_values(samples, ppl, by="source", median=0.5)
    rows = counts.join(median, "source")
    rows = rows.join(weights, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else rows.withColumn("weight", F.lit(1.0))
    more = []
    if "hes" in samples.columns:
        hes = nth_values(samples.filter("hes > 0"), "hes", by="source", median_hes=0.5)
        rows = rows.join(hes, "source", "left")
        more = [F.round(F.coalesce("median_hes", F.lit(0.0)), 2).alias("median_hes")]
    total = rows.agg(F.sum("weight").alias("total"))
    risk = F.when(F.col("median") < 5, "high").when(F.col("median") < 20, "medium").otherwise("low")
    return rows.crossJoin(F.broadcast(total)).select(
        "source", "num_samples", "n_easy", "n_medium", "n_hard", F.round("median", 2).alias("median_ppl"), risk.alias("overfit_risk"),
        F.round(F.col("weight") / F.col("total"), 4).alias("normalized_weight"), F.when(risk == "high", 0.5).when(risk == "medium", 1.0).otherwise(1.5).alias("epoch_multiplier"), *more,
    )


def prepared_manifest(samples: DataFrame, ppl: str = "response_ppl") -> DataFrame:
    """One row: counts by bucket and the score's least, median, largest and mean finite value."""
    finite = F.when(F.abs(F.col(ppl)) < INF, F.col(ppl))
    stats = samples.agg(
        F.count(F.lit(1)).alias("num_samples"), *[F.count(F.when(F.col("bucket") == b, 1)).alias(f"n_{b}") for b in ("easy", "medium", "hard")],
        F.round(F.min(finite), 2).alias("min_ppl"), F.round(F.max(finite), 2).alias("max_ppl"), F.round(F.avg(finite), 2).alias("mean_ppl"),
    )
    return stats.crossJoin(nth_values(samples.withColumn("_v", finite).filter("_v is not null"), "_v", median_ppl=0.5))
