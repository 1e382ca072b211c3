"""Global ranks and order statistics that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.session import shuffle_width, small, written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in so many low bits


def global_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with `out`, the place of each row by `order`, from 0.

    Rows are range-partitioned and sorted, written with their place within the partition, and get the sum
    of the partitions before theirs; only one row per partition meets in one task.
    """
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_row_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_row_at", _ROW_BITS)
    before = Window.orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_row_part")).count().select("_row_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_part_start"))
    ranked = placed.withColumn("_row_part", part).join(small(starts), "_row_part")
    return ranked.withColumn(out, F.col("_part_start") + F.col("_row_at") % (1 << _ROW_BITS)).drop("_row_part", "_part_start", "_row_at")


#: Rows that one task may order by a plain window or a top-k.
WINDOW_ROWS = 200_000


def first_rows(df: DataFrame, order: list[Column | str], n: int, out: str = "rank") -> DataFrame:
    """The first n rows by `order`, with their place from 0: a top-k where n fits a task, else by global_rank."""
    if n > WINDOW_ROWS:
        return global_rank(df, order, out).filter(F.col(out) < n)
    top = df.orderBy(*order).limit(max(n, 0))
    return top.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df, a written table, with the sum of `value` up to each row by `order`; no task orders more than its range."""
    if df.count() <= WINDOW_ROWS:
        return df.withColumn(out, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_row_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_row_at", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.sum(value).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("_row_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(small(starts), "_part").withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_part", "_before", "_row_at")


def nth_values(df: DataFrame, col: str, by: str | None = None, **at: float) -> DataFrame:
    """For each name, the value at index int(n * fraction) of the sorted values: one row, null without values, or one
    row per value of `by` that has any.

    Equal values meet in partial aggregation first; running counts over the distinct ones give the places."""
    keys = [by] if by else []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running_total(written(counts, "value-counts"), [*keys, "v"], "c", "_upto")
    names = lambda n, start: [F.min(F.when(F.col("_upto") - start > F.floor(n * F.lit(f)), F.col("v"))).alias(name) for name, f in at.items()]
    ends = written(upto.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("c")).alias("_start"), F.sum("c").alias("_n")), "value-ends")
    if not by:
        whole = ends.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"))
        return upto.crossJoin(F.broadcast(whole)).agg(*names(F.col("_n"), F.lit(0)))
    return upto.join(small(ends.withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by"))).groupBy(by).agg(*names(F.col("_n"), F.col("_start")))


def seeded(id_col: str, seed: int) -> Column:
    """A repeatable random order: the hash of id and seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
