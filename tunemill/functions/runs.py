"""Windows over runs of any length: a run that is too long for one task is cut into blocks of rows in order.

Runs of up to `limit` rows use a plain window. The rows of longer ones are range-partitioned by run and order, so that one
run spans as many tasks as it needs, and get their number within the run. A frame of so many preceding rows is then a window
over a block and as many rows of the block before, which are copied; a frame without an end is a window over a block, with
what the blocks before give carried in. Either way gives the same rows. Keys and orders may be null; rows that are equal in
all order columns have one arbitrary order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tunemill.session import shuffle_width, small, written

#: Rows of a run from which it is cut, and of a block.
RUN_ROWS = 200_000
_ROW_BITS = 33
_FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
}


class Runs:
    """Rows in order within runs. Methods give new Runs with one more column; frame() gives the rows."""

    def __init__(self, df: DataFrame, run: str | list[str], order: str | list[str], limit: int = RUN_ROWS):
        self.keys = [run] if isinstance(run, str) else run
        self.order = [order] if isinstance(order, str) else order
        self.limit = limit
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        hot = written(counts, "hot-runs")
        total = hot.agg(F.sum("_n").alias("n")).first().n
        self.cold, self.hot = df, None
        if total:
            marked = self._join(df, hot.drop("_n").withColumn("_hot", F.lit(True)), self.keys)
            self.cold = marked.filter("_hot is null").drop("_hot")
            self.hot = self._numbered(marked.filter("_hot").drop("_hot"), int(total))

    def _join(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """left join, null keys too; right has one row for each key."""
        renamed = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        return left.join(small(renamed), same, "left").drop(*(f"_k{i}" for i in range(len(keys))))

    def _numbered(self, rows: DataFrame, total: int) -> DataFrame:
        """rows as a written table, with _no, the number within the run from 0, and _block."""
        by = [*self.keys, *self.order]
        ranged = rows.repartitionByRange(max(shuffle_width(rows.sparkSession), -(-total // self.limit)), *by).sortWithinPartitions(*by)
        placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "hot-rows").withColumn("_part", F.shiftright("_at", _ROW_BITS))
        sizes = placed.groupBy(*self.keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*self.keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
        placed = self._join(placed, written(starts, "run-starts"), [*self.keys, "_part"])
        return placed.withColumn("_no", F.col("_at") + F.col("_shift")).withColumn("_block", F.expr(f"_no div {self.limit}")).drop("_at", "_part", "_shift")

    def _with(self, cold: DataFrame, hot: DataFrame | None) -> Runs:
        out = object.__new__(Runs)
        out.keys, out.order, out.limit, out.cold, out.hot = self.keys, self.order, self.limit, cold, hot
        return out

    def number(self, out: str) -> Runs:
        """The row's number within its run, from 1."""
        cold = self.cold.withColumn(out, F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order)).cast("bigint"))
        return self._with(cold, None if self.hot is None else self.hot.withColumn(out, F.col("_no") + 1))

    def near(self, before: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> Runs:
        """Columns over a window in order, whose frames begin at most `before` rows before the current one and end there at the latest."""
        cold = self.cold.withColumns(columns(Window.partitionBy(*self.keys).orderBy(*self.order)))
        if self.hot is None:
            return self._with(cold, None)
        if before > self.limit:
            raise ValueError(f"a frame of {before} rows is longer than a block of {self.limit}")
        also = F.when(F.col("_no") % self.limit >= self.limit - before, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        both = self.hot.withColumn("_next", F.explode(also)).withColumn("_block", F.col("_block") + F.col("_next"))
        both = both.withColumns(columns(Window.partitionBy(*self.keys, "_block").orderBy("_no")))
        return self._with(cold, both.filter("_next = 0").drop("_next"))

    def running(self, out: str, fold: str, value: Column, current: bool = True) -> Runs:
        """min, max or sum of the value over all rows of the run up to this one, with or without it; nulls do not count."""
        aggregate, combine = _FOLDS[fold]
        frame = (Window.unboundedPreceding, 0 if current else -1)
        cold = self.cold.withColumn(out, aggregate(value).over(Window.partitionBy(*self.keys).orderBy(*self.order).rowsBetween(*frame)))
        if self.hot is None:
            return self._with(cold, None)
        earlier = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = self.hot.groupBy(*self.keys, "_block").agg(aggregate(value).alias("_v"))
        carried = written(sums.select(*self.keys, "_block", aggregate("_v").over(earlier).alias("_carried")), "carried")
        within = aggregate(value).over(Window.partitionBy(*self.keys, "_block").orderBy("_no").rowsBetween(*frame))
        hot = self._join(self.hot.withColumn("_within", within), carried, [*self.keys, "_block"])
        return self._with(cold, hot.withColumn(out, combine(F.col("_carried"), F.col("_within"))).drop("_carried", "_within"))

    def select(self, columns: dict[str, Column]) -> Runs:
        """Columns of each row by itself."""
        return self._with(self.cold.withColumns(columns), None if self.hot is None else self.hot.withColumns(columns))

    def frame(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("_no", "_block"))
