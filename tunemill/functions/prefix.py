"""Running sums over a whole table without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Children of one inner node of the tree of partial sums, as bits.
FAN_BITS = 10


def bits_for(groups: int) -> int:
    return max(0, (max(1, int(groups)) - 1).bit_length())


def _before(level: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """level has keys, _id, _v; gives keys, _id, _before: the sum of _v at smaller ids of the same keys."""
    rows = (Window.unboundedPreceding, -1)
    if bits <= FAN_BITS:
        w = Window.partitionBy(*keys).orderBy("_id").rowsBetween(*rows)
        return level.select(*keys, "_id", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_before"))
    level = level.withColumn("_up", F.shiftright("_id", FAN_BITS))
    above = level.groupBy(*keys, "_up").agg(F.sum("_v").alias("_v")).withColumnRenamed("_up", "_id")
    above = _before(above, keys, bits - FAN_BITS).withColumnRenamed("_id", "_up").withColumnRenamed("_before", "_base")
    w = Window.partitionBy(*keys, "_up").orderBy("_id").rowsBetween(*rows)
    return level.join(above, [*keys, "_up"]).select(*keys, "_id", (F.col("_base") + F.coalesce(F.sum("_v").over(w), F.lit(0))).alias("_before"))


def prefix_sums(df: DataFrame, keys: list[str], slot: str, slot_bits: int, groups: int, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys that come earlier by (slot, *order).

    `slot` is a long in [0, 2**slot_bits), spread evenly; its leading bits cut each key's rows into about
    `groups` groups. A window runs within one such group only, and a tree of partial sums gives what stands
    before it, so that a key with a third of all rows is spread like any other rows. Keys are not null.
    """
    bits = min(bits_for(groups), slot_bits)
    leaf = df.withColumn("_id", F.shiftright(slot, slot_bits - bits) if bits else F.lit(0).cast("long"))
    sums = leaf.groupBy(*keys, "_id").agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys, "_id").orderBy(slot, *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = leaf.join(_before(sums, keys, bits), [*keys, "_id"])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_id", "_before")
