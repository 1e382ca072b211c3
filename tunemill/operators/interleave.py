"""Weighted interleaving of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.functions.ranks import global_rank
from tunemill.session import small, written


def interleave(rows: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows of the weighted sources in proportion, until the first of them runs out: source, key, place.

    The k-th row of a source (by id) has the key (k + 1/2) / weight. Sources without rows or weight drop out.
    The ordinal is the global place minus the source's first place, so no window holds a whole source."""
    by = [x for s, w in weights.items() if w > 0 for x in (F.lit(s), F.lit(float(w)))]
    if not by:
        return rows.limit(0).withColumn("key", F.lit(0.0)).withColumn("place", F.lit(0).cast("bigint"))
    weighted = rows.withColumn("_w", F.try_element_at(F.create_map(*by), F.col(source_col))).filter("_w is not null")
    ranked = written(global_rank(weighted, [F.asc(source_col), F.asc(id_col)], "_at"), "interleave")
    first = ranked.groupBy(source_col).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.max("_w").alias("_weight"))
    stop = first.agg(F.min((F.col("_last") - F.col("_first") + 0.5) / F.col("_weight")).alias("_stop"))
    keyed = ranked.join(small(written(first.drop("_weight", "_last").crossJoin(stop), "interleave-first")), source_col)
    keyed = keyed.withColumn("key", (F.col("_at") - F.col("_first") + 0.5) / F.col("_w")).filter(F.col("key") <= F.col("_stop"))
    return global_rank(keyed.drop("_at", "_first", "_stop", "_w"), [F.asc("key"), F.asc(source_col), F.asc(id_col)], "place")


def replay(main: DataFrame, other: DataFrame, share: float, id_col: str = "doc_id") -> DataFrame:
    """Interleaves `other` into `main` with the share of replayed rows."""
    both = main.withColumn("source", F.lit("main")).unionByName(other.withColumn("source", F.lit("replay")), allowMissingColumns=True)
    return interleave(both, {"main": 1 - share, "replay": share}, id_col)
