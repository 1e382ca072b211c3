"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.functions.skew import hot_safe_join
from tunemill.session import written

#: Links of a node, or nodes of a label, from which it counts as hot.
HOT = 20_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for every node of a link the smallest node it can reach. Nodes are not null.

    Every round each node takes the smallest label among its neighbours' and then its label's label, so the
    rounds grow with the logarithm of a path's length. Labels are written to the shared folder each round.
    A hub of many links, or a label that many nodes have, is not shuffled to one task.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("to")).union(links.select(F.col(b).alias("node"), F.col(a).alias("to")))
    both = written(both.filter("node <> to").distinct(), "links")
    hubs = None
    if both.count() > HOT:
        hubs = written(both.groupBy("to").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("to"), "hubs")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("component")), "labels")
    while True:
        near = labels.select(F.col("node").alias("to"), F.col("component").alias("near"))
        seen = both.join(near, "to") if hubs is None else hot_safe_join(both, near, ["to"], "inner", many=hubs)
        seen = seen.groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        if hubs is not None:
            step = written(step, "steps")
        step = step.join(jump, "new") if hubs is None else hot_safe_join(step, jump, ["new"], "inner", HOT)
        step = written(step.select("node", "old", F.least("new", "further").alias("component")), "labels")
        if step.filter("component <> old").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")
