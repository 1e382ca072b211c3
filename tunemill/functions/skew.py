"""A join whose left side may repeat a key without bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.session import small, written

#: Left rows of a key from which it counts as hot. At most rows / HOT keys can be.
HOT = 20_000


def hot_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: int = HOT, many: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row for each key; how is inner or left.

    `many` names the keys with over `hot` left rows, without repeats, where the caller has counted them already.

    Keys that many rows of left share are not shuffled: their few right rows are sent to left's tasks. All others
    meet by a shuffle, in which no key has more than `hot` rows. Should there be too many hot keys to send, they are
    shuffled in as many shares as there are salts.
    """
    if many is None:
        many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
    rows = written(right.join(many.select(*keys), keys, "left_semi"), "hot-keys")
    if rows.isEmpty():
        return left.join(right, keys, how)
    values = [c for c in right.columns if c not in keys]
    known = rows.withColumn("_hot", F.lit(True))
    near = small(known)
    if near is known:
        salts = 64
        marked = left.withColumn("_salt", (F.rand(7) * salts).cast("int"))
        near = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        marked = marked.join(near, [*keys, "_salt"], "left").drop("_salt")
    else:
        marked = left.join(near, keys, "left")
    hot_rows = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", *values).join(right, keys, how)
    return hot_rows.unionByName(rest)
