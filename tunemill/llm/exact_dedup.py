"""Exact de-duplication by skew-safe combining.

Rows meet in three steps: Spark's map-side aggregation removes equal texts within a task, groups keyed
by (digest, salt, text) merge what the tasks kept, and groups keyed by (digest, text) combine the salt
winners. The text itself is part of the key in every step, so two texts are equal only if they are equal
byte for byte; the digest only spreads them. A group of copies, however large, reaches the last step as
at most one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.llm.names import fresh
from tunemill.session import small, written

#: At most 62, since the salts that hold a text are kept as bits of a long.
SALTS = 16


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_text,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. Of equal texts the largest id is kept; a null id is kept only if all ids
    of its group are null. Rows that repeat both id and text share one fate and count in group_size. Other
    columns are not read. An empty table gives an empty result. `digest` may collide: colliding texts are
    told apart by their content.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"), salt.alias("salt"))

    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("held"),
    )
    winners = written(groups.select("digest", "keep_id", "group_size", "held"), "exact-winners")

    # A join by digest is right where the comparison above found one text to a digest, which is checked here.
    collided = not winners.groupBy("digest").count().filter("count > 1").isEmpty()
    if collided:
        out = rows.join(groups.select("digest", "text", "keep_id", "group_size"), ["digest", "text"])
    else:
        in_salts = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("held", s) == 1)
        by_salt = winners.select("digest", "keep_id", "group_size", F.explode(in_salts).alias("salt"))
        out = rows.select("doc_id", "digest", "salt").join(by_salt, ["digest", "salt"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; all columns stay as they are."""
    kind = docs.schema[id_col].dataType.simpleString()
    groups = written(exact_groups(docs, id_col, text_col, salts), "exact-groups")
    own_digest, gone_digest, gone_id = fresh(docs, "_digest", "_dropped", "_id")
    dropped = small(written(groups.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)), "exact-dropped"))
    marked = docs.withColumn(own_digest, sha256_text(F.coalesce(F.col(text_col), F.lit(""))))
    same = (F.col(own_digest) == F.col(gone_digest)) & F.col(id_col).cast(kind).eqNullSafe(F.col(gone_id))
    left = marked.join(dropped, same, "left_anti")
    if not groups.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, own_digest])  # rows that repeat both id and text
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
