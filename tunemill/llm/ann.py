"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the normalised vectors on a few random axes, shifts them, and gives each
vector the Hilbert key of its cell. Spark range-partitions the rows by (curve, key); a row's rank along a
curve puts it in a block. A query is compared with the blocks around its own on every curve, a fixed share of
all rows, since a window of fixed length finds less the more rows there are; the windows of all curves merge, and the best are ranked by the exact cosine.

Equal vectors form one class, found once and searched once, so that a vector that many rows share adds
neither candidates nor searches; each class carries as many of its smallest ids as an answer can hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.session import shuffle_width, small, written

CURVES, AXES, AXIS_BITS = 8, 8, 7
#: Least and most rows of a curve in a block; a query sees its own block and one or more on either side.
BLOCK, MOST_BLOCK = 4096, 32768
#: The share of all rows that a query's blocks on one curve hold at least.
WINDOW = 0.12
#: Most blocks that are searched as one group, to which a query is sent once; a block's vectors take at most 8 MB for 64 components.
GROUP = 16


def window(n: int) -> tuple[int, int]:
    """Rows of a block, and blocks on either side of a query's own, for n rows."""
    block = max(BLOCK, min(MOST_BLOCK, math.ceil(n * WINDOW / 3)))
    return block, max(1, math.ceil((n * WINDOW / block - 1) / 2))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of cells (n x axes, values below 2**bits), as int64."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the larger cells
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_axes(curve: int, dim: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes (dim x axes) and the shift, in cells of the unit interval, of one curve."""
    rng = np.random.default_rng([seed, curve])
    basis, _ = np.linalg.qr(rng.standard_normal((dim, min(axes, dim))))
    return basis, rng.random(basis.shape[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same two rows give the same value in any batch."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    curves: int = CURVES,
    block: int | None = None,
    seed: int = 3,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by cosine, ties to the smaller id.

    Queries are the rows for which is_query(id) holds; candidates are all rows but the query's own. Ids are
    long and not null. Vectors that are null, zero, hold a null or non-finite component, or have another length than
    most take no part, nor do rows without id. Rows that repeat an id count as one candidate each. Fewer than
    k candidates give fewer rows; an empty table gives an empty result. Recall depends on curves x window
    against the number of rows; the README has figures. The window is a share of the rows, or with `block` 3 blocks of so many.
    """
    spark, keep = vectors.sparkSession, k + 1
    vec = F.col(vec_col)
    fine = vec.isNotNull() & F.col(id_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.xxhash64(vec).alias("k1"), F.xxhash64(F.lit(1), vec).alias("k2"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = length.n
    rows = rows.filter(F.size("vec") == dim)
    asked = rows.filter(is_query(F.col("id"))).select("id", "k1", "k2")
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("turn") <= keep)
    classes = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec"))
    classes = classes.join(asked.select("k1", "k2").distinct().withColumn("asked", F.lit(True)), ["k1", "k2"], "left")
    classes = written(classes.select("k1", "k2", F.element_at("ids", 1).alias("class"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "vec"), "ann-classes")
    block, reach = (block, 1) if block else window(classes.count())
    together = max(1, min(GROUP, reach // 2))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(_matrix(batch.column(1), dim))
            for c in range(curves):
                basis, shift = curve_axes(c, dim, AXES, seed)
                at = (v @ basis) * (np.sqrt(dim) / 8) + 0.5  # four standard deviations of a random direction to either side
                cells = np.clip((at + shift / 8) / 1.125 * (1 << AXIS_BITS), 0, (1 << AXIS_BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array(hilbert_keys(cells, AXIS_BITS)), batch.column(0), batch.column(2)], names=["curve", "key", "class", "asked"]
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            at = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = curve == c
                at[own] = seen.get(int(c), 0) + np.arange(own.sum())
                seen[int(c)] = seen.get(int(c), 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(at), batch.column(2), batch.column(3)], names=["curve", "part", "at", "class", "asked"])

    keyed = classes.select("class", "vec", "asked").mapInArrow(keys, "curve int, key long, class long, asked boolean")
    ordered = keyed.repartitionByRange(shuffle_width(spark), "curve", "key", "class").sortWithinPartitions("curve", "key", "class")
    ordered = written(ordered.mapInArrow(number, "curve int, part int, at long, class long, asked boolean"), "ann-ranks")
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("curve", "part").count().select("curve", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    ranked = ordered.join(small(written(starts, "ann-starts")), ["curve", "part"]).withColumn("block", F.expr(f"(start + at) div {block}"))
    spread = ranked.join(classes.select("class", "vec"), "class")
    own = F.array(F.struct(F.expr(f"block div {together}").alias("group"), F.lit(False).alias("q")))
    groups = F.expr(f"sequence(greatest(block - {reach}, 0) div {together}, (block + {reach}) div {together})")
    sent = F.concat(own, F.transform(groups, lambda g: F.struct(g.alias("group"), F.lit(True).alias("q"))))
    spread = spread.withColumn("to", F.explode(F.when(F.col("asked"), sent).otherwise(own))).select("curve", "to.group", "to.q", "block", "class", "vec")

    def search(table: pa.Table) -> pa.Table:
        q, blocks = table.column("q").to_numpy(), table.column("block").to_numpy()
        ids, v = table.column("class").to_numpy(), _matrix(table.column("vec"), dim)
        asked, found, score = np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)
        askers = np.flatnonzero(q)
        for b in np.unique(blocks[~q]) if len(askers) else ():
            ci = np.flatnonzero(~q & (blocks == b))
            ci = ci[np.argsort(ids[ci], kind="stable")]
            cu, most = _unit(v[ci]), min(keep + 4, len(ci))
            near_b = askers[np.abs(blocks[askers] - b) <= reach]
            parts = [(asked, found, score)]
            for lo in range(0, len(near_b), 256):
                qi = near_b[lo : lo + 256]
                near = _unit(v[qi]) @ cu.T
                least = np.partition(near, len(ci) - most, axis=1)[:, len(ci) - most]
                at, best = np.nonzero(near >= least[:, None] - 1e-12)
                value = cosines(v[qi[at]], v[ci[best]])
                order = np.lexsort((ids[ci[best]], -value, at))  # all that are equal at the cut-off meet here, and the smaller ids stay
                at, best, value = at[order], best[order], value[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < keep
                parts.append((ids[qi[at[kept]]], ids[ci[best[kept]]], value[kept]))
            asked, found, score = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((found, -score, asked))
            asked, found, score = asked[order], found[order], score[order]
            kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < keep
            asked, found, score = asked[kept], found[kept], score[kept]
        return pa.table({"asked": asked, "class": found, "score": score})

    found = spread.groupBy("curve", "group").applyInArrow(search, "asked long, class long, score double")
    found = found.groupBy("asked", "class").agg(F.max("score").alias("score"))
    best = found.withColumn("turn", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "class"))).filter(F.col("turn") <= keep)
    ids = best.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("id"))
    ids = ids.withColumn("turn", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))).filter(F.col("turn") <= keep)
    answers = ids.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "score"))).alias("near")).withColumnRenamed("asked", "class")
    queries = asked.withColumnRenamed("id", "query_id").join(classes.filter("asked").select("k1", "k2", "class"), ["k1", "k2"]).join(answers, "class")
    others = F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("pos", "near")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("near.id").alias("vec_id"), F.col("near.score").alias("score"))
