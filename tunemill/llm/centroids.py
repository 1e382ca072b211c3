"""Centroid clustering in integers: single-precision products choose, exact integers decide.

Each component x becomes floor(64 * x). To find a vector's nearest centroid, one single-precision matrix product of a
block of vectors by all centroids gives |c|^2 - 2 x.c, which orders the centroids as the distance does. Whatever the
order of its additions, a single-precision product of n terms is within (n + 2) u / (1 - (n + 2) u) * |x| |c| of the true
one, u = 2**-24, where two more roundings stand for turning the numbers into single precision. So each value is known to lie in an
interval. A centroid stays in the choice if its interval begins no later than the earliest end of any; where more than one
stays, their distances are computed in 64-bit integers, and the least one wins, of equal ones the centroid of the
smallest number. The result is that of exact arithmetic, however blocks, threads or machines add up.

A round is one pass over the vectors. A task keeps one sum per centroid, so what it sends and what the driver gets, the
next centroids, is of the size of the centroids and not of the table. Hot centroids are sums like any other.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are not clustered. Nor
are those with an integer component beyond LARGEST, as their distances do not fit a long. The first centroids are the
vectors with the smallest hash of the id (null ids last, equal ids by the vector), so repeated rows may be
centroids more than once, of which the smallest number gets all; a table of fewer vectors has fewer centroids. Repeated
and null ids stay separate rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.workers import releasing
from tunemill.session import written

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Of a component's amount: then 64 squared differences stay below 2**62.
LARGEST = 1 << 27
#: Vectors of a block, for one matrix product.
BLOCK = 4096
_U = 2.0**-24


def integer_vectors(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and their integer components, one row each."""
    lengths = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).cast(pa.float64()).to_numpy(zero_copy_only=False)), nan=-1)
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), size)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(x * SCALE)
        fine = np.isfinite(scaled).all(axis=1) & (np.abs(scaled) <= LARGEST).all(axis=1)
    return rows[fine], scaled[fine].astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each integer vector, the number of its nearest centroid and the squared distance, and how many vectors the product alone did not decide."""
    number, tied = np.zeros(len(x), np.int64), 0
    if len(centroids) > 1:
        n = x.shape[1] + 2
        gamma = n * _U / (1 - n * _U)
        c_norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        x_norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        product = x.astype(np.float32) @ centroids.astype(np.float32).T
        value = c_norm**2 - 2.0 * product.astype(np.float64)
        # the norms, squares and differences here are double: 2**-40 of what enters them is far above their error
        error = 2 * gamma * np.outer(x_norm, c_norm) * (1 + 2.0**-20) + (c_norm**2 + 2 * np.outer(x_norm, c_norm)) * 2.0**-40
        chosen = value - error <= (value + error).min(axis=1, keepdims=True)
        number = chosen.argmax(axis=1)
        row, which = np.nonzero(chosen & (chosen.sum(axis=1) > 1)[:, None])
        if len(row):
            d = ((x[row] - centroids[which]) ** 2).sum(axis=1)
            best = np.lexsort((which, d, row))
            first = np.concatenate([[True], row[best][1:] != row[best][:-1]])
            number[row[best][first]] = which[best][first]
            tied = int(first.sum())
    return number, ((x - centroids[number]) ** 2).sum(axis=1), tied


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            rows, x = integer_vectors(part.column(1), size)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def _first(vectors: DataFrame, k: int, size: int, seed: str) -> np.ndarray:
    """The first centroids: of each task its k vectors of smallest hash, of these the k smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[bool, str, tuple[int, ...]]] = []
        for digests, x in _blocks(batches, size):
            keys = [(d is None, d or "") for d in digests.to_pylist()]
            last = max(heapq.nsmallest(k, keys), default=(True, ""))
            best = heapq.nsmallest(k, [*best, *((*key, tuple(v.tolist())) for key, v in zip(keys, x, strict=True) if key <= last)])
        digests, lists = [d for _, d, _ in best], [v for _, _, v in best]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in best], pa.bool_()), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["without", "digest", "v"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    kept = vectors.select(digest, "v").mapInArrow(releasing(run), "without boolean, digest string, v array<long>")
    rows = kept.orderBy("without", "digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), size)


def _moved(vectors: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """The centroids after one round: exact floors of the means, empty ones as they were."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.zeros((k, size), np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, size):
            number, _, _ = nearest(x, centroids)
            for c in np.unique(number):
                mine = x[number == c]
                count[c] += len(mine)
                low[c] += mine.sum(axis=0)  # of one block: below 2**40
            high += low >> 32  # so that neither part can overflow, however many blocks a task has
            low &= 0xFFFFFFFF
        c, i = np.divmod(np.flatnonzero(np.repeat(count > 0, size)), size)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(count[c]), pa.array(high[c, i]), pa.array(low[c, i])], names=["cluster", "i", "n", "high", "low"])

    sums = vectors.mapInArrow(releasing(run), "cluster long, i long, n long, high long, low long")
    whole = [F.sum(F.col(part).cast("decimal(20,0)")).alias(part) for part in ("high", "low")]
    out = centroids.copy()
    for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), *whole).collect():
        out[r.cluster, r.i] = ((int(r.high) << 32) + int(r.low)) // r.n
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED
) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Sums of distances beyond a long are null. `centroids` and `size` bound what tasks and driver keep."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    at = _first(rows, centroids, size, seed)
    for _ in range(rounds if len(at) else 0):
        at = _moved(rows, at, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, size):
            number, distance, _ = nearest(x, at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(releasing(run), f"vec_id {kind}, cluster int, distance long"), "clustered")
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    total = fit(sum(sums.values()))
    table = [(c, fit(d), total, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for c, d in sorted(sums.items())]
    known = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
