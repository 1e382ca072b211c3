"""Ordering by similarity within bounded chunks, and neighbours over the whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.functions.ranks import global_rank, seeded
from tunemill.operators.sequence import kept_in_worker
from tunemill.session import written

#: Vectors that one tour sees.
CHUNK = 10_000


def _unit(pdf: pd.DataFrame, vec_col: str) -> np.ndarray:
    v = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def chunked(vectors: DataFrame, id_col: str = "vec_id", chunk: int = CHUNK, seed: int | None = None) -> DataFrame:
    """chunk: neighbours by id, or at random with a seed."""
    order = [F.asc(id_col)] if seed is None else [seeded(id_col, seed), F.asc(id_col)]
    return global_rank(vectors, order, "_at").withColumn("chunk", F.expr(f"_at div {chunk}")).drop("_at")


#: Pivots, rings of a pivot's cell, rows of the sample that both are taken from, and bytes of the queries that one pass sends.
PIVOTS, RINGS, SAMPLE, QUERY_BYTES = 32, 4, 2048, 24 << 20
#: What bounds of angles and cosines allow for rounding.
_SLACK = 1e-6


def _units(ids: pa.Array, column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that take part, in order of id; `size` is the number of components, None that of the first row with any."""
    lengths = np.nan_to_num(np.asarray(pc.list_value_length(column).cast(pa.float64()).to_numpy(zero_copy_only=False)), nan=-1)
    some = lengths[lengths > 0]
    size = int(some[0]) if size is None and len(some) else size or 1
    rows = np.flatnonzero((lengths == size) & np.asarray(ids.is_valid()))
    x = np.asarray(column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), size)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        fine = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
    rows, x = rows[fine], x[fine] / norm[fine]
    own = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return own[order], x[order]


@dataclass(frozen=True)
class Cells:
    """Parts of the unit sphere: each vector belongs to its nearest pivot's cell and there to a ring of angles. For each cell, the
    least and the largest angle of its vectors to every pivot."""

    pivots: np.ndarray
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1.0, 1.0))

    def cell(self, angles: np.ndarray) -> np.ndarray:
        near = angles.argmin(axis=1)
        return near * (len(self.edges) + 1) + np.searchsorted(self.edges, angles[np.arange(len(angles)), near])

    def bounds(self, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell, the least and the largest cosine that the triangle inequality leaves; none for an empty cell."""
        gap = np.zeros((len(angles), len(self.low)))
        reach = np.full_like(gap, np.pi)
        for j in range(angles.shape[1]):
            a = angles[:, j, None]
            np.maximum(gap, np.maximum(self.low[None, :, j] - a, a - self.high[None, :, j]), out=gap)
            np.minimum(reach, a + self.high[None, :, j], out=reach)
        empty = self.low[:, 0] > self.high[:, 0]
        least, most = np.cos(np.clip(reach + _SLACK, 0, np.pi)) - _SLACK, np.cos(np.clip(gap - _SLACK, 0, np.pi)) + _SLACK
        least[:, empty], most[:, empty] = np.inf, -np.inf
        return least, most


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Of the sample the first row, then always the one farthest from those chosen."""
    chosen, far = [0], np.clip(sample @ sample[0], -1, 1)
    while len(chosen) < min(n, len(sample)):
        at = int(far.argmin())
        chosen.append(at)
        far = np.maximum(far, sample @ sample[at])
    return sample[chosen]


def _cells(rows: DataFrame, sample: np.ndarray, block: int) -> Cells:
    pivots = _pivots(sample, PIVOTS)
    nearest = np.arccos(np.clip(sample @ pivots.T, -1, 1)).min(axis=1)
    edges = np.quantile(nearest, np.arange(1, RINGS) / RINGS)
    n, k, size = len(pivots) * RINGS, len(pivots), sample.shape[1]
    none = Cells(pivots, edges, np.full((n, k), np.inf), np.full((n, k), -np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = none.low.copy(), none.high.copy()
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                angles = none.angles(_units(part.column(0), part.column(1), size)[1])
                cell = none.cell(angles)
                np.minimum.at(low, cell, angles)
                np.maximum.at(high, cell, angles)
        cell, pivot = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pivot), pa.array(low[cell, pivot]), pa.array(high[cell, pivot])], names=["cell", "pivot", "low", "high"])

    ends = rows.mapInArrow(run, "cell bigint, pivot bigint, low double, high double").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = none.low.copy(), none.high.copy()
    for r in ends.collect():
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return Cells(pivots, edges, low, high)


@dataclass
class _Found:
    """What a task knows of each query: vectors in the band, the nearest one and its similarity, and vectors compared."""

    ids: np.ndarray
    x: np.ndarray
    least: np.ndarray
    most: np.ndarray
    count: np.ndarray
    best: np.ndarray
    near: np.ndarray
    compared: np.ndarray

    def meet(self, q: slice, ids: np.ndarray, x: np.ndarray, low: float, high: float) -> None:
        """Compares some queries with some vectors, which are in order of id."""
        s = np.round(self.x[q] @ x.T, 9)
        s[self.ids[q][:, None] == ids[None, :]] = -np.inf
        self.count[q] += ((s >= low) & (s <= high)).sum(axis=1)
        self.compared[q] += len(ids)
        self.closer(q, s, ids)

    def closer(self, q: slice, s: np.ndarray, ids: np.ndarray) -> None:
        at = s.argmax(axis=1)
        most, who = s[np.arange(len(s)), at], ids[at]
        best, near = self.best[q], self.near[q]
        take = (most > best) | (most == best) & np.isfinite(most) & (who < near)
        best[take], near[take] = most[take], who[take]


def band_neighbours(vectors: DataFrame, low: float, high: float, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK, queries: Callable[[Column], Column] | None = None, with_work: bool = False) -> DataFrame:
    """Per query: how many of all other vectors lie in the similarity band, and the nearest one (ties to the smaller id).

    `queries` tells the queries by id; without it every vector is one. A vector with the query's own id is no other. A
    bounded sample gives pivots, whose angles cut the vectors into cells; a pass finds each cell's least and largest angle to
    every pivot. By the triangle inequality these bound the cosine of a query and any vector of a cell, and a query meets only
    cells that can hold a vector of its band or one nearer than the nearest so far, which the sample starts. Vectors are not
    shuffled: queries are sent, sorted by cell, to all tasks, at most QUERY_BYTES in a pass, and what tasks found is summed.
    How much is left out depends on the vectors: clusters are, while without any all pairs are compared. Pivots, sample and
    `chunk`, the vectors of a block, change no result.

    A query without any other vector gives no row. Vectors that are null, zero, of another length or not finite, and null
    ids take no part. A repeated id is a query for each of its rows. `with_work` adds how many vectors were compared."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    block = max(1, min(chunk, 2048))
    some = rows.filter("id is not null and size(v) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    spark = vectors.sparkSession
    schema = f"{id_col} bigint, in_band bigint, nearest bigint, similarity double" + (", compared bigint" if with_work else "")
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    sample_ids, sample = _units(some["id"].combine_chunks(), some["v"].combine_chunks(), None)
    if not len(sample):
        return spark.createDataFrame([], schema)
    size = sample.shape[1]
    cells = _cells(rows, sample, block)
    asked = rows.filter(queries(F.col("id"))) if queries else rows
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "band-queries")
    passes = -(-asked.count() * (8 * size + 4 * len(cells.low) + 64) // QUERY_BYTES)
    found = None
    for p in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).toArrow().combine_chunks()
        q_ids, own, x = _queries(mine, size)
        order = np.argsort(cells.cell(cells.angles(x)), kind="stable")
        sent, key = spark.sparkContext.broadcast((own[order], q_ids[order], x[order])), uuid.uuid4().hex
        run = _pass(sent, key, cells, (sample_ids, sample), low, high, size, block)
        part = rows.mapInArrow(run, "q bigint, in_band bigint, nearest bigint, similarity double, compared bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "nearest")).alias("best")
    found = found.groupBy("q").agg(F.sum("in_band").alias("in_band"), best, F.sum("compared").alias("compared"))
    out = found.join(asked.select("q", F.col("id").alias(id_col)), "q")
    return out.select(id_col, "in_band", F.col("best.nearest").alias("nearest"), (-F.col("best.far")).alias("similarity"), *(["compared"] if with_work else []))


def _queries(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids and unit vectors of the queries that take part."""
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size))
    numbers, x = _units(rows["q"].combine_chunks(), rows["v"].combine_chunks(), size)
    order = np.argsort(rows["q"].to_numpy(), kind="stable")
    ids = rows["id"].to_numpy(zero_copy_only=False)[order]
    at = np.searchsorted(rows["q"].to_numpy()[order], numbers)
    valid = np.array([i is not None and i == i for i in ids[at]], bool)
    return numbers[valid], ids[at][valid].astype(np.int64), x[valid]


def _pass(sent: Broadcast, key: str, cells: Cells, sample: tuple[np.ndarray, np.ndarray], low: float, high: float, size: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of one pass: its vectors meet the queries that were sent."""

    def begin() -> tuple:
        own, _, x = sent.value
        least, most = cells.bounds(cells.angles(x))
        first = _Found(own, x, least, most, np.zeros(len(x), np.int64), np.full(len(x), -np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64))
        order = np.argsort(sample[0], kind="stable")
        for lo in range(0, len(x), 512):
            q = slice(lo, lo + 512)
            s = np.round(x[q] @ sample[1][order].T, 9)
            s[own[q][:, None] == sample[0][order][None, :]] = -np.inf
            first.closer(q, s, sample[0][order])
        return own, x, least.astype(np.float32), most.astype(np.float32), first.best, first.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, least, most, best, near = kept_in_worker("band", key, begin)
        n = len(own)
        f = _Found(own, x, least, most, np.zeros(n, np.int64), best.copy(), near.copy(), np.zeros(n, np.int64))
        meets = (most >= low - 1e-5) & (least <= high + 1e-5)  # single precision is allowed for
        seen = False
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                ids, v = _units(part.column(0), part.column(1), size)
                seen |= len(ids) > 0
                cell = cells.cell(cells.angles(v)) if len(ids) else np.zeros(0, np.int64)
                for a in range(0, n if len(ids) else 0, 512):
                    q = slice(a, a + 512)
                    wanted = (meets[q] | (most[q] >= f.best[q][:, None] - 1e-5)).any(axis=0)[cell]
                    if wanted.any():
                        f.meet(q, ids[wanted], v[wanted], low, high)
        told = np.flatnonzero(f.best > -np.inf) if seen else np.zeros(0, np.int64)
        columns = [sent.value[1][told], f.count[told], f.near[told], f.best[told], f.compared[told]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "in_band", "nearest", "similarity", "compared"])

    return run


def tour(unit: np.ndarray, low: float, high: float, seed: int) -> list[int]:
    """From a random start, always to the most similar one not seen within the band, else to the most similar."""
    n = len(unit)
    if n == 0:
        return []
    seen = np.zeros(n, bool)
    at = int(np.random.default_rng(seed).integers(n))
    order = [at]
    seen[at] = True
    for _ in range(n - 1):
        s = unit @ unit[at]
        s[seen] = -np.inf
        band = np.where((s >= low) & (s <= high), s, -np.inf)
        at = int(band.argmax()) if np.isfinite(band).any() else int(s.argmax())
        order.append(at)
        seen[at] = True
    return order


def similarity_order(vectors: DataFrame, low: float = 0.3, high: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK, seed: int = 0) -> DataFrame:
    """chunk, place: a greedy tour through each random chunk; chunks follow each other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        order = tour(_unit(pdf, vec_col), low, high, seed)
        return pd.DataFrame({id_col: pdf[id_col].to_numpy()[order], "chunk": pdf["chunk"].iloc[0], "place": range(len(order))})

    rows = chunked(vectors.select(id_col, vec_col), id_col, chunk, seed)
    return rows.groupBy("chunk").applyInPandas(run, f"{id_col} bigint, chunk bigint, place bigint")
