"""Similarity join of documents by n-gram Jaccard, as a blocked sparse matrix product.

The document by n-gram incidence matrix is never multiplied whole. Bounds that follow from the set sizes
discard rows and columns first, and lose no pair: two sets with Jaccard t share at least ceil(t * n) of the
larger one's n n-grams, so

1. of the first n - ceil(t * n) + k n-grams by a common order, k must stand in another document's too;
   counting just these, in hash order, discards the documents that share little;
2. among those left, n-grams that one document alone has are discarded from the matrix, and documents with
   more than n - ceil(t * n) of them; the rest are ordered by frequency, rarest first;
3. documents that share one of the first n - ceil(t * n) + 1 n-grams of that order fall into one diagonal
   block. Blocks are multiplied by themselves, each overlap count is held against the bound from the two
   sizes, and the links within a block give its components.

A block over TILE documents is cut into tiles, in which a document counts once more for every LOAD n-grams that it has, so
neither many texts nor long ones fill a tile. First every tile is multiplied by the block's pivots, the
documents whose n-grams are the most frequent; a large group of near copies thereby turns into one component.
Pairs within that component need no test. What it does not hold is multiplied by those tiles alone that hold a
document which shares one of the first n-grams of 3. and has a size within the bounds, so a block that boilerplate
connects costs what its documents share, not its square. Equal sets are one row of the matrix from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions.skew import HOT, hot_safe_join
from tunemill.llm.components import connected_components
from tunemill.llm.names import fresh
from tunemill.llm.shingles import Words, grams, mixed, tokens
from tunemill.llm.workers import releasing
from tunemill.session import small, written

PERCENT, N = 80, 5
#: Documents of a tile, pivots of a block of more, and documents of a bucket of small blocks.
TILE, PIVOTS, BUCKET = 1024, 32, 1024
#: N-grams for which a document counts once more in tiles and buckets: these hold TILE * LOAD n-grams, and one text more.
LOAD = 4096
#: Text that a task turns into shingles at once.
SLICE_BYTES = 2 << 20


def shingle_sets(texts: list[str | None], words: Words, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; of the whole text where it has fewer than n words."""
    hashed = [words.hashes(tokens(t)) for t in texts]
    flat = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    all_grams = grams(flat, n) if len(flat) >= n else flat[:0]
    out, at = [], 0
    for h in hashed:
        out.append(np.unique(all_grams[at : at + len(h) - n + 1] if len(h) >= n else grams(h, n)))
        at += len(h)
    return out


def _slices(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _digest(s: np.ndarray) -> tuple[int, int]:
    m = mixed(s + np.uint64(1))
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(m ^ np.uint64(0x5851F42D4C957F2D)) * (m | np.uint64(1)), initial=np.uint64(0)).view(np.int64))


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that a set of n elements has with one at least so similar."""
    return (percent * n + 99) // 100


def spare(n: np.ndarray | int) -> np.ndarray | int:
    """k of the first bound: a tenth of the set."""
    return (n + 9) // 10


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sparse product of two incidence blocks, len(a) x len(b): dense matrix products for columns that many
    rows share, pair by pair for the others."""
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    flat = np.concatenate([*a, *b]) if a or b else np.zeros(0, np.int64)
    _, col = np.unique(flat, return_inverse=True)
    col_a, col_b = col[: len(rows_a)], col[len(rows_a) :]
    width = int(col.max()) + 1 if len(col) else 0
    in_a, in_b = np.bincount(col_a, minlength=width), np.bincount(col_b, minlength=width)
    both = (in_a > 0) & (in_b > 0)
    heavy = both & (in_a * in_b > max(16, len(a) * len(b) // 48))
    out = np.zeros(len(a) * len(b), np.float32)
    light = both & ~heavy
    keep_a, keep_b = light[col_a], light[col_b]
    ra, ca = rows_a[keep_a], col_a[keep_a]
    by_col = np.argsort(col_b[keep_b], kind="stable")
    rb, cb = rows_b[keep_b][by_col], col_b[keep_b][by_col]
    first, times = np.searchsorted(cb, ca), in_b[ca]
    for lo in range(0, len(ca), 1 << 16):
        t = times[lo : lo + (1 << 16)]
        begin = np.repeat(first[lo : lo + (1 << 16)] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        np.add(out, np.bincount(np.repeat(ra[lo : lo + (1 << 16)], t) * len(b) + rb[begin], minlength=len(out)), out=out, casting="unsafe")
    out = out.reshape(len(a), len(b))
    place = np.cumsum(heavy) - 1
    wide = int(heavy.sum())
    keep_a, keep_b = heavy[col_a], heavy[col_b]
    ra, ca, rb, cb = rows_a[keep_a], place[col_a[keep_a]], rows_b[keep_b], place[col_b[keep_b]]
    for lo in range(0, wide, 2048):
        x, y = np.zeros((len(a), min(2048, wide - lo)), np.float32), np.zeros((len(b), min(2048, wide - lo)), np.float32)
        here = (ca >= lo) & (ca < lo + 2048)
        x[ra[here], ca[here] - lo] = 1
        here = (cb >= lo) & (cb < lo + 2048)
        y[rb[here], cb[here] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _labels(link: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric link matrix can reach."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _arrays(table: pa.Table, name: str = "grams") -> list[np.ndarray]:
    c = table.column(name).combine_chunks()
    flat, offset = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offset[:-1], offset[1:], strict=True)]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = N, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id; one row per row of docs.

    component_id is the smallest id that can be reached by links, class_id the smallest id with an equal set.
    A text that is null or has no word has an empty set and is linked with nothing, also not with other empty
    ones. A null id takes part through equal sets only and gets what those get; rows that repeat an id are
    told apart. Sets are compared by 64-bit hashes of their n-grams. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in _slices(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist(), words, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            head = [s[: len(s) - needed(len(s), percent) + spare(len(s))] for s in sets]
            length = np.array([len(s) for s in head], np.int64)
            unique, place, count = np.unique(np.concatenate(head), return_inverse=True, return_counts=True)
            shared = count[place] > 1  # within this slice; so a frequent n-gram is one row of it
            known = np.bincount(np.repeat(np.arange(len(sets)), length)[shared], minlength=len(sets)) if len(sets) else sizes
            rest = np.concatenate(head)[~shared].view(np.int64)
            ends = np.cumsum(length - known)
            digests = [_digest(s) for s in sets]
            rows = [
                part.column(0), pa.array(sizes.astype(np.int32)), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                pa.array(known.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rest)),
            ]
            names = ["doc_id", "n", "d1", "d2", "known", "rest"]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            marks = unique[count > 1].view(np.int64)
            if len(marks):
                none = [pa.nulls(1, part.schema.field(0).type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), pa.array(marks))], names=names)

    heads = written(texts.mapInArrow(releasing(first_bound), f"doc_id {kind}, n int, d1 long, d2 long, known int, rest array<long>"), "near-heads")
    rows = heads.filter("n is not null").select("doc_id", "n", "d1", "d2")
    # k must hold for the smallest partner too; equal sets make their class pass
    in_two = heads.select("d1", F.explode("rest").alias("gram")).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    counted = in_two.filter("rows > 1 AND d1 is not null").groupBy("d1").agg(F.count(F.lit(1)).alias("more"))
    classes = heads.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("known").alias("known"))
    least = F.expr(f"(({percent} * n + 99) div 100 + 9) div 10")
    passed = classes.filter("class_id is not null").join(counted, "d1", "left").filter((F.col("known") + F.coalesce("more", F.lit(0)) >= least) | (F.col("copies") > 1))
    passed = small(written(passed.select(F.col("class_id").alias("doc_id")).distinct(), "near-passed"))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in _slices(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist(), words, n)
            digests = [_digest(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int32()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "d1", "d2", "grams"])

    sets = texts.join(passed, "doc_id", "left_semi").mapInArrow(releasing(whole_sets), f"doc_id {kind}, n int, d1 long, d2 long, grams array<long>")
    sets = written(sets.filter("n > 0").withColumn("node", F.monotonically_increasing_id()), "near-sets")
    load = F.expr(f"1 + n div {LOAD}")
    buckets = 1 + (sets.agg(F.sum(load).alias("n")).first().n or 0) // BUCKET

    matrix = sets.select("node", "n", F.explode("grams").alias("gram"))
    often = written(matrix.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-often")
    matrix = hot_safe_join(matrix, often, ["gram"], "inner", many=often.filter(F.col("df") > HOT).select("gram"))
    matrix = matrix.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))

    def second_bound(table: pa.Table) -> pa.Table:
        node, size, gram, df = (table.column(c).to_numpy() for c in ("node", "n", "gram", "df"))
        order = np.lexsort((gram, df, node))
        node, size, gram, df = node[order], size[order].astype(np.int64), gram[order], df[order]
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count = np.diff(np.append(begin, len(node)))
        head = count - needed(size[begin], percent) + 1  # n-grams of no other document come first in the order
        out: dict[str, list] = {"node": [], "n": [], "weight": [], "grams": [], "head": []}
        for b, c, h in zip(begin.tolist(), count.tolist(), head.tolist(), strict=True):
            if h > 0:
                out["node"].append(node[b])
                out["n"].append(size[b])
                out["weight"].append(float(df[b : b + c].sum()) / float(size[b]))
                out["grams"].append(np.sort(gram[b : b + c]))
                out["head"].append(gram[b : b + h])
        longs = pa.list_(pa.int64())
        return pa.table(out, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("weight", pa.float64()), ("grams", longs), ("head", longs)]))

    kept = written(matrix.groupBy("bucket").applyInArrow(second_bound, "node long, n long, weight double, grams array<long>, head array<long>"), "near-rows")
    heads2 = kept.select("node", F.explode("head").alias("gram"))
    hubs = written(heads2.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "near-hubs")
    shared = hot_safe_join(heads2, hubs.drop("c"), ["gram"], "inner", many=hubs.filter(F.col("c") > HOT).select("gram")).select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    blocks = connected_components(shared).withColumnRenamed("component", "block")
    sizes = written(blocks.join(kept.select("node", load.alias("load")), "node").groupBy("block").agg(F.sum("load").alias("size")), "near-blocks")
    members = written(kept.select("node", "n", "weight", "grams").join(blocks, "node").join(small(sizes), "block"), "near-members")

    def product(table: pa.Table) -> pa.Table:
        block, node, size, sets = table.column("block").to_numpy(), table.column("node").to_numpy(), table.column("n").to_numpy(), _arrays(table)
        order = np.lexsort((node, block))
        cut = np.flatnonzero(np.diff(block[order])) + 1
        nodes, labels = [], []
        for own in np.split(order, cut):
            s = [sets[i] for i in own]
            label = _labels(linked(overlaps(s, s), size[own][:, None], size[own][None, :], percent))
            nodes.append(node[own])
            labels.append(node[own][label])
        return pa.table({"a": np.concatenate(nodes), "b": np.concatenate(labels)})

    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets))
    links = members.filter(F.col("size") <= tile).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(product, "a long, b long")
    if not sizes.filter(F.col("size") > tile).isEmpty():
        links = links.union(_tiled(members.filter(F.col("size") > tile), heads2, percent, tile))
    found = connected_components(links.filter("a <> b"))
    named = sets.select("node", "n", "d1", "d2", "doc_id").join(found, "node")
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(least_id, "component").groupBy("n", "d1", "d2").agg(F.min("component_id").alias("linked_id"))
    # written, so that the last join has two plain sides and Spark can split the rows of a large class
    ids = written(classes.select("n", "d1", "d2", "class_id").join(joined, ["n", "d1", "d2"], "left"), "near-classes")
    out = rows.join(ids, ["n", "d1", "d2"], "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.least("class_id", F.coalesce("linked_id", "class_id"))).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def asked_tiles(rest: DataFrame, docs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(node, block, tile), without repeats: the tiles that may hold a partner of each document of rest.

    rest and docs: node, block, n, docs also tile; heads: node, gram. Two linked documents share an n-gram of
    their heads, and neither has under `percent` of the other's size, so no link is lost. An n-gram's list has
    one entry for a tile, however many documents share it."""
    asks = written(heads.join(rest.select("node", "block", "n"), "node"), "near-asks")
    held = heads.join(asks.select("gram").distinct(), "gram", "left_semi").join(docs.select("node", "tile", "n"), "node")
    held = held.groupBy("gram", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    held = held.groupBy("gram").agg(F.collect_list(F.struct("tile", "least", "most")).alias("held"))
    met = hot_safe_join(asks, written(held, "near-held"), ["gram"], "inner")
    fits = lambda h: (100 * h["most"] >= percent * F.col("n")) & (percent * h["least"] <= 100 * F.col("n"))
    return met.select("node", "block", F.explode(F.transform(F.filter("held", fits), lambda h: h["tile"])).alias("tile")).distinct()


def _tiled(members: DataFrame, heads: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (a, b) that connect what the links within large blocks connect. heads: node, gram."""
    docs = members.withColumn("tiles", F.expr(f"cast(ceil(size / {tile}) as int)")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    by_weight = Window.partitionBy("block").orderBy(F.desc("weight"), "node")
    pivots = docs.withColumn("turn", F.row_number().over(by_weight)).filter(F.col("turn") <= PIVOTS)
    own = ["block", "tile", "role", "node", "n", "grams"]
    pivots = pivots.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("role", F.lit(0)).select(*own)

    def cross(table: pa.Table) -> pa.Table:
        role, node, size, sets = table.column("role").to_numpy(), table.column("node").to_numpy(), table.column("n").to_numpy(), _arrays(table)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        link = linked(overlaps([sets[i] for i in left], [sets[i] for i in right]), size[left][:, None], size[right][None, :], percent)
        whole = np.zeros((len(left) + len(right),) * 2, bool)
        whole[: len(left), len(left) :] = link
        whole |= whole.T
        label, names = _labels(whole), np.concatenate([node[left], node[right]])
        return pa.table({"a": names, "b": names[label]})

    near = pivots.unionByName(docs.withColumn("role", F.lit(1)).select(*own)).groupBy("block", "tile").applyInArrow(cross, "a long, b long")
    near = written(near.filter("a <> b"), "near-pivot-links")
    label = docs.select("block", "node").join(connected_components(near), "node", "left")
    counts = label.filter("component is not null").groupBy("block", "component").count()
    largest = counts.groupBy("block").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    rest = label.join(largest, "block", "left").filter("component is null OR largest is null OR component <> largest").select("node")
    rest = written(docs.join(rest, "node", "left_semi"), "near-rest")
    asked = written(asked_tiles(rest, docs, heads, percent), "near-asked")
    asking = asked.join(rest.select("node", F.expr(f"1 + n div {LOAD}").alias("load")), "node")
    strips = asking.groupBy("block", "tile").agg(F.expr(f"cast(ceil(sum(load) / {tile}) as int)").alias("strips"))
    strips = small(written(strips, "near-strips"))
    cell = ["block", "strip", "tile", "role", "node", "n", "grams"]
    strip = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("strips")).cast("int")
    left = rest.drop("block", "tile").join(asked, "node").join(strips, ["block", "tile"]).withColumn("strip", strip).withColumn("role", F.lit(0)).select(*cell)
    right = docs.join(strips, ["block", "tile"]).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumn("role", F.lit(1)).select(*cell)
    return near.union(left.unionByName(right).groupBy("block", "strip", "tile").applyInArrow(cross, "a long, b long"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = N) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns stay as they are.

    Documents without words are kept. Rows that repeat an id stay if the id does; rows without id stay."""
    (key,) = fresh(docs, "_id")
    groups = near_groups(docs, id_col, text_col, percent, n).filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(small(written(groups, "near-dropped")), F.col(f"`{id_col}`") == F.col(key), "left_anti")
