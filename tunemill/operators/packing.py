"""Packing token sequences into blocks, length grouping, batching and padding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions.prefix import prefix_sums
from tunemill.functions.ranks import first_rows, global_rank, seeded
from tunemill.session import small, written

IGNORE = -100
#: Rows of the sorting buffer of sorted packing.
BUFFER = 256


def _offsets(ranked: DataFrame, length: str) -> DataFrame:
    """ranked has a dense `rank`; adds start: the tokens of all rows before."""
    n = ranked.count()
    return prefix_sums(ranked, [], "rank", max(1, (max(n, 1) - 1).bit_length()), max(1, n // 512), [], length, "start")


def _cut(placed: DataFrame, block: int, length: str) -> DataFrame:
    """Pieces of sequences in blocks: block, slot (order), offset (in the sequence), n."""
    full = placed.filter(F.col(length) > 0).withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + {length} - 1) div {block})")))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col(length), (F.col("block") + 1) * block)
    return full.withColumn("offset", lo - F.col("start")).withColumn("n", hi - lo).withColumn("slot", F.col("rank"))


def pack_sequential(seqs: DataFrame, block: int, id_col: str = "seq_id", length: str = "length") -> DataFrame:
    """Sequences in order of their id, cut every `block` tokens; a sequence may span blocks and its positions go on."""
    return _cut(_offsets(global_rank(seqs, [F.asc(id_col)]), length), block, length)


def pack_sorted(seqs: DataFrame, block: int, id_col: str = "seq_id", length: str = "length", buffer: int = BUFFER) -> DataFrame:
    """Buffers of `buffer` sequences in order, each sorted by length; sequences end at `block` tokens; the rest is carried."""
    ranked = global_rank(seqs, [F.asc(id_col)], "_at").withColumn("_buffer", F.expr(f"_at div {buffer}"))
    within = F.row_number().over(Window.partitionBy("_buffer").orderBy(length, "_at")) - 1
    ranked = ranked.withColumn("rank", F.col("_buffer") * buffer + within).withColumn("_capped", F.least(F.col(length), F.lit(block)).cast("bigint"))
    return _cut(_offsets(ranked, "_capped"), block, "_capped").drop("_at", "_buffer", "_capped")


def blocks(pieces: DataFrame, *arrays: str) -> DataFrame:
    """One row per block: each array column concatenated over its pieces, and position_ids that restart per sequence."""
    cut = [F.slice(a, (F.col("offset") + 1).cast("int"), F.col("n").cast("int")).alias(a) for a in arrays]
    positions = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: i + F.col("offset")).alias("position_ids")
    rows = pieces.select("block", F.struct("slot", *cut, positions).alias("p")).groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("block", *[F.flatten(F.col(f"p.{a}")).alias(a) for a in (*arrays, "position_ids")])


def shift_labels(labels: Column, positions: Column | None = None) -> Column:
    """Each position's label becomes the next one's; none after the last, nor where the next starts a sequence."""
    nxt = F.concat(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), F.array(F.lit(IGNORE).cast("bigint")))
    if positions is not None:
        ahead = F.concat(F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0))), F.array(F.lit(0).cast("bigint")))
        nxt = F.zip_with(nxt, ahead, lambda x, p: F.when(p == 0, F.lit(IGNORE).cast("bigint")).otherwise(x))
    return F.when(F.size(labels) > 0, nxt).otherwise(labels)


def length_groups(seqs: DataFrame, batch: int, buffer: int, id_col: str = "seq_id", length: str = "length", seed: int = 0) -> DataFrame:
    """buffer, batch_no, turn: batches of similar length within each buffer; full ones in a random order, a partial one last."""
    buffer = max(buffer - buffer % batch, batch)
    ranked = global_rank(seqs, [F.asc(id_col)], "_at").withColumn("buffer", F.expr(f"_at div {buffer}"))
    place = F.row_number().over(Window.partitionBy("buffer").orderBy(length, "_at")) - 1
    rows = ranked.withColumn("batch_no", F.floor(place / batch)).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("buffer", "batch_no")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "buffer", "batch_no"))
    order = Window.partitionBy("buffer").orderBy(F.col("rows") < batch, key, "batch_no")
    return rows.withColumn("turn", F.dense_rank().over(order) - 1).drop("_at")


def padded(length: Column, multiple: int) -> Column:
    return (F.ceil(length / F.lit(float(multiple))) * multiple).cast("bigint")


def collate(rows: DataFrame, keys: list[str], multiple: int = 1, pad_id: int = 0) -> DataFrame:
    """Pads input_ids, attention_mask, labels and position_ids to the longest of the batch, rounded up; longest first."""
    target = padded(F.max(F.size("input_ids")).over(Window.partitionBy(*keys)), multiple).cast("int")
    fill = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE, "position_ids": 0}
    out = rows.withColumn("_to", target)
    return out.select(*[c for c in rows.columns if c not in fill], *[F.concat(c, F.array_repeat(F.lit(v).cast("bigint"), F.col("_to") - F.size(c))).alias(c) for c, v in fill.items() if c in rows.columns])


def collate_by_budget(rows: DataFrame, keys: list[str], id_col: str, pad_id: int = 0) -> DataFrame:
    """collate to the longest of each batch, with `place`: rows from the longest to the shortest."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.size("input_ids")), id_col)
    return collate(rows.withColumn("place", (F.row_number().over(order) - 1).cast("bigint")), keys, 1, pad_id)


def greedy_batches(seqs: DataFrame, most_rows: int, most_tokens: int, id_col: str = "seq_id", length: str = "length") -> DataFrame:
    """batch: by ascending length, as many rows as stay within both limits when padded; a longer one goes alone.

    Rows of one length only differ by their place among these. So the batches follow from the number of rows of each
    length: a walk over the distinct lengths says how many rows of a length still go to the batch before, the others
    fill batches of their own, and a row's place among its length gives its batch. No task walks over the rows."""
    ranked = written(global_rank(seqs.select(id_col, length), [F.asc(length), F.asc(id_col)]), "greedy")
    counts = ranked.groupBy(length).agg(F.count(F.lit(1)).alias("_c"), F.min("rank").alias("_first"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, size = 0, 0
        for b in batches:
            out: list[tuple] = []
            for n, c, first in zip(*(x.to_pylist() for x in b.columns), strict=True):
                cap = max(1, min(most_rows, most_tokens // max(n, 1)))
                room = min(c, max(0, cap - size))
                rest = c - room
                out.append((n, first, batch, room, cap, batch + (1 if size + room else 0)))
                if rest:
                    more = -(-rest // cap)
                    batch, size = batch + more if size + room else batch + more - 1, rest - (more - 1) * cap
                else:
                    size += room
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["_n", "_first", "_into", "_room", "_cap", "_next"])

    lengths = counts.select(F.col(length).cast("bigint"), "_c", "_first").coalesce(1).sortWithinPartitions(length)
    plan = written(lengths.mapInArrow(walk, "_n bigint, _first bigint, _into bigint, _room bigint, _cap bigint, _next bigint"), "greedy-plan")
    place = F.col("rank") - F.col("_first")
    batch = F.when(place < F.col("_room"), F.col("_into")).otherwise(F.expr("_next + (rank - _first - _room) div _cap"))
    return ranked.join(small(plan), F.col(length) == F.col("_n")).select(id_col, length, batch.alias("batch"))


def row_shard(df: DataFrame, id_col: str, index: int, count: int, contiguous: bool = False) -> DataFrame:
    """The rows of one of `count` readers: every count-th by id, or a contiguous part."""
    ranked = global_rank(df, [F.asc(id_col)], "place")
    if contiguous:
        n = df.count()
        return ranked.filter((F.col("place") >= index * n // count) & (F.col("place") < (index + 1) * n // count))
    return ranked.filter(F.col("place") % count == index)


def resume_from(batches: DataFrame, skip: int, batch: str = "batch", epoch: str = "epoch", start_epoch: int = 0) -> DataFrame:
    """The micro-batches that a resumed run still has to do: from start_epoch, and there from batch `skip` on."""
    return batches.filter((F.col(epoch) > start_epoch) | ((F.col(epoch) == start_epoch) & (F.col(batch) >= skip)))


def eval_batches(samples: DataFrame, n: int, id_col: str, length: str = "length", each: int = 4) -> DataFrame:
    """The first n samples by id, sorted by length, in batches of `each`."""
    order = [F.asc(length), F.asc(id_col)]
    return first_rows(first_rows(samples, [F.asc(id_col)], n, "_at").drop("_at"), order, n, "place").withColumn("batch", F.expr(f"place div {each}"))


def position_sample(rows: DataFrame, batch: str, keys: list[str], keep: int = 64, seed: int = 0) -> DataFrame:
    """At most `keep` random positions of each batch, for statistics of its tokens; repeatable."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    place = F.row_number().over(Window.partitionBy(batch).orderBy(key, *keys))
    return rows.withColumn("_k", place).filter(F.col("_k") <= keep).drop("_k")


def sequence_shards(tokens: Column, ranks: int) -> Column:
    """Equal slices for each rank; an error if the length is no multiple."""
    n = F.size(tokens)
    share = (n / ranks).cast("int")
    checked = F.when(n % ranks == 0, tokens).otherwise(F.raise_error(F.lit("length is not divisible by the number of ranks")))
    return F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.slice(checked, r * share + 1, share))


def total_steps(batches: DataFrame, accumulate: int, epochs: int, rank_col: str = "rank") -> DataFrame:
    """Steps of the slowest rank: floor(batches / accumulate) * epochs; an error under one step."""
    per = batches.groupBy(rank_col).agg(F.count(F.lit(1)).alias("micro"))
    steps = F.floor(F.min("micro") / accumulate) * epochs
    return per.agg(F.when(steps >= 1, steps).otherwise(F.raise_error(F.lit("fewer than one optimizer step"))).cast("bigint").alias("total_steps"))


def sample_chunks(seqs: DataFrame, chunk: int, keep: int, id_col: str = "seq_id", length: str = "length", seed: int = 0) -> DataFrame:
    """Chunks of each sequence, `keep` of them chosen at random with scale (chunks / kept)."""
    n = F.ceil(F.col(length) / F.lit(float(chunk)))
    rows = seqs.filter(F.col(length) > 0).withColumn("chunks", n).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    key = F.md5(F.concat_ws(":", F.col(id_col), "chunk", F.lit(str(seed))))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(key, "chunk"))
    return rows.withColumn("_k", place).filter(F.col("_k") <= keep).withColumn("scale", F.col("chunks") / F.least(F.col("chunks"), F.lit(keep))).drop("_k")


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """A repeatable random place for each row."""
    return global_rank(df, [seeded(id_col, seed), F.asc(id_col)], "place")
