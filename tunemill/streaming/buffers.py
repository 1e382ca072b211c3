"""Bounded buffers of a stream as state: the latest values of a run, and a shuffle buffer.

Both keep their state in RocksDB (`processors.run_once(..., rocksdb=True)`). The rows of one key in one micro-batch are
ordered in the task; the source's maxFilesPerTrigger or maxBytesPerTrigger bounds them. `in_order` makes such a source of a table.

Rows go to the tasks with state and come back as Arrow messages of many rows each, and are ordered and walked as whole
columns, as a Python object for each row or a state for each run would take most of the time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from tunemill.functions.ranks import global_rank
from tunemill.session import written

#: Rows of a micro-batch of `in_order`, and the files that hold them.
BATCH_ROWS, BATCH_FILES = 2_000_000, 16

#: Rows and bytes of an Arrow message, at most about.
CHUNK_ROWS, CHUNK_BYTES = 1 << 17, 32 << 20

#: Rows whose windows are found at once.
_BLOCK = 1 << 14


def in_order(table: DataFrame, order: str, folder: str, batch_rows: int | None = None) -> DataFrame:
    """A stream of all rows of a table by `order`, nulls first, in micro-batches of at most `batch_rows` rows.

    Ranges of rows are written to `folder` one after another, as a file source takes files by their time: each but the last
    as the same number of files, which is what a micro-batch takes."""
    spark, rows = table.sparkSession, batch_rows or BATCH_ROWS
    files = min(BATCH_FILES, rows)
    ranked = global_rank(table, [F.asc_nulls_first(order), *(c for c in table.columns if c != order)], "_place")
    parts = written(ranked.withColumn("_part", F.expr(f"_place div {rows}")), "in-order", by="_part")
    n = parts.agg(F.max("_place") + 1).first()[0] or 0
    if not n:
        table.limit(0).write.mode("append").parquet(folder)  # so that an empty table has a folder
    for part in range(-(-n // rows)):
        dealt = parts.filter(F.col("_part") == part).repartitionById(files, (F.col("_place") % files).cast("int"))
        dealt.select(*table.columns).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _message(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(messages: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(m).read_all() for m in messages]).combine_chunks()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS or sum(b.nbytes for b in held) >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(stream: DataFrame, key: str, names: list[str]) -> DataFrame:
    """`key`, a number, and rows: those of a key among a task's next rows, the columns `names` of them, as a message."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            keys = table.column(key).to_numpy()
            at = np.argsort(keys, kind="stable")
            keys, table = keys[at], table.select(names).take(pa.array(at))
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            messages = [_message(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[cuts[:-1]]), pa.array(messages, pa.binary())], [key, "rows"])

    return stream.mapInArrow(pack, f"`{key}` bigint, rows binary")


def _given(table: pa.Table) -> Iterator[Row]:
    """A result as messages, for `_unpacked`."""
    step = max(1, min(CHUNK_ROWS, table.num_rows * CHUNK_BYTES // max(1, table.nbytes)))
    return (Row(rows=_message(table.slice(a, step))) for a in range(0, table.num_rows, step))


def _unpacked(messages: DataFrame, schema: StructType) -> DataFrame:
    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column("rows"):
                yield from pa.ipc.open_stream(m.as_buffer()).read_all().to_batches()

    return messages.mapInArrow(unpack, schema)


def _with_state(stream: DataFrame, key: str, names: list[str], processor: StatefulProcessor, schema: StructType) -> DataFrame:
    given = _packed(stream, key, names).groupBy(key).transformWithState(processor, "rows binary", "append", "none")
    return _unpacked(given, schema)


def _orders(kind: pa.DataType) -> bool:
    t = pa.types
    text = t.is_string(kind) or t.is_binary(kind) or t.is_large_string(kind) or t.is_large_binary(kind)
    return text or t.is_integer(kind) or t.is_floating(kind) or t.is_boolean(kind) or t.is_decimal(kind) or t.is_temporal(kind) and not t.is_interval(kind)


def _ordered(table: pa.Table, order: str) -> pa.Table:
    """table by `order` and then by the other columns that have an order; nulls first, NaN last."""
    keys: dict[str, pa.ChunkedArray] = {}
    for name in [order, *(c for c in table.column_names if c != order and _orders(table.schema.field(c).type))]:
        column = table.column(name)
        if pa.types.is_floating(column.type):
            keys[f"{len(keys)}"] = pc.is_nan(column)
        keys[f"{len(keys)}"] = column
    return table.take(pc.sort_indices(pa.table(keys), [(k, "ascending") for k in keys], null_placement="at_start"))


def _latest(values: np.ndarray, known: np.ndarray, place: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the latest `length` values up to each index in `at`, the first at place 0: how many are known, their mean, least and most.

    Sums carry what rounding loses. NaN is above all numbers."""
    found = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(at), _BLOCK):
            j = at[a : a + _BLOCK]
            p, n = place[j], np.zeros(len(j), np.int64)
            total, lost = np.zeros(len(j)), np.zeros(len(j))
            least, most = np.full(len(j), np.nan), np.full(len(j), -np.inf)
            for k in range(min(length, int(p.max()) + 1)):
                i = np.maximum(j - k, 0)
                x, ok = values[i], (p >= k) & known[i]
                n += ok
                least, most = np.fmin(least, np.where(ok, x, np.nan)), np.maximum(most, np.where(ok, x, -np.inf))
                x = np.where(ok, x, 0.0)
                upto = total + x
                from_x = upto - total
                lost += (total - (upto - from_x)) + (x - from_x)
                total = upto
            mean = np.where(np.isfinite(lost), total + lost, total) / np.maximum(n, 1)
            for out, x in zip(found, (n, mean, least, most), strict=True):
                out[a : a + _BLOCK] = x
    return found


class _Recent(StatefulProcessor):
    """The state of a bucket of runs is one message: each run and its latest length - 1 values."""

    def __init__(self, length: int, names: list[str], kind: pa.DataType):
        self.length, self.names, self.kind = length, names, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("recent", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = _ordered(_table(r["rows"] for r in rows), "_order")
        codes = new.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        runs = codes.dictionary
        of, value = codes.indices.to_numpy(), new.column(2).combine_chunks()
        others, before = [], 0
        if self.kept.exists():
            kept = _table(self.kept.get())
            at = pc.index_in(kept.column("run").combine_chunks(), value_set=runs)
            others = [kept.filter(pc.is_null(at))]
            lists = kept.column("kept").combine_chunks().filter(pc.is_valid(at))
            old = lists.flatten()
            before = len(old)
            of = np.concatenate([np.repeat(pc.drop_null(at).to_numpy(), pc.list_value_length(lists).to_numpy()), of])
            value = pa.concat_arrays([old, value])
        rank = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(runs))
        ends = np.cumsum(counts)
        value = value.take(pa.array(rank))
        values, known = pc.fill_null(value, 0.0).to_numpy(), pc.is_valid(value).to_numpy(zero_copy_only=False)
        place = np.arange(len(rank)) - np.repeat(ends - counts, counts)
        at = np.flatnonzero(rank >= before)
        n, *rest = _latest(values, known, place, at, self.length)
        given = new.select([0, 1]).take(pa.array(rank[at] - before)).append_column("n", pa.array(np.minimum(place[at] + 1, self.length)))
        for name, x in zip(("mean", "least", "most"), rest, strict=True):
            given = given.append_column(name, pa.array(x, mask=n == 0, from_pandas=False).cast(self.kind))
        stay = np.minimum(counts, self.length - 1)
        offsets = np.concatenate([[0], np.cumsum(stay)])
        last = np.arange(offsets[-1]) + np.repeat(ends - stay - offsets[:-1], stay)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), value.take(pa.array(last)))
        self.kept.update((_message(pa.concat_tables([*others, pa.table({"run": runs, "kept": lists})]).combine_chunks()),))
        return _given(given.rename_columns(self.names))

    def close(self) -> None:
        pass


def recent_values(stream: DataFrame, length: int, run: str = "run", order: str = "event_id", value: str = "value", buckets: int = 256) -> DataFrame:
    """For each row its run, its order, and over the latest `length` rows of the run up to it: n, mean, least, most.

    Rows count in the order in which micro-batches bring them, within one by `order`, nulls first. A null value takes a
    place and no part in mean, least and most, which are null if all are; null runs are one run. No rows give none.
    Mean, least and most are doubles, or floats for a float. Structs, arrays and maps as run or order are an error. The runs of a bucket share a state, which a task holds whole:
    8 bytes for each of the `length` values of runs / buckets runs."""
    kind = {f.name: f for f in stream.schema}
    number, arrow = (FloatType(), pa.float32()) if isinstance(kind[value].dataType, FloatType) else (DoubleType(), pa.float64())
    numbers = [StructField("n", LongType())] + [StructField(c, number) for c in ("mean", "least", "most")]
    schema = StructType([StructField(run, kind[run].dataType), StructField(order, kind[order].dataType), *numbers])
    rows = stream.select(F.col(run).alias("_run"), F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_run"), F.lit(buckets)))
    return _with_state(rows, "_bucket", ["_run", "_order", "_value"], _Recent(length, schema.names, arrow), schema)


def slots(seed: int, shard: int, first: int, n: int, size: int) -> np.ndarray:
    """The buffer's place that the rows first, first + 1, ... of a shard take, from 0 to size - 1: a hash of seed, shard and number."""
    start = (seed * 0xD1B54A32D192ED03 + shard * 0x8CB92BA72F3D8DD7 + (first + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    half, of = np.uint64(32), np.uint64(size)  # the upper half of x * size, for sizes below 2 ** 32
    return (((x >> half) * of + (((x & np.uint64(0xFFFFFFFF)) * of) >> half)) >> half).astype(np.int64)


class _Shuffle(StatefulProcessor):
    def __init__(self, size: int, seed: int, order: str, schema: StructType):
        self.size, self.seed, self.order, self.schema = size, seed, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("buffer", self.schema)
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = _ordered(_table(r["rows"] for r in rows), self.order)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        kept = [tuple(r) for r in self.kept.get()]
        held = LocalDataToArrowConversion.convert(kept, self.schema, False).cast(came.schema) if kept else came.slice(0, 0)
        both = pa.concat_tables([held, came]).combine_chunks()
        number = np.arange(seen, seen + came.num_rows)
        taken = np.where(number < self.size, number, slots(self.seed, key[0], seen, len(number), self.size))
        place = np.concatenate([np.arange(held.num_rows), taken])
        at = np.argsort(place, kind="stable")  # the rows that each place has had, one after another
        before = np.empty_like(at)
        before[at[1:]] = at[:-1]
        full = number >= self.size
        left = both.take(pa.array(before[held.num_rows :][full]))
        stay = at[np.append(np.diff(place[at]) != 0, True)]
        held = ArrowTableToRowsConversion.convert(both.take(pa.array(stay)), self.schema)
        self.kept.put([tuple(r.asDict(True).values()) for r in held])
        self.seen.update((seen + len(number),))
        shard = pa.array(np.full(left.num_rows, key[0], np.int64))
        return _given(left.add_column(0, "position", pa.array(number[full] - self.size)).add_column(0, "shard", shard))

    def close(self) -> None:
        pass


def shuffle_buffer(stream: DataFrame, size: int, order: str, shards: int, seed: int = 0) -> DataFrame:
    """The rows of a stream in shuffled order: shard, position from 0, and the stream's columns.

    Each of `shards` buffers keeps `size` rows; one more row takes a seeded place, whose row leaves. What is still kept when
    the stream stops is read by `left_in_buffer`. Rows go to shards by the hash of all their columns, so no id, null ones
    included, makes a shard large; only rows that are equal throughout meet in one. Streams with columns named shard or position
    are an error."""
    if {"shard", "position"} & set(stream.columns):
        raise ValueError("shard and position are columns of the result")
    schema = StructType([StructField("shard", LongType()), StructField("position", LongType()), *stream.schema.fields])
    rows = stream.withColumn("shard", F.pmod(F.xxhash64(*stream.columns), F.lit(shards)))
    return _with_state(rows, "shard", stream.columns, _Shuffle(size, seed, order, stream.schema), schema)


def left_in_buffer(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """The rows that the buffers of a stopped stream still hold, at the positions after those that left, in seeded order; `folder` is run_once's."""
    state = lambda name: spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name).load()
    rows = state("buffer").select(F.col("key.shard").alias("shard"), "list_element.*")
    names = [c for c in rows.columns if c != "shard"]
    kept = Window.partitionBy("shard")
    rank = F.row_number().over(kept.orderBy(F.xxhash64(F.lit(seed), *names), *names)) - 1
    counts = state("seen").select(F.col("key.shard").alias("shard"), F.col("value.n").alias("_seen"))
    placed = rows.withColumns({"_rank": rank, "_kept": F.count(F.lit(1)).over(kept)}).join(counts, "shard")
    return placed.select("shard", (F.col("_seen") - F.col("_kept") + F.col("_rank")).alias("position"), *names)
