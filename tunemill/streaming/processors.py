"""Structured Streaming forms of the metric operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunemill.operators.stateful import SPIKE_START, spike_step


def with_event_time(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp, which a watermark needs, and the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, width: str = "1 day", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    out = with_event_time(stream, ts).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(stream: DataFrame, width: str = "2 days", slide: str = "1 day", ts: str = "ts", value: str = "value") -> DataFrame:
    out = with_event_time(stream, ts).groupBy(F.window(ts, width, slide)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return out.select(F.col("window.start").alias("start"), "n", "mean")


def sessions(stream: DataFrame, gap: str = "6 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key. In append mode those that the watermark has closed; in complete mode the open ones too."""
    out = with_event_time(stream, ts).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def step_windows(stream: DataFrame, every: int, step: str = "step", value: str = "value", run: str = "run") -> DataFrame:
    """Averages over each `every` steps of a run."""
    return stream.groupBy(run, F.expr(f"{step} div {every}").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def spike_states(stream: DataFrame, run: str = "run", order: str = "event_id", value: str = "value", z: float = 5.0, warmup: int = 50, decay: float = 0.99) -> DataFrame:
    """The spike detector with its state kept per run across micro-batches: run, count, mean, var, spikes after each.

    Rows of a micro-batch are taken in `order`."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = tuple(state.get) if state.exists else SPIKE_START
        for x in pd.concat(list(batches)).sort_values(order)[value]:
            found = spike_step(found, x, z, warmup, decay)
        count, mean, var, spikes = found
        state.update((count, float(mean), float(var), int(spikes)))
        yield pd.DataFrame({run: [key[0]], "count": [count], "mean": [mean], "var": [var], "spikes": [spikes]})

    kind = dict(stream.dtypes)[run]
    schema = "count bigint, mean double, var double, spikes bigint"
    return stream.groupBy(run).applyInPandasWithState(update, f"{run} {kind}, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, mode: str, folder: str, keys: list[str], rocksdb: bool = False) -> DataFrame:
    """The result for everything that is available, as a table in `folder`, which driver and executors share; the
    progress is kept beside it, so that a later call goes on from there.

    Each micro-batch is written by the executors. In complete mode the last batch holds the result, in append mode all
    of them do; in update mode it is each key's row of the last batch that has the key. With `rocksdb` the state is kept
    there, as list state needs it, in at most two parts a core: each micro-batch opens and commits every part, empty or not."""
    spark, out = stream.sparkSession, f"{folder}/batches"
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    before, width = spark.conf.get(_PROVIDER, None), spark.conf.get(_PARTS)
    if rocksdb:
        spark.conf.set(_PROVIDER, _ROCKSDB)
        spark.conf.set(_PARTS, min(int(width), max(16, 2 * spark.sparkContext.defaultParallelism)))
    try:  # the query has the settings of its start
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        if rocksdb:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
            spark.conf.set(_PARTS, width)
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(out)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.filter(F.col("batch") == F.lit(last)).drop("batch")
    values = [c for c in stream.columns if c not in keys]
    last_row = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last_row.select(*keys, "_v.*").select(*stream.columns)
