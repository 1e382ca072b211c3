"""Streams with bounded buffers, and metric rows that a replayed batch leaves as they are; over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tunemill.plans.q_metrics import _stream
from tunemill.plans.q_selection import table
from tunemill.session import scratch_dir
from tunemill.sources import readers, sinks
from tunemill.streaming import buffers, processors

BUFFER, SHARDS, SEED = 1000, 8, 11


def _folder(spark):
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_recent_values(spark, sf_dir):
    """Over the latest 50 events of each user; means of so few cents have no tie at seven digits."""
    folder = _folder(spark)
    rows = buffers.in_order(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", f"{folder}/rows")
    out = processors.run_once(buffers.recent_values(rows, 50, run="user_id"), "append", folder, [], rocksdb=True)
    return out.select("user_id", "event_id", "n", F.round("mean", 7).alias("mean"), "least", "most")


def stream_shuffle_buffer(spark, sf_dir):
    """All events in shuffled order by shard, with those that the buffers keep at the end."""
    folder = _folder(spark)
    rows = buffers.in_order(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", f"{folder}/rows")
    out = processors.run_once(buffers.shuffle_buffer(rows, BUFFER, "event_id", SHARDS, SEED), "append", folder, [], rocksdb=True)
    return out.unionByName(buffers.left_in_buffer(spark, folder, SEED))


def stream_metric_rows(spark, sf_dir):
    """Events as metric rows, written by a stream whose batches are all repeated once, and read back."""
    folder = _folder(spark)
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    for k in range(2):
        sinks.stream_metrics(rows, f"{folder}/metrics", f"{folder}/checkpoint-{k}", name="events")
    return readers.read_history(spark, f"{folder}/metrics", "purchase").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"), F.round(F.sum("value"), 3).alias("total"))


QUERIES = {f.__name__: f for f in (stream_recent_values, stream_shuffle_buffer, stream_metric_rows)}

ORACLE_SQL = {
    "stream_recent_values": """SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 7) AS mean, min(value) OVER w AS least, max(value) OVER w AS most
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id NULLS FIRST ROWS 49 PRECEDING)""",
    "stream_metric_rows": """SELECT cast(user_id AS varchar) AS run, count(*) AS n, cast(sum(event_id) AS bigint) AS steps, round(sum(value), 3) AS total FROM events
WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1""",
}
