"""Sinks: prepared data, manifests, per-source output, the token cache and metric rows."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.operators.metrics import expired_checkpoints
from tunemill.sources.readers import PREPARED, delete, exists, listing, rename, scan_checkpoints

log = logging.getLogger(__name__)


def save_prepared(samples: DataFrame, folder: str, fmt: str = "parquet", name: str = PREPARED) -> str:
    """Writes the samples and removes the other format's old file. Order is the column score_rank, where there is one.

    Where Parquet cannot hold the schema, JSON lines are written."""
    spark, base = samples.sparkSession, folder.rstrip("/")
    if fmt == "parquet":
        path = f"{base}/{name}.parquet"
        try:
            samples.write.mode("overwrite").parquet(path)
            delete(spark, f"{base}/{name}.jsonl")
            return path
        except AnalysisException as e:
            log.warning("no Parquet for this schema, writing JSON lines: %s", e)
    path = f"{base}/{name}.jsonl"
    samples.write.mode("overwrite").json(path)
    delete(spark, f"{base}/{name}.parquet")
    return path


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest's few rows as JSON."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def save_sources(samples: DataFrame, folder: str, source: str = "source") -> None:
    """JSON lines by source; blanks and slashes of its name become underscores."""
    samples.withColumn("_dir", F.translate(source, "/ ", "__")).write.mode("overwrite").partitionBy("_dir").json(folder)


def fingerprint(spark: SparkSession, inputs: list[str], **settings: object) -> str:
    """SHA-256 of the settings and of each input's files with size and time of change."""
    files = {path: listing(spark, path) for path in sorted(inputs)}
    return hashlib.sha256(json.dumps({"files": files, "settings": settings}, sort_keys=True, default=str).encode()).hexdigest()


def cache_state(spark: SparkSession, folder: str, expected: str) -> tuple[bool, str]:
    """Whether the cache is valid, and why not."""
    base = folder.rstrip("/")
    if not exists(spark, f"{base}/tokens.parquet"):
        return False, "no data"
    side = read_manifest(spark, f"{base}/cache_meta.json")
    if side is None:
        return False, "no sidecar"
    row = side.first()
    if row is None or row.fingerprint != expected:
        return False, "fingerprint differs"
    return True, "valid"


def materialize(build: Callable[[], DataFrame], spark: SparkSession, folder: str, expected: str) -> DataFrame:
    """The cached sequences; built and published by a rename if the cache is not valid. No rows are an error."""
    base = folder.rstrip("/")
    valid, _ = cache_state(spark, base, expected)
    if not valid:
        fresh = f"{base}/.building-{uuid.uuid4().hex}"
        build().write.parquet(fresh)
        count = spark.read.parquet(fresh).count()
        if count == 0:
            delete(spark, fresh)
            raise ValueError("no sequence to cache")
        old = f"{base}/.replaced-{uuid.uuid4().hex}"
        if exists(spark, f"{base}/tokens.parquet"):
            rename(spark, f"{base}/tokens.parquet", old)  # kept until the new one is in its place
        rename(spark, fresh, f"{base}/tokens.parquet")
        delete(spark, old)
        write_manifest(spark.createDataFrame([(expected, count)], "fingerprint string, count bigint"), f"{base}/cache_meta.json")
    return spark.read.parquet(f"{base}/tokens.parquet")


def prune_checkpoints(spark: SparkSession, folder: str, keep: int, run: str = "*") -> int:
    """Deletes all but the newest `keep` folders step-N of each run, complete or not, and says how many. Folders of other names stay;
    0 keeps all. One that cannot be deleted is reported and stays."""
    if keep < 0:
        raise ValueError("keep is not negative")
    gone = 0
    for path in [r.path for r in expired_checkpoints(scan_checkpoints(spark, folder, run), keep).collect()] if keep else []:
        try:
            delete(spark, path)
            gone += 1
        except Exception as e:  # noqa: BLE001  any file system's own error
            log.warning("cannot delete %s: %s", path, e)
    return gone


_METRICS = "run string, step bigint, metric string, value double"


def stream_metrics(stream: DataFrame, path: str, checkpoint: str, name: str = "stream") -> None:
    """Writes a stream of (run, step, metric, value) rows, all that is available, for `read_history`.

    A batch has a folder of its own, named by the stream's `name` and its number, so that a batch that is written again after a
    failure, or by a stream that starts anew over the same input, replaces itself. A failing batch stops the stream,
    as the next start repeats it. Two streams at one time need two names."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.select("run", F.col("step").cast("bigint"), "metric", F.col("value").cast("double")).write.mode("overwrite").parquet(f"{path}/writer={name}/flush={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class MetricSink:
    """Keeps (run, step, metric, value) rows and writes those of `every` steps at a time; close() writes the rest.

    Each flush is a folder of its own, numbered on from those that are there, so a repeated one changes nothing for
    `read_history`, which takes the latest value that a run has for a step: a run that goes on from a checkpoint replaces
    the steps after it. A failing backend is reported three times and never stops a run; its rows are kept for the next flush."""

    def __init__(self, spark: SparkSession, path: str, run: str, every: int = 100):
        self.spark, self.path, self.run, self.every, self.failures = spark, path.rstrip("/"), run, every, 0
        self.rows: list[tuple[str, int, str, float]] = []
        self.steps = 0
        self.folder = f"{self.path}/writer={hashlib.sha256(run.encode()).hexdigest()[:32]}"
        self.flushes: int | None = None

    def log(self, metrics: dict[str, float], step: int) -> None:
        try:
            self.rows += [(self.run, step, k, float(v)) for k, v in {**metrics, "train/global_step": step}.items()]
        except (TypeError, ValueError) as e:
            self._warn(e)
        self.steps += 1
        if self.steps % self.every == 0:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        try:
            if self.flushes is None:
                self.flushes = 1 + max((int(name.rsplit("=", 1)[1]) for name, _, _ in listing(self.spark, self.folder)), default=-1)
            self.spark.createDataFrame(self.rows, _METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/flush={self.flushes}")
            self.rows, self.flushes = [], self.flushes + 1
        except Exception as e:  # noqa: BLE001  metrics never stop a run
            self._warn(e)

    def close(self) -> None:
        self.flush()

    def _warn(self, e: Exception) -> None:
        self.failures += 1
        if self.failures <= 3:
            log.warning("metrics not written: %s", e)

    def __enter__(self) -> MetricSink:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
