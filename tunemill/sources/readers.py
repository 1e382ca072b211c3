"""Readers: data sets by path or name, prepared files, token caches, logs, evaluation sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tunemill.functions.runs import Runs
from tunemill.session import written

PREPARED, EVAL = "prepared_data", "eval_data"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    a, fs = _fs(spark, source)
    b, _ = _fs(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of the files of a folder, or of the file itself; by path."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside the old one, as path.new, and puts it in its place; a crash leaves one of the two."""
    p, fs = _fs(spark, f"{path}.new")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    delete(spark, path)
    rename(spark, f"{path}.new", path)


@dataclass
class Registry:
    """Names of data sets that are no paths: a catalog table or a path for each (name, split)."""

    names: dict[tuple[str, str], str] = field(default_factory=dict)

    def add(self, name: str, target: str, split: str = "train") -> None:
        self.names[name, split] = target

    def find(self, name: str, split: str) -> str:
        return self.names.get((name, split), name)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a broken one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def resolve(spark: SparkSession, dataset: str, split: str = "train", registry: Registry | None = None, streaming: bool = False, schema: StructType | str | None = None) -> DataFrame:
    """A folder with prepared data, a .parquet, .jsonl or .json path, or a registered name or catalog table."""
    target = (registry or Registry()).find(dataset, split)
    if streaming:
        reader = spark.readStream.schema(schema or resolve(spark, dataset, split, registry).schema)
        return reader.json(target) if target.endswith((".jsonl", ".json")) else reader.parquet(target)
    if target.endswith(".parquet"):
        return spark.read.parquet(target)
    if target.endswith(".jsonl"):
        return read_jsonl(spark, target, schema)
    if target.endswith(".json"):
        return read_json_array(spark, target, schema)
    if "/" in target and exists(spark, target):
        found = find_prepared(spark, target)
        if found is None:
            return spark.read.parquet(target)
        return resolve(spark, found, split, registry, schema=schema)
    return spark.table(target)


def find_prepared(spark: SparkSession, folder: str, name: str = PREPARED) -> str | None:
    """The prepared file of a folder, Parquet before JSON lines."""
    for suffix in (".parquet", ".jsonl"):
        path = f"{folder.rstrip('/')}/{name}{suffix}"
        if exists(spark, path):
            return path
    return None


def first_read(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of the files, the same ones each time."""
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")


def read_history(spark: SparkSession, path: str, metric: str = "train/loss", step: str = "train/global_step") -> DataFrame:
    """(run, step, value) of a metric from the rows that a MetricSink or stream_metrics wrote, or from a table with a column for
    each metric; steps without the metric, or with NaN, are left out. Of several values that flushes have for a step, the
    latest flush's counts, of those within one the largest."""
    rows = spark.read.parquet(path)
    if "flush" in rows.columns:
        of = rows.filter(F.col("metric") == metric)
        return of.groupBy("run", "step").agg(F.max(F.struct("flush", "value"))["value"].alias("value")).na.drop(subset=["value"])
    if "metric" in rows.columns:
        return rows.filter(F.col("metric") == metric).select("run", "step", "value").na.drop(subset=["value"])
    run = F.col("run") if "run" in rows.columns else F.lit("")
    if step not in rows.columns:  # rows count as steps, from 0, in the order of the files
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), run.alias("_of"))
        rows = Runs(rows, "_of", ["_file", "_row"]).number("_step").select({"_step": F.col("_step") - 1}).frame()
    at = F.col(f"`{step}`") if step in rows.columns else F.col("_step")
    return rows.select(run.alias("run"), at.cast("bigint").alias("step"), F.col(f"`{metric}`").alias("value")).na.drop(subset=["value"])


def read_eval_source(spark: SparkSession, source: dict, schema: StructType | str) -> DataFrame:
    """One evaluation source; a name that cannot be read falls back to its local JSON lines, else to no rows.

    A mode other than chat or text gives no rows."""
    empty = spark.createDataFrame([], schema)
    if source.get("mode", "chat") not in ("chat", "text"):
        return empty
    for path in (source.get("dataset"), source.get("local")):
        if path:
            try:
                return resolve(spark, path, source.get("split", "test"), schema=schema).transform(first_read, int(source.get("samples", 200)))
            except (AnalysisException, OSError):
                continue
    return empty


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line, its number within the file from 1, and the file. A file of any length is numbered by ranges of its lines, in as many tasks as read it."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    numbered = Runs(written(lines, "log-lines"), "file", ["_block", "_row"]).number("no").frame()
    return numbered.select("line", "no", "file")


#: Files of which one at least stands in a checkpoint that was written to its end. Fixed values.
MARKERS = ("training_meta.json", "dcp/.metadata", "model/model.safetensors.index.json")


def scan_checkpoints(spark: SparkSession, folder: str, run: str = "*", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(run, step, path, complete) of the folders step-N below the runs of a folder, or below one run; complete if a marker is there.

    Folders of other names are left out. Folders are listed on the driver, no file is opened. No folder gives no rows."""
    p, fs = _fs(spark, f"{folder.rstrip('/')}/{run}/step-*")
    rows = []
    for s in fs.globStatus(p) or []:
        name, path = s.getPath().getName(), s.getPath().toString()
        number = name.split("-")[1]
        if s.isDirectory() and number.isascii() and number.isdigit():
            rows.append((s.getPath().getParent().getName(), int(number), path, any(exists(spark, f"{path}/{m}") for m in markers)))
    return spark.createDataFrame(rows, "run string, step bigint, path string, complete boolean")


def latest_checkpoint(checkpoints: DataFrame, marker: str = "complete") -> DataFrame:
    """(run, step, path, marker): the newest marked checkpoint of each run."""
    return checkpoints.filter(marker).groupBy("run").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))
