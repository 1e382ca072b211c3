"""Session and scratch-space helpers shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tunemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map={**base, **conf}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, a local one for a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tunemill-scratch-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: lineage is cut, and a lost executor loses nothing.

    With `by`, rows of each value of that column go to a folder of their own."""
    path = f"{scratch_dir(df.sparkSession)}/tunemill-{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if its files give fewer tasks than these; larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What may be sent to every executor: so many rows, and so many bytes of values.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _bytes(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    return F.lit(8) if "<" not in kind else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """df, a written table, marked for broadcast if rows and bytes show that it is small; else itself, to be shuffled."""
    if df.count() > BROADCAST_ROWS:
        return df
    size = df.agg(F.sum(reduce(Column.__add__, (_bytes(df, c) for c in df.columns), F.lit(0).cast("long"))).alias("n")).first().n
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
