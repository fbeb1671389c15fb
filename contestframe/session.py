"""Session settings the operators are written for."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

HOTSPOT_LIMIT = 8000  # bytes of a method's code that HotSpot still compiles


def get_spark(app: str = "contestframe", master: str | None = None, **extra: str) -> SparkSession:
    """Session with UTC, AQE and skew joins; local runs pass `master`."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = "".join(ch for ch in master if ch.isdigit()) or str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", cores)
        )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(spark: SparkSession, rows: int, limit: int, task_rows: int) -> int | None:
    """Number of tasks for a table of so many rows, one for each `task_rows`; None up to `limit` rows.

    The session's shuffle partitions are raised to it, never lowered: with a number that was set for smaller tables, the rows
    and so the memory of a task would grow with the input. Adaptive execution joins partitions that stay small.
    """
    if rows <= limit:
        return None
    need = -(-rows // task_rows)
    if need > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
    return need


def compiled(spark: SparkSession) -> None:
    """Lets Spark run the operators of a stage apart where the code of all of them is longer than the JVM compiles.

    HotSpot interprets a method of more than 8,000 bytes for ever, and the code of one stage over some fifty columns is such
    a method; Spark's own limit is eight times as high. A lower limit of the session stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > HOTSPOT_LIMIT:
        spark.conf.set(name, str(HOTSPOT_LIMIT))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="contestframe-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back; a garbage collection lets Spark delete the shuffle files behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def in_turn(*writers: Callable[[DataFrame], DataFrame]) -> list[Callable[[DataFrame], DataFrame]]:
    """The writers for steps that read only the table of the step before: each call deletes the table of the last call of any of them."""
    last: list[DataFrame] = []

    def turn(write: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(df: DataFrame) -> DataFrame:
            out = write(df)
            while last:
                discard(last.pop())
            last.append(out)
            return out

        return run

    return [turn(w) for w in writers]


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` wrote and nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage and fixes the rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
