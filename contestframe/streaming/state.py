"""Previous-value state of micro-batches, kept in the JVM as tables.

A stateful step is a function of a micro-batch and of the state that the batch before it left. State tables are
written once per batch, under the batch's number, and so is the result. A batch that runs again after a failure or a
restart reads the state of its predecessor and overwrites its own folders, so it gives the same rows. Two
versions of a state table stay, older ones are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from contestframe.session import shared_dir


class BatchState:
    """Named tables as a batch finds them (`before`) and leaves them (`after`)."""

    def __init__(self, spark: SparkSession, home: str, number: int):
        self.spark, self.home, self.number = spark, home, number

    def _path(self, name: str, number: int) -> str:
        return f"{self.home}/state/{name}/batch_id={number}"

    def before(self, name: str, schema: str) -> DataFrame:
        """The table after the previous batch; empty for the first one."""
        if self.number == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, self.number - 1))

    def after(self, name: str, df: DataFrame) -> None:
        """The table for the next batch."""
        df.write.mode("overwrite").parquet(self._path(name, self.number))
        if self.number > 1:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, self.number - 2))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def written(self, name: str, df: DataFrame) -> DataFrame:
        """The rows as a table of this batch, read back: steps that use rows twice compute them once."""
        path = f"{self.home}/work/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


Step = Callable[[DataFrame, BatchState], DataFrame]


def stream_home(spark: SparkSession) -> str:
    """A fresh folder for checkpoint, state and results of one stream."""
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def run_steps(stream: DataFrame, step: Step, home: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Runs an append stream over what is available, each micro-batch through `step`; returns all result rows.

    With the `home` of an earlier run the stream goes on where that run ended.
    """
    spark = stream.sparkSession
    home = home or stream_home(spark)
    shape: list[T.StructType] = []

    def one(batch: DataFrame, number: int) -> None:
        out = step(batch, BatchState(spark, home, number))
        shape[:] = [out.schema]
        out.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{home}/out/batch_id={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    reader = spark.read.option("basePath", f"{home}/out")
    return (reader.schema(shape[0].add("batch_id", T.LongType())) if shape else reader).parquet(f"{home}/out").drop("batch_id")
