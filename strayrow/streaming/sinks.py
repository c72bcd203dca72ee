"""Where streams come from and where they go."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def read_files(
    spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the Parquet files that lie in a folder, or come to lie there, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each row once to the Parquet table ``path``; its log leaves out unfinished batches."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**_trigger(trigger)).start()


class BatchTable:
    """A Parquet table with one folder for each batch of a stream.

    A batch that is run again after a failure gets the same number and the same rows, and replaces
    its own folder, so nothing is counted twice; ``write`` may be called any number of times.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, f"{BATCH}={batch}"))

    def start(
        self, stream: DataFrame, checkpoint: str, mode: str = "append", trigger: dict | None = None
    ) -> StreamingQuery:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        return writer.foreachBatch(self.write).trigger(**_trigger(trigger)).start()

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows with the number of their batch."""
        typed = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        return spark.read.schema(typed).parquet(self.path)

    def latest(self, spark: SparkSession, schema: T.StructType, key: list[str]) -> DataFrame:
        """The last state of each key, for batches that bring updates."""
        values = [f.name for f in schema.fields if f.name not in key]
        last = F.max_by(F.struct(*values), BATCH).alias("last")
        return self.read(spark, schema).groupBy(*key).agg(last).select(*key, "last.*")


def _trigger(given: dict | None) -> dict:
    """Work off what is there and stop, unless another trigger is asked for."""
    return given or {"availableNow": True}
