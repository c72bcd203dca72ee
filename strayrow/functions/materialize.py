"""Cut lineage through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a slim table that one task reads, at most.
SLIM_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a scratch folder only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strayrow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
        return context.getCheckpointDir()
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there.

    Used where one intermediate result feeds several jobs. The copy survives the loss of
    executors and gives every later pass the same bits.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin_table(df: DataFrame, name: str = "table") -> DataFrame:
    """The same as a Parquet table, for wide rows that later passes read a few columns of."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most ``rows`` rows at once; for wide rows.

    The setting is the session's and is put back; a smaller one stays. It binds only what is written
    inside, not frames that are returned.
    """
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= rows:  # 0 and less: no limit
        spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """Tables of one run in a folder of their own below the shared one, dropped by name.

    A loop keeps the table that its next round reads and drops the one before it, once the
    successor is written whole.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._folder = new_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name`` and continue from there."""
        path = os.path.join(self._folder, name)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def keep_slim(self, df: DataFrame, name: str) -> DataFrame:
        """The same for rows of a few numbers: later steps read up to SLIM_ROWS of them in a task, so
        that the many steps of a loop over a small table do not leave as many files each."""
        kept = self.keep(df, name)
        return kept.coalesce(1 + kept.count() // SLIM_ROWS)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self._spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(os.path.join(self._folder, name))
            settings = self._spark.sparkContext._jsc.hadoopConfiguration()
            path.getFileSystem(settings).delete(path, True)
