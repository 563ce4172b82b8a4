"""Shared scratch tables: the way every operator here cuts lineage.

Intermediate results that more than one job reads are written as Parquet under
the folder the cluster names in ``spark.checkpoint.dir``, so they outlive any
executor.  Only where that setting is absent (tests, a laptop) a temporary
folder of this process is used.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.stage import shared_root

#: Bytes of one Arrow batch: with a few copies of it in a task, what Python and the network buffers hold stays small.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands batches of bounded bytes to Python, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


class Scratch:
    """One run's folder of Parquet tables; removed at the end of the process, tables earlier by ``drop``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write and read back with the schema at hand (no file listing is inspected for it)."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Free a table that no later job reads."""
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is scratch
            pass
