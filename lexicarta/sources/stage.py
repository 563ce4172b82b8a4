"""The folder for tables that several jobs read: shared by the driver and all executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
#: Bytes of one Arrow batch that goes to Python.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bytes of a table in Parquet that goes to every task; a larger one is joined by a shuffle.
MOST_SENT = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands batches of bounded bytes to Python from now on, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def shared_root(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder of this process only on a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"file://{_local[0]}"


def staged(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed with ``remove`` or at the end of the process."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def sent(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a staged table, whose size is then known: a join sends it to every task if it is small, instead of dealing the other side out."""
    path = staged(df.sparkSession, label)
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    small = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength() <= MOST_SENT
    return F.broadcast(stored) if small else stored


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged path if it is still there and the session, too."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; what is staged is scratch
        pass
