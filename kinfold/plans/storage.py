"""Shared storage for intermediate tables.

Everything that must outlive a task (cut lineage, index files, ledgers) goes below the folder named
by ``spark.checkpoint.dir``: it is the one place that the driver and every executor can see, so a
lost executor never takes data with it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is configured and the driver's process runs all tasks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/kinfold/{spark.sparkContext.applicationId}"


def purge(spark: SparkSession) -> None:
    """Delete everything that this application has stored below the shared folder; its DataFrames end with it."""
    delete(spark, _own_root(spark))


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, work is done once."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once nothing that is still to run reads it."""
    for df in stored:
        delete(df.sparkSession, df.stored_at)


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and Path of ``path`` (driver side; works for every scheme Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder, atomically where the file system can; False, and nothing is moved, if the target is already there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p, q = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    # An empty list of options: unlike FileSystem.rename, this never moves the source into a target that exists.
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(p, q, spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as e:
        if exists(spark, target):
            return False
        raise e
    return True


def small_arrow_batches(spark: SparkSession) -> None:
    """Python workers get texts in batches of a few MB, unless the session has a setting of its own. This holds for the
    session from then on: batches are sized when a query runs, not when it is built."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(8 << 20))):
        if spark.conf.get(key, usual) in (usual, str(64 << 20), str((1 << 31) - 1), str((1 << 63) - 1)):
            spark.conf.set(key, value)
