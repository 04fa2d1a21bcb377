"""Decision logs: append-only JSON lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

ENTRY = StructType([StructField("seq", LongType()), StructField("cluster_id", StringType()), StructField("decision", StringType()), StructField("score", DoubleType()), StructField("view_mode", StringType()), StructField("decision_time_ms", LongType()), StructField("timestamp", TimestampType())])


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries with ``seq``, their order: by time, then the writer's own number, then what they say (never by place)."""
    rows = spark.read.schema(ENTRY).json(path)
    order = F.struct("timestamp", F.coalesce("seq", F.lit(0)).alias("n"), "decision", "cluster_id", "score", "view_mode", "decision_time_ms")
    return rows.withColumn("seq", order)


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ENTRY).json(path)
