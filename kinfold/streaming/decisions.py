"""The decision log as a stream: the state of each cluster is its latest entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(entries: DataFrame) -> DataFrame:
    """``cluster_id, decision, score`` of each cluster's last entry by time (update mode; an undo is an entry)."""
    last = entries.groupBy("cluster_id").agg(F.max_by(F.struct("decision", "score"), "timestamp").alias("e"))
    return last.select("cluster_id", "e.*")


def rates(entries: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Decisions per time window, final once the watermark passes it."""
    by = entries.withWatermark("timestamp", late).groupBy(F.window("timestamp", window))
    return by.agg(F.count("*").alias("decisions"), F.count_if(F.col("decision") == "merge").alias("merges")).select(F.col("window.start").alias("start"), "decisions", "merges")
