"""Statistics of a review decision log (``seq, cluster_id, decision, score, view_mode, decision_time_ms``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score bands, lower bound included, and the least suggested threshold.
BANDS = [("0.78-1.00", 0.78, 1.01), ("0.60-0.78", 0.60, 0.78), ("0.50-0.60", 0.50, 0.60), ("0.00-0.50", 0.0, 0.50)]
FLOOR, STEP = 0.50, 0.05


def last_decisions(log: DataFrame) -> DataFrame:
    """The last entry of each cluster in log order, unless it is an undo."""
    last = log.groupBy("cluster_id").agg(F.max_by(F.struct("seq", "decision", "score", "view_mode", "decision_time_ms"), "seq").alias("e"))
    return last.select("cluster_id", "e.*").where("decision <> 'undo'")


def counts(last: DataFrame) -> DataFrame:
    """``total, merges, skips, merge_rate`` and mean times by view (whole milliseconds, 0 without entries)."""

    def mean(mode: str):
        n = F.count_if(F.col("view_mode") == mode)
        return F.when(n > 0, F.expr(f"sum(if(view_mode = '{mode}', decision_time_ms, 0)) div count_if(view_mode = '{mode}')")).otherwise(0).cast("long").alias(f"avg_{mode}_ms")

    merges = F.count_if(F.col("decision") == "merge")
    rate = F.when(F.count("*") > 0, F.expr("count_if(decision = 'merge') * 100 div count(*)")).otherwise(0).cast("long")
    return last.agg(F.count("*").alias("total"), merges.alias("merges"), F.count_if(F.col("decision") == "skip").alias("skips"), rate.alias("merge_rate"), mean("compact"), mean("detailed"))


def bands(last: DataFrame) -> DataFrame:
    """``band, merged, skipped``; bands without entries are left out."""
    band = F.coalesce(*(F.when((F.col("score") >= lo) & (F.col("score") < hi), F.lit(name)) for name, lo, hi in BANDS))
    kept = last.where(F.col("decision").isin("merge", "skip")).withColumn("band", band).where("band is not null")
    return kept.groupBy("band").agg(F.count_if(F.col("decision") == "merge").alias("merged"), F.count_if(F.col("decision") == "skip").alias("skipped"))


def suggestion(last: DataFrame) -> DataFrame:
    """``min_merged, threshold, floor``: the least merged score, cut to hundredths, and a floor below it (null where
    there is nothing to suggest)."""
    least = last.where("decision = 'merge'").agg(F.min("score").alias("min_merged"))
    cut = least.withColumn("threshold", F.floor(F.col("min_merged") * 100) / 100)
    floor = F.greatest(F.col("threshold") - STEP, F.lit(FLOOR))
    return cut.withColumn("floor", F.when(floor < F.col("threshold"), floor))
