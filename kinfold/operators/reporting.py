"""Reports: conflicts, ambiguity texts, summary, review queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinfold import model as M
from kinfold.functions import text as X
from kinfold.operators import scoring
from kinfold.operators.clustering import with_column


@F.pandas_udf(StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """C-style ``%.2f``: the exact binary value, half to even."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def conflicts(placed: DataFrame, contacts: DataFrame) -> DataFrame:
    """``cluster, field, icloud, other``: values of the first card of either side that differ; icloud's is kept."""
    one = placed.join(contacts, "idx").groupBy("cluster")
    card = F.struct("idx", "formatted_name", "org", "title", "birthday", "note")
    sides = one.agg(F.min(F.when(F.col("source") == "icloud", card)).alias("x"), F.min(F.when(F.col("source") != "icloud", card)).alias("y")).where("x is not null and y is not null")
    agree = X.birthdays_agree(X.birthday_parts(F.col("x.birthday")), X.birthday_parts(F.col("y.birthday")))
    fields = [("FN", "formatted_name"), ("ORG", "org"), ("TITLE", "title"), ("BDAY", "birthday"), ("NOTE", "note")]
    rows = sides.select("cluster", agree.alias("agree"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"x.{c}").alias("icloud"), F.col(f"y.{c}").alias("other")) for n, c in fields))).alias("f"))
    return rows.select("cluster", "agree", "f.*").where("icloud <> '' and other <> '' and icloud <> other and not (field = 'BDAY' and agree)").drop("agree")


def best_pairs(summary: DataFrame) -> DataFrame:
    """``cluster, score, a, b`` and the features of each cluster's best pair (the first of equal scores)."""
    return summary.where("best is not null").select("cluster", "best.*")


def ambiguity_rows(rows: DataFrame, placed: DataFrame, contacts: DataFrame) -> DataFrame:
    """``cluster, a, b, said``: every scored pair of a cluster in words, a row each."""
    return scoring.said(with_column(rows, placed.join(contacts.select("idx", X.display_name().alias("name")).hint("merge"), "idx")))


def view_mode(size: Column, score: Column, conflict: Column, unknown: Column) -> Column:
    return F.when((size > 2) | conflict | unknown, "detailed").when(score >= M.REVIEW_SCORE, "compact").otherwise("detailed")


def review_queue(summary: DataFrame, best: DataFrame, ids: DataFrame) -> DataFrame:
    """``cluster, cluster_id, size, score, min_score, view_mode``: clusters for a person, the best score first."""
    open_ = summary.where(~F.col("auto")).join(best.drop("score"), "cluster").join(ids, "cluster")
    mode = view_mode(F.col("size"), F.col("max_score"), F.col("birthday_conflict"), F.col("birthday_unknown"))
    return open_.select("cluster", "cluster_id", "size", F.col("max_score").alias("score"), "min_score", mode.alias("view_mode"), F.lit("pending").alias("decision")).orderBy(F.desc("score"), "cluster_id")


def report_summary(contacts: DataFrame, summary: DataFrame, distinct: DataFrame, deferred: DataFrame, warnings: int = 0) -> DataFrame:
    """One row of totals."""
    total = contacts.agg(F.count_if(F.col("source") == "icloud").alias("total_icloud"), F.count_if(F.col("source") == "google").alias("total_google"))
    routed = summary.agg(F.count_if("auto").alias("auto_merged"), F.count_if(~F.col("auto")).alias("needs_review"))
    one = distinct.agg(F.count("*").alias("distinct_contacts"))
    late = deferred.agg(F.count("*").alias("deferred"))
    return total.crossJoin(routed).crossJoin(one).crossJoin(late).withColumn("warnings", F.lit(warnings).cast("long"))
