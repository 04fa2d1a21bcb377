"""Clusters from scored pairs.

Evidence edges form connected components. Edges that rest on a near name alone join only contacts that no evidence
touches, one partner each: the greedy matching over a strict total order. ``rows`` are the cards by key of the resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import pairwise, scoring
from kinfold.operators.graph import connected_components
from kinfold.plans.storage import materialize, release


#: Edges of a component that one round of the matching looks at.
PREFIX = 500_000


def evidence_components(rows: DataFrame) -> DataFrame:
    """``idx, cluster`` (smallest member) of contacts that evidence joins."""
    return connected_components(scoring.evidence_edges(rows), "a", "b").select(F.col("id").alias("idx"), F.col("component").alias("cluster"))


def match_near_names(rows: DataFrame, attached: DataFrame) -> DataFrame:
    """``a, b`` of the matched near-name pairs of contacts that no evidence touches: by score, across sources first, then by
    index.

    The components of these pairs are matched apart. A round takes the best ``PREFIX`` pairs of each in order and drops the
    pairs that touch what it matched, so what it has looked at is settled for good.
    """
    free = materialize(rows.join(attached.select("idx").hint("merge"), "idx", "left_anti"), "free")
    edges = materialize(scoring.near_pairs(free), "near-edges")
    matched = edges.select("a", "b").limit(0)
    if edges.isEmpty():
        return matched
    component = connected_components(edges, "a", "b")
    edges, first = materialize(edges.join(component.select(F.col("id").alias("a"), "component"), "a"), "near-edges"), edges
    release(first)
    best = Window.partitionBy("component").orderBy(F.desc("score"), "same", "a", "b")
    while not edges.isEmpty():
        head = edges.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= PREFIX).drop("__k")
        taken = materialize(head.groupBy("component").applyInArrow(pairwise.greedy, matched.schema), "near-matched")
        matched = matched.unionByName(taken)
        ends = taken.select(F.explode(F.array("a", "b")).alias("end"))
        edges, last = materialize(edges.join(ends.select(F.col("end").alias("a")), "a", "left_anti").join(ends.select(F.col("end").alias("b")), "b", "left_anti"), "near-edges"), edges
        release(last)
    release(edges)
    return matched


def members(rows: DataFrame) -> DataFrame:
    """``idx, cluster`` of all clustered contacts; a cluster is named by its smallest member."""
    evidence = materialize(evidence_components(rows), "evidence")
    pairs = materialize(match_near_names(rows, evidence), "matched")
    return evidence.unionByName(pairs.select(F.col("a").alias("idx"), F.col("a").alias("cluster"))).unionByName(pairs.select(F.col("b").alias("idx"), F.col("a").alias("cluster")))


def with_column(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` of the contacts in ``more``, with what it says of them. Stored, as several branches read it; and never broadcast:
    a table that is small as Parquet can be a large one on the driver."""
    return materialize(rows.join(more.hint("merge"), "idx"), "rows")


def cluster_summary(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``cluster, size, pairs, min_score, max_score, auto`` and the ``best`` pair: automatic where every pair of members is
    scored and ``auto_merge``. Scored pairs are counted against k(k-1)/2, so no pair is looked up that does not exist."""
    stats = scoring.inside(with_column(rows, placed))
    best = F.struct("score", "a", "b", "tier", "name_similarity", *scoring.FLAGS).alias("best")
    stats = stats.select("cluster", "pairs", "min_score", F.col("score").alias("max_score"), F.col("auto").alias("all_auto"), best)
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(stats, "cluster", "left").select(
        "cluster", "size", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.least(F.coalesce("min_score", F.lit(1.0)), F.lit(1.0)).alias("min_score"), "max_score",
        (F.coalesce("all_auto", F.lit(False)) & (2 * F.col("pairs") == F.col("size") * (F.col("size") - 1))).alias("auto"), "best",
    )


def deferred(rows: DataFrame, placed: DataFrame, contacts: DataFrame) -> DataFrame:
    """Near-name edges between different groups, the best of each two groups: ``score, side_a, side_b`` with the
    members of both (``side_a`` has the smaller first index)."""
    group = contacts.select("idx").join(placed, "idx", "left").select("idx", F.coalesce("cluster", "idx").alias("g"))
    best = scoring.near_groups(with_column(rows, group))
    sides = group.groupBy("g").agg(F.array_sort(F.collect_list("idx")).alias("side"))
    return best.join(sides.select(F.col("g").alias("ga"), F.col("side").alias("side_a")), "ga").join(sides.select(F.col("g").alias("gb"), F.col("side").alias("side_b")), "gb").select("score", "side_a", "side_b")


def unclustered(contacts: DataFrame, placed: DataFrame) -> DataFrame:
    return contacts.join(placed.select("idx"), "idx", "left_anti")


def cluster_ids(placed: DataFrame, contacts: DataFrame) -> DataFrame:
    """``cluster, cluster_id``: the first 16 hex digits of the SHA-256 over the members as written."""
    key = F.concat_ws(":", "source", F.col("idx").cast("string"), "family_name", "given_name")
    listed = placed.join(contacts.select("idx", "source", "family_name", "given_name"), "idx").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("idx", key.alias("key")))).alias("m"))
    return listed.select("cluster", F.substring(F.sha2(F.array_join(F.transform("m", lambda x: x["key"]), "|"), 256), 1, 16).alias("cluster_id"))

