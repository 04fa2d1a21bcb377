"""The resolution of a contact table, step by step; each step is a DataFrame, shared ones are written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.model import BLOCK_LIMIT, CONTACT, REVIEW_SCORE
from kinfold.operators import blocking, clustering, reporting, scoring, survivorship
from kinfold.operators.normalize import normalize
from kinfold.plans.storage import materialize


class Resolution:
    """``contacts`` has the columns of ``kinfold.model.CONTACT``; ``idx`` is unique and orders ties."""

    def __init__(self, contacts: DataFrame, limit: int = BLOCK_LIMIT, cap: int | None = None, warnings: int = 0) -> None:
        self.source, self.limit, self.cap, self.warnings = contacts, limit, cap, warnings

    @cached_property
    def contacts(self) -> DataFrame:
        return materialize(self.source, "contacts")

    @cached_property
    def norm(self) -> DataFrame:
        return materialize(normalize(self.contacts), "norm")

    @cached_property
    def pairs(self) -> DataFrame:
        return blocking.candidate_pairs(self.norm, self.limit, self.cap)

    @cached_property
    def rows(self) -> DataFrame:
        """The cards by blocking key; what is asked of the pairs is worked out from them, and no table holds all pairs."""
        return materialize(scoring.cards(blocking.keyed(self.norm, limit=self.limit, cap=self.cap)).select("key", "source", "email_keys", "phone_keys", *scoring.CARD), "rows")

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.scored_pairs(self.rows)

    @cached_property
    def placed(self) -> DataFrame:
        return materialize(clustering.members(self.rows), "placed")

    @cached_property
    def summary(self) -> DataFrame:
        return materialize(clustering.cluster_summary(self.rows, self.placed), "summary")

    @property
    def auto_members(self) -> DataFrame:
        return self.placed.join(self.summary.where("auto").select("cluster"), "cluster", "left_semi")

    @property
    def review_members(self) -> DataFrame:
        return self.placed.join(self.summary.where("not auto").select("cluster"), "cluster", "left_semi")

    @property
    def distinct(self) -> DataFrame:
        return clustering.unclustered(self.contacts, self.placed)

    @property
    def merged(self) -> DataFrame:
        """Automatic clusters as one row each, with the least score of their pairs."""
        return survivorship.merge_clusters(self.auto_members, self.contacts).join(self.summary.select("cluster", F.col("min_score").alias("score")), "cluster")

    @property
    def output(self) -> DataFrame:
        """Merged rows and untouched contacts, as contacts with ``sources``, ``merged_from`` and ``score``."""
        alone = self.distinct.withColumns({"cluster": F.col("idx"), "sources": F.array("source"), "merged_from": F.array("idx"), "score": F.lit(0.0)})
        return self.merged.unionByName(alone)

    @property
    def review(self) -> DataFrame:
        """Contacts that wait for a decision, with their cluster and its least score."""
        ids = clustering.cluster_ids(self.review_members, self.contacts)
        return self.review_members.join(self.contacts, "idx").join(ids, "cluster").join(self.summary.select("cluster", F.col("min_score").alias("score")), "cluster")

    @property
    def review_in_order(self) -> DataFrame:
        """``review`` with ``idx`` renumbered from 0 in the report's order: best score down, cluster_id, index."""
        best = self.summary.select("cluster", F.col("max_score").alias("best"))
        ordered = self.review.join(best, "cluster")
        sizes = ordered.groupBy("cluster", "cluster_id", "best").agg(F.count("*").alias("n"))
        before = Window.orderBy(F.desc("best"), "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("cluster", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        within = F.row_number().over(Window.partitionBy("cluster").orderBy("idx")) - 1
        return ordered.withColumn("k", within).join(starts, "cluster").withColumn("idx", (F.col("start") + F.col("k")).cast("int")).drop("k", "start", "best")

    @property
    def deferred(self) -> DataFrame:
        return clustering.deferred(self.rows, self.placed, self.contacts)

    @property
    def conflicts(self) -> DataFrame:
        return reporting.conflicts(self.placed, self.contacts)

    @property
    def review_queue(self) -> DataFrame:
        return reporting.review_queue(self.summary, reporting.best_pairs(self.summary), clustering.cluster_ids(self.placed, self.contacts))

    @property
    def totals(self) -> DataFrame:
        return reporting.report_summary(self.contacts, self.summary, self.distinct, self.deferred, self.warnings)

    def resolve(self, decisions: DataFrame) -> DataFrame:
        """Apply ``cluster, decision`` to the review: ``merge`` gives one row, ``skip`` none (both contacts go), anything
        else all members. With merged rows and untouched contacts: ``kind`` and the contact."""
        decided = self.review_members.join(decisions, "cluster", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
        joined = survivorship.merge_clusters(decided.where("decision = 'merge'").select("idx", "cluster"), self.contacts)
        waiting = decided.where("decision not in ('merge', 'skip')").select("idx", "cluster").join(self.contacts, "idx")
        columns = ["cluster", *[f.name for f in CONTACT.fields]]
        parts = [("merged", self.merged), ("distinct", self.distinct.withColumn("cluster", F.col("idx"))), ("resolved", joined), ("pending", waiting)]
        out = [df.select(*columns).withColumn("kind", F.lit(kind)) for kind, df in parts]
        return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


DERIVED = """
SELECT c_custkey AS idx,
  CASE WHEN side = 0 THEN 'icloud' ELSE 'google' END AS source,
  CASE WHEN p % 10 < 2 THEN 'Smith'
       ELSE concat(split_part('Alder,Birch,Cedar,Dahlin,Elmer,Fisher,Garcia,Harlan,Ibarra,Jensen,Keller,Lennox,Müller,Nguyen,Ortega,Parker,Quill,Rivera,Sorrel,Tanner,Ulmer,Vargas,Weber', ',', CAST(p % 23 + 1 AS INT)),
                   split_part('son,ton,ley,man,berg,wood,field', ',', CAST(p % 7 + 1 AS INT))) END AS family_name,
  split_part(CASE WHEN side = 0 THEN 'Robert,Alice,Wei,María,John,Elizabeth,William,Chris,Jack,Erica,J.R.'
                  ELSE 'Bob,Alice,Wei,Maria,John,Beth,Liam,Chris,John,Eric,J.R.' END, ',', CAST(p % 11 + 1 AS INT)) AS given_name,
  CASE WHEN p % 13 = 0 THEN 'Jr.' WHEN p % 13 = 1 AND side = 1 THEN 'Sr.' ELSE '' END AS suffix,
  CASE WHEN p % 31 = 0 THEN 'unknown'
       WHEN p % 2 = 0 OR side = 0 THEN concat('User', CAST(p AS VARCHAR(20)), '@Example.com ')
       ELSE concat('alt', CAST(p AS VARCHAR(20)), '@example.org') END AS email,
  CASE WHEN p % 29 = 0 THEN '000-000-0000'
       WHEN p % 3 <> 0 OR side = 0 THEN concat(CASE WHEN side = 0 THEN '+1 ' ELSE '' END, '(212) ', CAST(5550000 + p AS VARCHAR(20)))
       ELSE concat('415-', CAST(5550000 + p AS VARCHAR(20))) END AS phone,
  CASE WHEN p % 4 = 0 THEN ''
       WHEN p % 17 = 0 THEN 'born in the fifties'
       WHEN side = 0 THEN concat('19', CAST(50 + p % 50 AS VARCHAR(20)), '-', lpad(CAST(1 + p % 12 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(1 + p % 28 AS VARCHAR(20)), 2, '0'))
       WHEN p % 11 = 0 THEN '10/22/1989'
       ELSE concat('19', CAST(50 + p % 50 AS VARCHAR(20)), lpad(CAST(1 + p % 12 AS VARCHAR(20)), 2, '0'), lpad(CAST(1 + p % 28 AS VARCHAR(20)), 2, '0')) END AS birthday,
  c_mktsegment AS org
FROM (SELECT *, CAST(floor(c_custkey / 2) AS BIGINT) AS p, c_custkey % 2 AS side FROM customer) t
"""


def derived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat contacts derived from ``customer``; the same text runs in DuckDB."""
    return spark.sql(DERIVED.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def derived_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derived_rows(spark, sf_dir)
    empty = F.lit("")
    columns = {
        "idx": F.col("idx").cast("int"), "birthday": X.birthday(F.col("birthday")), "formatted_name": F.concat_ws(" ", "given_name", "family_name"),
        "emails": F.array(F.struct(F.col("email").alias("address"), empty.alias("type"))), "phones": F.array(F.struct(F.col("phone").alias("number"), empty.alias("type"))),
        "addresses": F.array().cast(CONTACT["addresses"].dataType), "photo": F.lit(None).cast("binary"), "extra": F.create_map().cast("map<string,array<string>>"),
    }
    return flat.select(*(columns.get(f.name, F.col(f.name) if f.name in flat.columns else empty).alias(f.name) for f in CONTACT.fields))
