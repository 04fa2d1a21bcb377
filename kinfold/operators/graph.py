"""Connected components of an undirected edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.storage import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every vertex of an edge; ``component`` is its smallest reachable vertex.

    Each round sends labels over the edges and over the shortcut vertex -> label, so chains halve
    (pointer jumping) and the number of rounds is logarithmic in the diameter. A round is one equi-join and
    one partial aggregate; its table is written to the shared folder, which cuts the lineage and
    survives lost executors, and the last round's is deleted. Rows with a null end and loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(
        both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component"), F.lit(True).alias("moved")),
        "cc-labels",
    )
    while not labels.where("moved").isEmpty():
        hops = both.unionByName(labels.select(F.col("id").alias("u"), F.col("component").alias("v")))
        heard = hops.join(labels.select(F.col("id").alias("v"), "component"), "v").select("u", "component", F.lit(None).cast(labels.schema["id"].dataType).alias("old"))
        own = labels.select(F.col("id").alias("u"), "component", F.col("component").alias("old"))
        last, labels = labels, materialize(
            heard.unionByName(own).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("component"), F.max("old").alias("old")).select("id", "component", (F.col("component") < F.col("old")).alias("moved")),
            "cc-labels",
        )
        release(last)
    release(both)
    return labels.select("id", "component")
