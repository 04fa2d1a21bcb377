"""Headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the threads.

BENCH_SHARED_PHONE=4000,8000 measures, in place of these, so many contacts that share one phone: seconds of the scored
pairs, of everything up to the review queue and the merged list, and the JVM's greatest resident memory so far; one JSON line a case.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.model import CONTACT
from kinfold.plans.queries import QUERIES
from kinfold.plans.resolution import Resolution

NAMES = ["candidate_pairs", "scored_pairs", "merged_contacts", "review_queue", "prune_split", "calibration_bands"]


def shared_phone(spark: SparkSession, n: int) -> DataFrame:
    """``n`` contacts of different names, half of either source, with one phone."""
    i = F.col("id").cast("string")
    columns = {
        "idx": F.col("id").cast("int"), "source": F.when(F.col("id") < n // 2, "icloud").otherwise("google"), "family_name": F.concat(F.lit("Family"), i), "given_name": F.concat(F.lit("Given"), i),
        "formatted_name": F.concat(F.lit("Given"), i, F.lit(" Family"), i), "org": F.concat(F.lit("Company"), F.expr("id % 100").cast("string")),
        "phones": F.array(F.struct(F.lit("(212) 555-0142").alias("number"), F.lit("").alias("type"))), "emails": F.array(F.struct(F.concat(F.lit("user"), i, F.lit("@example.com")).alias("address"), F.lit("").alias("type"))),
        "addresses": F.array().cast(CONTACT["addresses"].dataType), "photo": F.lit(None).cast("binary"), "extra": F.create_map().cast("map<string,array<string>>"),
    }
    return spark.range(n).select(*(columns.get(f.name, F.lit("")).alias(f.name) for f in CONTACT.fields))


def jvm_peak_mb(spark: SparkSession) -> int:
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/status") as f:
        return next(int(line.split()[1]) // 1024 for line in f if line.startswith("VmHWM"))


def measure_shared_phone(spark: SparkSession, n: int) -> dict[str, float]:
    start = time.perf_counter()
    r = Resolution(shared_phone(spark, n))
    pairs = r.scored.count()
    scored = time.perf_counter()
    for df in (r.review_queue, r.output):
        df.write.format("noop").mode("overwrite").save()
    return {"contacts": n, "pairs": pairs, "scored_sec": round(scored - start, 3), "merge_sec": round(time.perf_counter() - start, 3), "jvm_peak_mb": jvm_peak_mb(spark)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if sizes := os.environ.get("BENCH_SHARED_PHONE"):
        QUERIES["prune_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        for n in sizes.split(","):
            print(json.dumps({"metric": "shared_phone", **measure_shared_phone(spark, int(n))}), flush=True)
        spark.stop()
        return
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    took = {}
    QUERIES["prune_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in NAMES:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
