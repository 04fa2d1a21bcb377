"""Delta-maintained token-count rollups by source, language and tokenizer version.

A *batch* is a set of signed events: ``+1`` inserts a document's count, ``-1`` deletes it, and a revised count is a
``-1`` of the old value with a ``+1`` of the new one. A batch is summed by key (a partial aggregate, so a source with
a third of all rows stays spread out) and its sums are committed under the batch's id by one rename that fails if the id
is taken. Totals are the sums over all committed batches. A batch id that is there already is skipped, so a retry, a
replay or the later of two commits at once changes nothing; a batch that fails before its rename leaves nothing that
counts. ``compact`` publishes a snapshot
with the sums of all batches so far and their ids, again by one rename; totals are the last snapshot's sums and the
batches that it does not name.

Defined results: null source, language or version are keys of their own; a null sign or count is 0; a null text has
0 tokens. Rows that repeat an id, and rows without one, count once each. Groups whose documents cancel out stay with
zeros. Of a text's copies the row with the smallest doc_id counts (without an id: after all others), ties going to the
smallest source, language, version and count. Other columns are ignored, whatever their names. No batches, or empty
ones, give an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe
from kinfold.plans.storage import delete, exists, hadoop_fs, materialize, rename

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_events bigint"


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Events that replace the count in column ``old`` by that in ``new``."""
    was = counts.withColumn("n_tokens", F.col(old)).withColumn("sign", F.lit(-1))
    return was.unionByName(counts.withColumn("n_tokens", F.col(new)).withColumn("sign", F.lit(1)))


@dataclass
class Rollup:
    """A rollup in a folder: committed sums below ``batches``, snapshots of them below ``snapshots``."""

    spark: SparkSession
    path: str

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batches/{quote(batch_id, safe='')}"

    def batches(self) -> list[str]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/batches")
        return sorted(unquote(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply ``events`` (the keys, ``n_tokens`` and ``sign``) once; False if the id was committed before."""
        if exists(self.spark, self._batch(batch_id)):
            return False
        sign, tokens = F.coalesce("sign", F.lit(0)).cast("long"), F.coalesce("n_tokens", F.lit(0)).cast("long")
        sums = events.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * tokens).alias("n_tokens"), F.count("*").alias("n_events"))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        sums.write.parquet(staged)
        fs, p = hadoop_fs(self.spark, f"{self.path}/batches")
        fs.mkdirs(p)
        if rename(self.spark, staged, self._batch(batch_id)):
            return True
        delete(self.spark, staged)
        return False

    def _snapshot(self) -> str | None:
        fs, p = hadoop_fs(self.spark, f"{self.path}/snapshots")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_events`` over all committed batches."""
        last = self._snapshot()
        folded = {r[0] for r in self.spark.read.parquet(f"{last}/ids").collect()} if last else set()
        parts = [self._batch(b) for b in self.batches() if b not in folded] + ([f"{last}/sums"] if last else [])
        rows = self.spark.read.schema(DELTA).parquet(*parts).select(*KEYS, "n_docs", "n_tokens", "n_events") if parts else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_events")))

    def compact(self) -> None:
        """Publish a snapshot of all batches committed so far; their ids stay known, so replays are still skipped."""
        ids, last = self.batches(), self._snapshot()
        if not ids:
            return
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in ids], "batch_id string").write.parquet(f"{staged}/ids")
        fs, p = hadoop_fs(self.spark, f"{self.path}/snapshots")
        fs.mkdirs(p)
        if not rename(self.spark, staged, f"{self.path}/snapshots/{int(last.rpartition('/')[2]) + 1 if last else 0:08d}"):
            delete(self.spark, staged)  # another one has published this snapshot


def count_corpus(docs: DataFrame, tokenizer: str, version: str, path: str) -> DataFrame:
    """Totals of ``docs`` after three batches and a replay: inserts with counts estimated from the texts' lengths,
    revisions to exact counts, deletes of exact copies (all but the smallest doc_id of a text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "lang", "text")
    known = docs.select("doc_id", "source", "lang", "text", F.lit(version).alias("tokenizer"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("estimate"))
    counts = materialize(bpe.count(known, tokenizer, ("doc_id", *KEYS, "key", "estimate")), "token-counts")
    rollup = Rollup(spark, path)
    first = inserts(counts.withColumn("n_tokens", F.col("estimate")))
    rollup.commit("insert", first)
    rollup.commit("revise", revisions(counts, "estimate", "n_tokens"))
    rollup.commit("insert", first)
    # Of a text's rows, one with the smallest doc_id stays. Per key and group, that is "all, less the kept one":
    # one row a text survives the partial aggregate, however many copies there are.
    one = counts.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), *KEYS, "n_tokens")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    groups = counts.groupBy("key", *KEYS, "n_tokens").agg(F.count("*").alias("n")).join(one.select("key"), "key", "left_semi")
    gone = deletes(groups.select(*KEYS, "n_tokens", "n")).withColumn("sign", -F.col("n"))
    back = inserts(one.select(*(F.col(f"kept.{c}").alias(c) for c in (*KEYS, "n_tokens")), F.col("n")))
    rollup.commit("delete-copies", gone.select(*KEYS, "n_tokens", "sign").unionByName(back.select(*KEYS, "n_tokens", F.col("sign").cast("long"))))
    return rollup.totals()
