"""The registered queries of this subpackage: ``QUERIES`` by name, and ``ORACLE_SQL`` where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from kinfold.llm import bpe, decontaminate, langid, line_dedup, matroska, near_dedup, secrets, token_rollup, toxicity, warc
from kinfold.plans.storage import materialize, new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.count_corpus(_table(spark, sf_dir, "documents"), TOKENIZER, "byte_bpe_50k", new_path(spark, "token-rollup"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(~held_out("doc_id", 4, 2))))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(materialize(matroska.store(_table(spark, sf_dir, "documents")), "media"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_token_rollup, op4_decontaminate, op5_secrets, op6_warc, op7_langid, op8_matroska, op9_near_dedup, op10_line_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.oracle_sql(),
    "op5_secrets": secrets.oracle_sql(),
    "op6_warc": warc.oracle_sql(),
    "op9_near_dedup": near_dedup.oracle_sql(3, 0.85),
    "op10_line_dedup": line_dedup.oracle_sql(),
}
