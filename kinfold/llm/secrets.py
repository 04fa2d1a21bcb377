"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text version is content-addressed by its SHA-256. The ledger holds, for each (blob, rule version) pair that
was scanned, its findings; a scan takes only the pairs that the ledger lacks, reads each distinct blob once, appends
its findings as one committed Parquet batch and joins the ledger back to all paths (rows) that hold the blob. A
scan that is repeated after a failure finds what was committed and does the rest.

Spans are native: the text is split at the matches of a rule, the matches are extracted, and the running sum of
both lengths gives code point offsets. Copies of a blob are folded before any text is moved or compared with the
ledger; findings are joined back as stored tables, a join that Spark's adaptive skew join splits, since one blob may be
a third of all rows.

Defined results: a null text is an empty text and has no spans. Rows with null or repeated doc_ids are each
reported as they stand. Further columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.storage import exists, materialize, new_path

# The rules. Kind, pattern, and what is measured against the least length (a group of the pattern).
# A minimum that can be written into the pattern without changing its leftmost non-overlapping matches is there.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Rules beyond the base ones, with a literal that a text must hold before the pattern is tried.
MORE = [
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
]
RULE_VERSION = hashlib.sha256(repr((BASE, MORE)).encode()).hexdigest()[:16]
_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int, literal: str | None = None) -> Column:
    """Spans of one rule in ``text``, in order."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    sizes = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("match"), measured.alias("value")), lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), F.length(m["value"]).alias("value")))

    def step(done: Column, m: Column) -> Column:
        start = done["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), (start + m["size"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + m["size"]).alias("at"), F.when(m["value"] >= least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))
    found = text.rlike(pattern) if literal is None else text.contains(literal) & text.rlike(pattern)
    return F.when(found, F.aggregate(sizes, first, step, lambda x: x["spans"])).otherwise(F.array().cast(_SPANS))


def findings(text: Column) -> tuple[Column, Column]:
    """Base spans and all spans of ``text``, each by start and then kind."""
    base = [_spans(text, n, *rule) for n, rule in enumerate(BASE)]
    more = [_spans(text, len(BASE) + n, *rule) for n, rule in enumerate(MORE)]
    return F.array_sort(F.concat(*base)), F.array_sort(F.concat(*more))


def scan(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """``doc_id, blob, base, more`` (sorted span arrays) of every row; ``ledger`` is a folder that later scans go
    on from (a new one if None)."""
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    paths = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    if exists(spark, ledger):
        seen = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    base, more = findings(F.col("text"))
    blobs.select("blob", F.lit(rule_version).alias("rule_version"), base.alias("base"), more.alias("more")).write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger).where((F.col("rule_version") == rule_version) & ((F.size("base") > 0) | (F.size("more") > 0)))
    # Two scans at once may both have entered a blob; their findings are equal.
    findings_of = materialize(known.dropDuplicates(["blob"]).select("blob", "base", "more"), "findings")
    none = F.array().cast(_SPANS)
    return paths.select("doc_id", "blob").join(findings_of, "blob", "left").select("doc_id", "blob", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    counts = [_count(kind) for kind, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "more"))).alias("spans"))


def _oracle_rule(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    q = pattern.replace("'", "''")
    return f"""SELECT r, i, {number} AS no, '{kind}' AS kind, a AS s, a + length(m[i]) AS e FROM (
      SELECT r, m, v, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a FROM (
        SELECT r, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(t, '{q}') AS m, regexp_extract_all(t, '{q}', {group}) AS v, regexp_split_to_array(t, '{q}') AS g FROM d WHERE regexp_matches(t, '{q}')))) WHERE length(v[i]) >= {least}"""


def oracle_sql() -> str:
    """``report``'s rows in DuckDB SQL. Its engine folds case beyond ASCII, so the keywords are spelled out."""
    folded = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = BASE[0][1].replace("(?i:password|passwd|secret|token|api_?key)", folded)
    rules = [(BASE[0][0], assign, *BASE[0][2:]), *BASE[1:], *(m[:4] for m in MORE)]
    spans = " UNION ALL ".join(_oracle_rule(n, *rule) for n, rule in enumerate(rules))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({spans}),
    g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, no) AS spans FROM f GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
