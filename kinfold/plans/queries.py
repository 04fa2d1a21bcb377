"""The registered contact queries, by name: each takes (spark, sf_dir) and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import blocking, calibration, clustering, prune, reporting, review, scoring, survivorship
from kinfold.operators.normalize import normalize
from kinfold.plans import commands, rich
from kinfold.plans.storage import materialize
from kinfold.sources import vcard
from kinfold.plans.resolution import Resolution, derived_contacts, derived_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _resolution(spark: SparkSession, sf_dir: str) -> Resolution:
    return Resolution(derived_contacts(spark, sf_dir))


def _values(entries: str, part: str) -> Column:
    return F.array_join(F.transform(entries, lambda e: e[part]), ";")


def rounded(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


@query
def norm_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalize(derived_contacts(spark, sf_dir))
    return n.select("idx", "family", "given", "strict_family", "strict_given", "generation", F.array_join("email_keys", ";").alias("email_keys"), F.array_join("phone_keys", ";").alias("phone_keys"), "org_key", "full", "initial")


@query
def birthday_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_rows(spark, sf_dir).select("idx", F.col("birthday").alias("raw"), X.birthday(F.col("birthday")).alias("birthday"))
    parts = X.birthday_parts(F.col("birthday"))
    return rows.select("idx", "raw", "birthday", parts["ok"].alias("readable"), X.plausible_birthday(parts).alias("plausible"))


@query
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = derived_rows(spark, sf_dir).select("idx", X.email(F.col("email")).alias("email"), X.phone(F.col("phone")).alias("phone"))
    return keys.select("*", X.plausible_email(F.col("email")).alias("good_email"), X.plausible_phone(F.col("phone")).alias("good_phone"))


def _blocked(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_resolution(spark, sf_dir).norm)


for _f in (blocking.block_email, blocking.block_phone, blocking.block_family_small, blocking.block_family_large, blocking.candidate_pairs):
    QUERIES[_f.__name__] = _blocked(_f)


@query
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return r.scored.select("a", "b", rounded("score"), "tier", rounded("name_similarity"), *scoring.FLAGS)


@query
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tier_counts(_resolution(spark, sf_dir).rows)


@query
def evidence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.evidence_components(_resolution(spark, sf_dir).rows)


@query
def near_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return clustering.match_near_names(r.rows, clustering.evidence_components(r.rows))


@query
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).summary.select("cluster", "size", "pairs", rounded("min_score"), rounded("max_score"), "auto")


@query
def auto_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).auto_members


@query
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).review_queue.select("cluster", "cluster_id", "size", rounded("score"), rounded("min_score"), "view_mode", "decision")


@query
def deferred_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).deferred.select(rounded("score"), *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("side_a", "side_b")))


@query
def distinct_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).distinct.select("idx", X.display_name().alias("name"))


@query
def merged_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _resolution(spark, sf_dir).output
    return out.select(
        "cluster", "idx", rounded("score"), "formatted_name", "family_name", "given_name", "org", "birthday", _values("emails", "address").alias("emails"), _values("phones", "number").alias("phones"),
        F.array_join("sources", "+").alias("sources"), F.array_join(F.col("merged_from").cast("array<string>"), ",").alias("merged_from"),
    )


@query
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).conflicts


@query
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return reporting.ambiguity_rows(r.rows, r.review_members, r.contacts)


@query
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).totals


def decisions_of(clusters: DataFrame) -> DataFrame:
    """A stand-in for people: every third cluster is merged, every third skipped, the rest left open."""
    rest = F.pmod(F.col("cluster"), F.lit(3))
    return clusters.select("cluster", F.when(rest == 0, "merge").when(rest == 1, "skip").otherwise("pending").alias("decision")).distinct()


@query
def resolve_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return r.resolve(decisions_of(r.review_members)).select("cluster", "kind", "idx", "formatted_name", _values("emails", "address").alias("emails"), _values("phones", "number").alias("phones"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("cluster_id"), F.when(F.col("event_type") == "purchase", "merge").when(F.col("event_type") == "error", "undo").otherwise("skip").alias("decision"),
        ((F.col("event_id") % 101) / 100.0).cast("double").alias("score"), F.when(F.col("event_id") % 2 == 0, "compact").otherwise("detailed").alias("view_mode"), F.floor(F.col("value") * 100).cast("long").alias("decision_time_ms"),
    )


@query
def last_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.last_decisions(decision_log(spark, sf_dir))


@query
def calibration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.counts(calibration.last_decisions(decision_log(spark, sf_dir)))


@query
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.bands(calibration.last_decisions(decision_log(spark, sf_dir)))


@query
def calibration_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.suggestion(calibration.last_decisions(decision_log(spark, sf_dir)))


@query
def prune_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.split(rich.contacts(spark, sf_dir)).select("idx", *prune.presence(), "reachable")


@query
def prune_detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.detail_counts(prune.split(rich.contacts(spark, sf_dir)))


@query
def birthday_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.flat(spark, sf_dir, rich.BIRTHDAYS).select("idx", "raw", X.birthday(F.col("raw")).alias("canonical"))


@query
def vcard_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcard.card_lines(rich.contacts(spark, sf_dir)).select(F.col("idx").cast("long").alias("idx"), "value")


def _flat(contacts: DataFrame) -> DataFrame:
    """A contact's lists as text, for comparisons."""
    single = ["source", "family_name", "given_name", "middle_name", "prefix", "suffix", "formatted_name", "org", "title", "birthday", "note", "url", "photo_uri"]
    pairs = {"emails": "address", "phones": "number"}

    def listed(name: str, part: str) -> Column:
        return F.array_join(F.transform(name, lambda e: F.concat(e["type"], F.lit("="), e[part])), " ").alias(name)

    return contacts.select(F.col("idx").cast("long").alias("idx"), *single, *(listed(c, v) for c, v in pairs.items()), F.array_join(F.transform("addresses", lambda a: F.concat_ws("|", a["street"], a["city"])), " ").alias("addresses"), F.coalesce(F.array_join(F.try_element_at("extra", F.lit("X-TAG")), " "), F.lit("")).alias("tag"))


@query
def vcard_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(vcard.parse_cards(rich.cards(spark, sf_dir)))


@query
def vcard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(vcard.parse_cards(vcard.card_lines(rich.contacts(spark, sf_dir))))


@query
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivorship over every kind of field: each two neighbours are taken for one person."""
    contacts = rich.contacts(spark, sf_dir)
    placed = contacts.select("idx", F.floor(F.col("idx") / 2).cast("long").alias("cluster"))
    merged = survivorship.merge_clusters(placed, contacts)
    return _flat(merged).join(merged.select(F.col("idx").cast("long").alias("idx"), F.array_join("sources", "+").alias("sources")), "idx")


@query
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = normalize(rich.contacts(spark, sf_dir))
    return names.select(F.col("idx").cast("long").alias("idx"), "generation", F.size("email_keys").cast("long").alias("emails"), F.size("phone_keys").cast("long").alias("phones"), F.size("good_emails").cast("long").alias("good_emails"), F.size("good_phones").cast("long").alias("good_phones"))


@query
def review_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return review.breakdown(reporting.best_pairs(r.summary.where("not auto"))).select("cluster", "lines", "short")


@query
def review_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    e = review.evidence(reporting.best_pairs(r.summary.where("not auto")), r.contacts, r.norm)
    return e.select("cluster", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("idx", "name", "email", "phone", "org", "birthday")))


@query
def deferred_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return review.deferred_entries(r.deferred, r.contacts).select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("side_a", "side_b")), "reason")


def session_log(queue: DataFrame) -> DataFrame:
    """A stand-in for a session: of four clusters one is merged, one skipped, one merged and taken back, one not seen."""
    said = F.element_at(F.array(F.array(F.lit("merge")), F.array(F.lit("skip")), F.array(F.lit("merge"), F.lit("undo")), F.array().cast("array<string>")), F.pmod(F.col("cluster"), F.lit(4)).cast("int") + 1)
    entries = queue.select("cluster", "cluster_id", "score", "view_mode", F.posexplode(said).alias("at", "decision"))
    return entries.select((F.col("cluster") * 10 + F.col("at")).cast("long").alias("seq"), "cluster_id", "decision", "score", "view_mode", F.lit(1000).cast("long").alias("decision_time_ms"))


def _session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queue = materialize(_resolution(spark, sf_dir).review_queue, "queue")
    return queue, session_log(queue)


@query
def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_state(*_session(spark, sf_dir)).select("cluster", "cluster_id", "decision")


@query
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pending_counts(review.decision_state(*_session(spark, sf_dir)))


@query
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.next_pending(review.decision_state(*_session(spark, sf_dir))).select("cluster", "cluster_id")


@query
def undo_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.undo_entry(_session(spark, sf_dir)[1]).select("cluster_id", "decision", rounded("score"))


@query
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolution(spark, sf_dir)
    return review.shared_values(scoring.auto_pairs(r.rows), r.norm).select("a", "b", F.array_join("emails", " ").alias("emails"), F.array_join("phones", " ").alias("phones"))


@query
def resolve_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged and review cards in wire form and back, aligned with the report, and its decisions applied."""
    r = _resolution(spark, sf_dir)
    merged = vcard.parse_cards(vcard.card_lines(r.output), "merged")
    waiting = materialize(r.review_in_order, "review")
    cards = materialize(vcard.parse_cards(vcard.card_lines(waiting, review=True), "review"), "cards")
    sources = waiting.groupBy("cluster", "cluster_id").agg(F.min("idx").alias("position"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "source"))), lambda x: x["source"]).alias("sources"))
    report = materialize(sources.join(decisions_of(waiting.select("cluster")), "cluster").select(F.col("position").cast("int").alias("position"), "cluster_id", "decision", "sources"), "report")
    return commands.resolved(merged, cards, report).select("formatted_name", "family_name", "given_name", "org", "birthday", _values("emails", "address").alias("emails"), _values("phones", "number").alias("phones"), F.array_join("sources", "+").alias("sources"))
