"""Scores, features and tiers of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import pairwise
from kinfold.operators.blocking import EARLIER, chunk_pairs

FLAGS = ["name_exact", "shared_email", "shared_phone", "shared_org", "shared_birthday", "birthday_conflict", "birthday_unknown", "nameless"]


def _initials_only(given: Column) -> Column:
    parts = F.filter(F.split(given, r"[. \t]+"), lambda w: w != "")
    return F.forall(parts, lambda w: F.length(w) <= 1)


def _split_given(given: Column, middle: Column) -> tuple[Column, Column]:
    """A given name of several words yields the middle name, if that is empty."""
    words = F.split(given, " ")
    moved = (middle == "") & (F.size(words) >= 2)
    return F.when(moved, words[0]).otherwise(given), F.when(moved, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(middle)


def cards(rows: DataFrame) -> DataFrame:
    """Rows of normal forms with what scoring compares: ``exact`` is the same for two cards of one name, apart from their
    middle names, and null for a card that no name is known of."""
    given, middle = _split_given(F.col("given"), F.col("middle"))
    strict_given, strict_middle = _split_given(F.col("strict_given"), F.col("strict_middle"))
    known = (F.col("family") != "") & ~_initials_only(F.col("given"))
    exact = F.when(known, F.to_json(F.array("family", "generation", given, "strict_family", strict_given)))
    return rows.withColumns({"exact": exact, "nameless": F.col("given") == "", "middle": middle, "strict_middle": strict_middle})


CARD = ["idx", "full", "exact", "nameless", "middle", "strict_middle", "good_emails", "good_phones", "org_key", "birthday", "bday", *EARLIER]


def _over(rows: DataFrame, sink: Callable, schema: str, *more: str, by: tuple[str, ...] = ("full", "idx"), keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """What ``sink`` makes of the scored pairs of ``rows`` (``cards`` of keys): each pair once, at the first key of both."""
    return chunk_pairs(rows.select(*keys, *CARD, *more), [*CARD, *more], by, keys).mapInArrow(sink, schema.format(idx=rows.schema["idx"].dataType.simpleString()))


_SCORED = "score double, name_similarity double, bits short"


def features(scored: DataFrame) -> DataFrame:
    """``bits`` as the tier and the flags."""
    bits = F.col("bits")
    tier = F.element_at(F.array(*map(F.lit, pairwise.TIERS)), F.shiftright(bits, pairwise.TIER_AT).cast("int") + 1)
    return scored.select(*(c for c in scored.columns if c not in ("bits", "name_similarity")), tier.alias("tier"), "name_similarity", *((bits.bitwiseAND(1 << n) != 0).alias(f) for n, f in enumerate(FLAGS)))


def scored_pairs(rows: DataFrame) -> DataFrame:
    """``a, b, score, tier, name_similarity`` and the flags of every candidate pair.

    Sums are doubles in the order of the weights: another order or decimals can move a pair over a threshold.
    """
    return features(_over(rows, pairwise.scored_pairs, "a {idx}, b {idx}, " + _SCORED))


def tier_counts(rows: DataFrame) -> DataFrame:
    return _over(rows, pairwise.tier_counts, "tier string, pairs long").groupBy("tier").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def linking(rows: DataFrame) -> DataFrame:
    """Narrower keys for pairs that are more than a near name: without a plausible e-mail or phone or a birthday in common, the
    score of a name and an organisation stays below every limit."""
    good_emails, good_phones = F.array_intersect("good_emails", "email_keys"), F.array_intersect("good_phones", "phone_keys")
    kind, value = F.substring("key", 1, 1), F.expr("substring(key, 2)")
    rows = rows.withColumns({"__emails": good_emails, "__phones": good_phones})
    good = ((kind == "0") & F.array_contains("__emails", value)) | ((kind == "1") & F.array_contains("__phones", value))
    none = F.array().cast("array<string>")
    own = rows.where(good).withColumns({
        "earlier_emails": F.when(kind == "0", F.array_intersect("earlier_emails", "__emails")).otherwise(F.col("__emails")), "earlier_phones": F.when(kind == "0", none).otherwise(F.array_intersect("earlier_phones", "__phones")), "earlier_names": none,
    })
    born = rows.where(~good & X.plausible_birthday(F.col("bday"))).withColumns({
        "key": F.concat(F.lit("b"), "bday.md", "key"), "earlier_emails": F.array_union("earlier_emails", "__emails"), "earlier_phones": F.array_union("earlier_phones", "__phones"),
    })
    return own.unionByName(born).drop("__emails", "__phones")


def evidence_edges(rows: DataFrame) -> DataFrame:
    """``a, b``: edges that join what the pairs that are more than a near name join."""
    return _over(linking(rows), pairwise.joined, "a {idx}, b {idx}")


def auto_pairs(rows: DataFrame) -> DataFrame:
    """``a, b`` of the automatic tier."""
    return _over(linking(rows), pairwise.auto_pairs, "a {idx}, b {idx}")


def near_pairs(rows: DataFrame) -> DataFrame:
    """``a, b, score, same``: pairs that rest on a near name alone; ``same``: of one source."""
    return _over(rows, pairwise.near_pairs, "a {idx}, b {idx}, score double, same boolean", "source")


def near_groups(rows: DataFrame) -> DataFrame:
    """``ga, gb, score``: of each two groups (``g``) the best pair that rests on a near name alone."""
    kind = rows.schema["g"].dataType.simpleString()
    found = _over(rows, pairwise.near_groups, f"ga {kind}, gb {kind}, score double", "g", by=("full", "g", "idx"))
    return found.groupBy("ga", "gb").agg(F.max("score").alias("score"))


def inside(rows: DataFrame) -> DataFrame:
    """Of the pairs within a ``cluster``: ``cluster, pairs, min_score, auto`` (all automatic), and the best pair's ``score, a, b``
    and features (the first of equal scores)."""
    kind = rows.schema["cluster"].dataType.simpleString()
    parts = _over(rows, pairwise.inside, f"cluster {kind}, pairs long, min_score double, score double, auto boolean, a {{idx}}, b {{idx}}, name_similarity double, bits short", keys=("key", "cluster"))
    best = F.max_by(F.struct("score", "a", "b", "name_similarity", "bits"), F.struct(F.col("score"), -F.col("a"), -F.col("b")))
    whole = parts.groupBy("cluster").agg(F.sum("pairs").alias("pairs"), F.min("min_score").alias("min_score"), F.bool_and("auto").alias("auto"), best.alias("best"))
    return features(whole.select("cluster", "pairs", "min_score", "auto", "best.*"))


def said(rows: DataFrame) -> DataFrame:
    """``cluster, a, b, said``: every pair within a ``cluster`` in words, by the cards' ``name``."""
    return _over(rows, pairwise.said, f"cluster {rows.schema['cluster'].dataType.simpleString()}, a {{idx}}, b {{idx}}, said string", "name", keys=("key", "cluster"))
