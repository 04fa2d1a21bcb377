"""Split contacts into reachable and unreachable ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X

CHANNELS = ("email", "phone", "address", "url")
#: URLs alone do not make a person reachable unless asked for.
USUAL = ("email", "phone", "address")
_DELIVERABLE = ("street", "pobox", "extended", "postcode")
_ANY = ("street", "city", "region", "postcode", "country", "pobox", "extended")


def parse_channels(text: str) -> list[str]:
    """A comma list of channels, in any case, each once; anything else is an error."""
    names = [c.strip().lower() for c in text.split(",") if c.strip()]
    if not names or (unknown := [n for n in names if n not in CHANNELS]):
        raise ValueError(f"unknown channel {unknown[0]!r}" if names else "no channel given")
    return list(dict.fromkeys(names))


def _filled(a: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | (X.strip(a[p]) != "")
    return out


def presence() -> dict[str, Column]:
    """What a card holds, usable or not."""
    return {
        "has_email": F.size("emails") > 0, "has_phone": F.size("phones") > 0, "has_address": F.exists("addresses", lambda a: _filled(a, _ANY)),
        "has_org": F.col("org") != "", "has_title": F.col("title") != "", "has_url": X.strip(F.col("url")) != "", "has_birthday": F.col("birthday") != "",
        "has_note": X.strip(F.col("note")) != "", "has_photo": (F.coalesce(F.octet_length("photo"), F.lit(0)) > 0) | (F.coalesce("photo_uri", F.lit("")) != ""),
    }


def reach() -> dict[str, Column]:
    """Per channel, whether the card can be reached by it."""
    return {
        "email": F.exists("emails", lambda e: X.plausible_email(X.email(e["address"]))), "phone": F.exists("phones", lambda p: X.plausible_phone(X.phone(p["number"]))),
        "address": F.exists("addresses", lambda a: _filled(a, _DELIVERABLE)), "url": X.strip(F.col("url")) != "",
    }


def split(contacts: DataFrame, channels: tuple[str, ...] = USUAL) -> DataFrame:
    """The contacts with presence flags and ``reachable``: by any enabled channel."""
    by, out = reach(), F.lit(False)
    for c in channels:
        out = out | by[c]
    return contacts.withColumns(presence() | {"reachable": out})


def kept(found: DataFrame) -> DataFrame:
    return found.where("reachable")


def removed(found: DataFrame) -> DataFrame:
    name = F.coalesce(X.first_filled(F.col("formatted_name"), F.trim(F.concat_ws(" ", "given_name", "family_name")), F.col("org")), F.lit("(unknown)"))
    return found.where(~F.col("reachable")).withColumn("name", name)


def detail_counts(found: DataFrame) -> DataFrame:
    """What removed contacts hold: an e-mail or phone that did not count, organisation or title, URL, birthday, or a
    name only."""
    gone, holds = found.where(~F.col("reachable")), list(presence())
    any_ = F.array_contains(F.array(*holds), True)
    flags = {"uncounted": F.col("has_email") | F.col("has_phone"), "org_or_title": F.col("has_org") | F.col("has_title"), "url": F.col("has_url"), "birthday": F.col("has_birthday"), "name_only": ~any_}
    return gone.agg(F.count("*").alias("removed"), *(F.count_if(c).alias(n) for n, c in flags.items()))
