"""Contacts with their normal forms, computed once a contact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X


def normalize(contacts: DataFrame) -> DataFrame:
    """One row a contact: folded and strict name parts, suffix, distinct e-mails and phones (all, and the plausible
    ones), organisation key, birthday parts and the full name that similarity compares."""
    c = contacts.select(
        "idx", "source", *(X.name(F.col(f"{p}_name")).alias(p) for p in ("family", "given", "middle")), *(X.name_strict(F.col(f"{p}_name")).alias(f"strict_{p}") for p in ("family", "given", "middle")),
        X.generational_suffix(F.col("suffix"), F.col("family_name"), F.col("given_name")).alias("generation"),
        X.distinct_values(F.col("emails"), lambda e: X.email(e["address"])).alias("email_keys"),
        X.distinct_values(F.col("phones"), lambda p: X.phone(p["number"])).alias("phone_keys"),
        X.org_key(F.col("org")).alias("org_key"), F.col("birthday"), X.birthday_parts(F.col("birthday")).alias("bday"),
    )
    return c.withColumns({
        "good_emails": F.filter("email_keys", X.plausible_email),
        "good_phones": F.filter("phone_keys", X.plausible_phone),
        "full": F.when(F.col("family") == "", F.col("given")).otherwise(F.concat_ws(" ", "given", "family")),
        "initial": F.substring("given", 1, 1),
    })
