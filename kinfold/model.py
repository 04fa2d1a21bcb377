"""Schemas and constants of contact resolution."""

from __future__ import annotations

from pyspark.sql import types as T

#: Prefix of the extension properties that written cards carry.
EXTENSION = "X-KINFOLD"

AUTO_MERGE, REVIEW, DISTINCT = "auto_merge", "review", "distinct"
AUTO_SCORE, REVIEW_SCORE, NEAR_NAME = 0.85, 0.60, 0.95
BLOCK_LIMIT = 50

# Weights of the score, in the order in which they are added.
NAME_WEIGHT, EMAIL_WEIGHT, PHONE_WEIGHT, ORG_WEIGHT, BIRTHDAY_WEIGHT = 0.40, 0.25, 0.25, 0.10, 0.10
NAMELESS_EMAIL, NAMELESS_PHONE, NAMELESS_ORG, NAMELESS_BIRTHDAY = 0.45, 0.45, 0.10, 0.10

SINGLE = ["formatted_name", "family_name", "given_name", "middle_name", "org", "title", "note", "url"]


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


CONTACT = T.StructType([
    T.StructField("idx", T.IntegerType()),
    *_strings("source family_name given_name middle_name prefix suffix formatted_name"),
    T.StructField("emails", T.ArrayType(T.StructType(_strings("address type")))),
    T.StructField("phones", T.ArrayType(T.StructType(_strings("number type")))),
    *_strings("org title birthday"),
    T.StructField("addresses", T.ArrayType(T.StructType(_strings("type street city region postcode country pobox extended")))),
    *_strings("note url"),
    T.StructField("photo", T.BinaryType()),
    *_strings("photo_uri photo_type"),
    T.StructField("extra", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
