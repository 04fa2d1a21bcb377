"""One contact from a cluster's members: the base card's values first, then the others' in index order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.model import CONTACT, SINGLE

_FIELDS = [f.name for f in CONTACT.fields]


def _fold(values: Column, start: Column, step) -> Column:
    return F.aggregate(values, start, step)


def _union(base: Column, others: Column, key, drop_empty: bool) -> Column:
    """Entries by key: of the base's equal keys the last one, of the others the first; sorted by the raw value."""

    def keyed(entries: Column) -> Column:
        pairs = F.transform(entries, lambda e: F.struct(key(e).alias("k"), e.alias("e")))
        return F.filter(pairs, lambda p: p["k"] != "") if drop_empty else pairs

    def keep_new(done: Column, p: Column) -> Column:
        return F.when(F.exists(done, lambda q: q["k"] == p["k"]), done).otherwise(F.concat(done, F.array(p)))

    own = F.reverse(keyed(base))
    first = F.aggregate(own, F.slice(own, F.lit(1), F.lit(0)), keep_new)
    every = F.aggregate(keyed(F.flatten(others)), first, keep_new)
    return F.array_sort(F.transform(every, lambda p: p["e"]))


def _addresses(base: Column, others: Column) -> Column:
    def keep_new(done: Column, a: Column) -> Column:
        return F.when(F.exists(done, lambda d: X.address_key(d) == X.address_key(a)), done).otherwise(F.concat(done, F.array(a)))

    return F.aggregate(F.flatten(others), base, keep_new)


def _extra(base: Column, others: Column) -> Column:
    """Per key, values that the key did not hold before this contact; of UID the first contact's first value."""
    empty = F.create_map().cast("map<string,array<string>>")

    def merge(done: Column, one: Column) -> Column:
        def values(k: Column, old: Column, new: Column) -> Column:
            none = F.array().cast("array<string>")
            o, n = F.coalesce(old, none), F.coalesce(new, none)
            uid = F.when(F.size(o) > 0, o).otherwise(F.slice(n, F.lit(1), F.lit(1)))
            return F.when(F.upper(k) == "UID", uid).otherwise(F.concat(o, F.filter(n, lambda v: ~F.array_contains(o, v))))

        return F.map_zip_with(done, F.coalesce(one, empty), values)

    return F.aggregate(others, F.coalesce(base, empty), merge)


def merge_clusters(placed: DataFrame, contacts: DataFrame, priority: Column | None = None) -> DataFrame:
    """One merged row a cluster: the contact's columns, ``cluster``, ``sources`` and ``merged_from``.

    ``priority`` tells which contacts may be the base (default: source icloud); the first of them by index is, else the
    first contact. Where contacts have ``sources`` of their own (read back from written cards), these are united. A
    cluster that is merged unseen is bounded by its scored pairs, all of which exist, and one that a person merges by what
    a person has looked through, so the members fit the one row that they become.
    """
    united = "sources" in contacts.columns
    first = (F.col("source") == "icloud") if priority is None else priority
    rows = placed.join(contacts, "idx").withColumn("__last", (~first).cast("int"))
    listed = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in _FIELDS if c not in ("idx", "extra")], F.to_json("extra").alias("extra_json"), *(["sources"] if united else []), "__last"))).alias("m"))
    # Maps have no order, so they travel as JSON through the sort.
    extra = F.transform("m", lambda x: F.from_json(x["extra_json"], "map<string,array<string>>"))
    base_at = F.array_min(F.transform("m", lambda x, i: F.struct(x["__last"].alias("last"), i.alias("i"))))["i"]
    at = listed.withColumn("extras", extra).withColumn("i", base_at).withColumn("base", F.element_at("m", F.col("i") + 1)).withColumn("base_extra", F.element_at("extras", F.col("i") + 1))
    others = at.withColumn("o", F.filter("m", lambda x, i: i != F.col("i"))).withColumn("oe", F.filter("extras", lambda x, i: i != F.col("i")))
    b = F.col("base")

    def single(name: str) -> Column:
        values = F.filter(F.transform("o", lambda x: x[name]), lambda v: v != "")
        return F.coalesce(F.nullif(b[name], F.lit("")), F.try_element_at(values, F.lit(1)), F.lit("")).alias(name)

    bytes_at = F.filter("o", lambda x: F.octet_length(x["photo"]) > 0)
    uri_at = F.filter("o", lambda x: x["photo_uri"] != "")
    has_bytes, has_uri = F.coalesce(F.octet_length(b["photo"]) > 0, F.lit(False)), F.coalesce(b["photo_uri"] != "", F.lit(False))
    photo_from = F.when(has_bytes, b).when(F.size(bytes_at) > 0, F.try_element_at(bytes_at, F.lit(1))).when(has_uri, b).when(F.size(uri_at) > 0, F.try_element_at(uri_at, F.lit(1))).otherwise(b)
    filled = others.withColumn("p", photo_from)
    return filled.select(
        "cluster", b["idx"].alias("idx"), b["source"].alias("source"), *(single(n) for n in SINGLE), b["prefix"].alias("prefix"), b["suffix"].alias("suffix"),
        _union(b["emails"], F.transform("o", lambda x: x["emails"]), lambda e: X.email(e["address"]), False).alias("emails"),
        _union(b["phones"], F.transform("o", lambda x: x["phones"]), lambda p: X.phone(p["number"]), True).alias("phones"),
        _fold(F.transform("o", lambda x: x["birthday"]), b["birthday"], X.prefer_birthday).alias("birthday"),
        _addresses(b["addresses"], F.transform("o", lambda x: x["addresses"])).alias("addresses"),
        F.col("p.photo").alias("photo"), F.when(F.octet_length("p.photo") > 0, F.when(has_bytes, b["photo_uri"]).otherwise("")).otherwise(F.col("p.photo_uri")).alias("photo_uri"), F.col("p.photo_type").alias("photo_type"),
        _extra(F.col("base_extra"), F.col("oe")).alias("extra"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["sources"])) if united else F.transform("m", lambda x: x["source"])).alias("sources"), F.transform("m", lambda x: x["idx"]).alias("merged_from"),
    )
