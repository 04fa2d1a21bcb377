"""Contacts with all that a card can hold, derived from ``customer``; the same texts run in Spark and in DuckDB.

``FLAT`` has the values, ``CARD`` the card that a writer has to make of them, built without the writer's code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import model as M
from kinfold.model import CONTACT

_K = "CAST({0} AS VARCHAR(20))"


def _text(number: str) -> str:
    return _K.format(number)


#: Every value is empty for some; names, titles and notes hold what wire form has to escape.
FLAT = f"""
SELECT k AS idx, CASE WHEN k % 2 = 0 THEN 'icloud' ELSE 'google' END AS source,
  CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN 'O;Neil, Jr' ELSE concat('Fam', {_text("k % 50")}) END AS family_name,
  CASE WHEN k % 8 = 0 THEN '' WHEN k % 8 = 1 THEN concat('A', chr(92), 'n') ELSE concat('Given', {_text("k % 30")}) END AS given_name,
  CASE WHEN k % 5 = 0 THEN 'Q.' ELSE '' END AS middle_name, CASE WHEN k % 6 = 0 THEN 'Dr.' ELSE '' END AS prefix, CASE WHEN k % 10 = 0 THEN 'III' ELSE '' END AS suffix,
  CASE WHEN k % 4 = 0 THEN '' ELSE concat('Shown ', {_text("k")}, ', Esq') END AS formatted_name,
  CASE WHEN k % 3 = 0 THEN '' WHEN k % 7 = 0 THEN 'unknown' ELSE concat('User', {_text("k")}, '@Example.com') END AS email_1, CASE WHEN k % 6 = 1 THEN concat('second', {_text("k")}, '@x.org') ELSE '' END AS email_2,
  CASE WHEN k % 5 = 1 THEN '' WHEN k % 7 = 1 THEN '000-0000' ELSE concat('(212) ', {_text("5550000 + k")}) END AS phone_1, CASE WHEN k % 8 = 3 THEN concat('+44 ', {_text("200000000 + k")}) ELSE '' END AS phone_2,
  CASE WHEN k % 4 = 1 THEN concat('Acme', chr(92), ', Inc;Unit ', {_text("k % 7")}) ELSE '' END AS org, CASE WHEN k % 4 = 2 THEN concat('Chief; of, staff ', chr(92), ' ', {_text("k")}) ELSE '' END AS title,
  CASE WHEN k % 3 = 1 THEN concat('one', chr(10), 'two', chr(92), 'n; three, ', {_text("k")}) ELSE '' END AS note, CASE WHEN k % 6 = 2 THEN concat('https://h.org/a,b;c?', {_text("k")}) ELSE '' END AS url,
  CASE WHEN k % 5 = 2 THEN concat({_text("k")}, ' Main St; Apt 1') ELSE '' END AS street, CASE WHEN k % 5 IN (2, 3) THEN 'Rome' ELSE '' END AS city,
  CASE WHEN k % 7 = 2 THEN concat('https://h.org/p', {_text("k")}) ELSE '' END AS photo_uri, CASE WHEN k % 6 = 5 THEN concat('value;', {_text("k")}) ELSE '' END AS tag,
  CASE WHEN k % 4 = 3 THEN concat({_text("1950 + k % 50")}, '-', lpad({_text("1 + k % 12")}, 2, '0'), '-', lpad({_text("1 + k % 28")}, 2, '0')) ELSE '' END AS birthday
FROM (SELECT c_custkey AS k FROM customer) t
"""


def _escaped(value: str) -> str:
    for c in ("chr(92)", "';'", "','"):
        value = f"replace({value}, {c}, concat(chr(92), {c}))"
    return f"replace({value}, chr(10), concat(chr(92), 'n'))"


def _line(value: str, head: str, text: str | None = None) -> str:
    return f"CASE WHEN {value} <> '' THEN concat('{head}:', {text or _escaped(value)}, chr(13), chr(10)) ELSE '' END"


_SHOWN = "CASE WHEN formatted_name <> '' THEN formatted_name WHEN given_name <> '' OR family_name <> '' THEN trim(concat(given_name, ' ', family_name)) ELSE 'Unknown' END"
_NAMES = ", ';', ".join(_escaped(n) for n in ("family_name", "given_name", "middle_name", "prefix", "suffix"))
_END = "chr(13), chr(10)"
#: ``idx, value``: a card's lines by the properties' names.
CARD = f"""
SELECT idx, concat('BEGIN:VCARD', {_END}, 'VERSION:3.0', {_END},
  CASE WHEN street <> '' OR city <> '' THEN concat('ADR;TYPE=HOME:;;', {_escaped("street")}, ';', city, ';;;', {_END}) ELSE '' END, {_line("birthday", "BDAY")},
  {_line("email_1", "EMAIL;TYPE=WORK")}, {_line("email_2", "EMAIL")}, concat('FN:', {_escaped(_SHOWN)}, {_END}), concat('N:', {_NAMES}, {_END}),
  {_line("note", "NOTE")}, {_line("org", "ORG", "org")}, {_line("photo_uri", "PHOTO;VALUE=uri", "photo_uri")}, {_line("phone_1", "TEL;TYPE=CELL")}, {_line("phone_2", "TEL")}, {_line("title", "TITLE")}, {_line("url", "URL")},
  concat('{M.EXTENSION}-SOURCE:', source, {_END}), {_line("tag", "X-TAG", "tag")}, 'END:VCARD', {_END}) AS value
FROM rich
"""

_MONTH = "split_part('January,Feb,mar.,April,May,June,JULY,Aug,Sept,October,Nov.,december', ',', CAST(m AS INT))"
#: ``idx, raw, canonical``: birthdays in every readable form, and what each stands for by its making.
BIRTHDAYS = f"""
SELECT k AS idx, canonical, CASE form WHEN 0 THEN concat({_text("y")}, '-', mm, '-', dd) WHEN 1 THEN concat({_text("y")}, mm, dd) WHEN 2 THEN concat('--', mm, '-', dd) WHEN 3 THEN concat({_text("y")}, '/', {_text("m")}, '/', {_text("d")})
  WHEN 4 THEN concat({_text("m")}, '/', {_text("d")}, '/', {_text("y")}) WHEN 5 THEN concat({_text("d")}, '.', {_text("m")}, '.', {_text("y")}) WHEN 6 THEN concat({_text("d")}, CASE WHEN k % 2 = 0 THEN 'th ' ELSE ' ' END, {_MONTH}, ', ', {_text("y")})
  WHEN 7 THEN concat(' ', {_MONTH}, ' ', {_text("d")}, CASE WHEN k % 3 = 0 THEN '' ELSE concat(', ', {_text("y")}) END) WHEN 8 THEN concat({_text("y")}, '-', mm, '-', dd, 'T00:00:00Z') WHEN 9 THEN concat({_text("m")}, '/', {_text("d")}) ELSE concat('day ', {_text("k")}) END AS raw
FROM (SELECT *, CASE WHEN form IN (2, 9) OR (form = 7 AND k % 3 = 0) OR (y = 1604 AND form <> 10) THEN concat('--', mm, '-', dd) WHEN form = 10 THEN concat('day ', {_text("k")}) ELSE concat({_text("y")}, '-', mm, '-', dd) END AS canonical
  FROM (SELECT *, lpad({_text("m")}, 2, '0') AS mm, lpad({_text("d")}, 2, '0') AS dd FROM (SELECT c_custkey AS k, c_custkey % 11 AS form, CASE WHEN c_custkey % 13 = 0 THEN 1604 ELSE 1930 + c_custkey % 80 END AS y, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS d FROM customer) a) b) c
"""


def flat(spark: SparkSession, sf_dir: str, sql: str = FLAT) -> DataFrame:
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, value``: ``CARD`` in Spark."""
    return spark.sql(CARD.replace("FROM rich", "FROM {rich}"), rich=flat(spark, sf_dir))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FLAT`` as contacts."""
    rows, empty = flat(spark, sf_dir), F.lit("")

    def listed(part: str, kind: str, first: str, second: str):
        pair = F.array(F.struct(F.col(first).alias(part), F.lit(kind).alias("type")), F.struct(F.col(second).alias(part), empty.alias("type")))
        return F.filter(pair, lambda e: e[part] != "")

    address = F.struct(F.lit("HOME").alias("type"), "street", "city", *(empty.alias(n) for n in ("region", "postcode", "country", "pobox", "extended")))
    columns = {
        "idx": F.col("idx").cast("int"), "emails": listed("address", "WORK", "email_1", "email_2"), "phones": listed("number", "CELL", "phone_1", "phone_2"),
        "addresses": F.filter(F.array(address), lambda a: (a["street"] != "") | (a["city"] != "")), "photo": F.lit(None).cast("binary"),
        "extra": F.when(F.col("tag") != "", F.create_map(F.lit("X-TAG"), F.array("tag"))).otherwise(F.create_map().cast("map<string,array<string>>")),
    }
    return rows.select(*(columns.get(f.name, F.col(f.name) if f.name in rows.columns else empty).cast(f.dataType).alias(f.name) for f in CONTACT.fields))
