"""Text, identifier and birthday functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are no part of a name; month names by their first letters.
TITLES = ["dr", "mr", "mrs", "ms", "prof", "rev", "sir", "dame"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "esq", "md", "phd", "dds"]
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "v": "v"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# The readable forms of a birthday.
_FULL = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_NO_YEAR = r"^--(\d{2})-?(\d{2})$"
_YMD = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$"
_SLASH = r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}))?$"
_DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
_DAY_MONTH = r"^(\d{1,2})(?:st|nd|rd|th)?\.? +([A-Za-z]+)\.?(?:,? +(\d{4}))?$"
_MONTH_DAY = r"^([A-Za-z]+)\.? +(\d{1,2})(?:st|nd|rd|th)?(?:,? +(\d{4}))?$"
_CANONICAL = r"^(\d{4}|-)-(\d{2})-(\d{2})$"


def squeeze(s: Column) -> Column:
    """Trimmed, with every run of (Unicode) white space as one blank."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _lower(s: str) -> str:
    return s.lower().replace("ς", "σ")


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _lower("".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")))


@F.pandas_udf(StringType())
def _strict(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _lower(unicodedata.normalize("NFKC", x)))


def _name(s: Column, unicode_form) -> Column:
    """Only names beyond ASCII reach Python."""
    lowered = F.coalesce(unicode_form(F.when(s.rlike(r"[^\x00-\x7F]"), s)), F.lower(s))
    words = F.filter(F.split(squeeze(lowered), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~is_title(w))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def is_title(word: Column) -> Column:
    bare = F.lower(F.rtrim(word, F.lit(".,")))
    return (F.length(bare) > 1) & bare.isin(TITLES + SUFFIXES)


def name(s: Column) -> Column:
    """Folded name: compatibility decomposition without marks, lower case, no titles or suffixes."""
    return _name(s, _folded)


def name_strict(s: Column) -> Column:
    """As ``name``, with accents kept (compatibility composition)."""
    return _name(s, _strict)


def generational_suffix(suffix: Column, family: Column, given: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in GENERATIONS.items() for x in kv))

    def words(s: Column) -> Column:
        return F.filter(F.split(squeeze(F.lower(s)), " "), lambda w: w != "")

    def bare(w: Column) -> Column:
        return F.trim(w, F.lit(".,"))

    def last(s: Column) -> Column:
        w = words(s)
        tail = bare(F.element_at(w, -1))
        return F.when((F.size(w) >= 2) & (F.length(tail) >= 2), F.try_element_at(known, tail))

    own = F.try_element_at(F.filter(F.transform(words(suffix), lambda w: F.try_element_at(known, bare(w))), lambda g: g.isNotNull()), F.lit(1))
    return F.coalesce(own, last(family), last(given), F.lit(""))


def phone(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def email(s: Column) -> Column:
    return F.lower(strip(s))


def plausible_phone(s: Column) -> Column:
    return (F.length(s) >= 7) & ~s.rlike(r"^(.)\1*$")


def plausible_email(s: Column) -> Column:
    return s.rlike(r"(?s)^[^@]+@[^.]+\..+$")


def distinct_values(values: Column, normal) -> Column:
    return F.array_distinct(F.filter(F.transform(values, normal), lambda x: x != ""))


def _canonical(year: Column, month: Column, day: Column, raw: Column) -> Column:
    year = F.when(year.isin("", "1604"), F.lit("")).otherwise(year)
    md = F.concat_ws("-", F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    tested = F.concat_ws("-", F.when(year == "", F.lit("2000")).otherwise(year), md)
    valid = F.try_to_date(tested, "yyyy-MM-dd").isNotNull() & (year != "0000")
    return F.when(valid, F.concat(F.when(year == "", F.lit("-")).otherwise(year), F.lit("-"), md)).otherwise(raw)


def birthday(s: Column) -> Column:
    """``YYYY-MM-DD`` or ``--MM-DD`` of the readable forms; anything else as it is, trimmed."""
    raw = strip(s)

    def g(pattern: str, n: int) -> Column:
        return F.regexp_extract(raw, pattern, n)

    def flipped(pattern: str, first: int, second: int) -> tuple[Column, Column]:
        """Month and day, exchanged where the month cannot be one and the day can."""
        m, d = g(pattern, first), g(pattern, second)
        flip = (m.try_cast("int") > 12) & (d.try_cast("int") <= 12)
        return F.when(flip, d).otherwise(m), F.when(flip, m).otherwise(d)

    names = {m: n + 1 for n, m in enumerate(MONTHS)} | {m[:3]: n + 1 for n, m in enumerate(MONTHS)} | {"sept": 9}
    number = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, str(v))))

    def named(pattern: str, month: int, day: int) -> Column:
        m = F.try_element_at(number, F.lower(g(pattern, month)))
        return F.when(m.isNull(), raw).otherwise(_canonical(g(pattern, 3), m, g(pattern, day), raw))

    slash, dotted = flipped(_SLASH, 1, 2), flipped(_DOTTED, 2, 1)
    return (
        F.when(raw.rlike(_FULL), _canonical(g(_FULL, 1), g(_FULL, 2), g(_FULL, 3), raw))
        .when(raw.rlike(_NO_YEAR), _canonical(F.lit(""), g(_NO_YEAR, 1), g(_NO_YEAR, 2), raw))
        .when(raw.rlike(_YMD), _canonical(g(_YMD, 1), g(_YMD, 2), g(_YMD, 3), raw))
        .when(raw.rlike(_SLASH), _canonical(g(_SLASH, 3), *slash, raw))
        .when(raw.rlike(_DOTTED), _canonical(g(_DOTTED, 3), *dotted, raw))
        .when(raw.rlike(_DAY_MONTH), named(_DAY_MONTH, 2, 1))
        .when(raw.rlike(_MONTH_DAY), named(_MONTH_DAY, 1, 2))
        .otherwise(raw)
    )


def birthday_parts(s: Column) -> Column:
    """``ok, year, md`` of a canonical birthday (year ``-``: unknown)."""
    year, md = F.regexp_extract(s, _CANONICAL, 1), F.concat_ws("-", F.regexp_extract(s, _CANONICAL, 2), F.regexp_extract(s, _CANONICAL, 3))
    real = F.try_to_date(F.concat(F.when(year == "-", "2000").otherwise(year), F.lit("-"), md), "yyyy-MM-dd").isNotNull() & (year != "0000")
    return F.named_struct(F.lit("ok"), s.rlike(_CANONICAL) & F.coalesce(real, F.lit(False)), F.lit("year"), year, F.lit("md"), md)


def birthdays_agree(a: Column, b: Column) -> Column:
    return a["ok"] & b["ok"] & (a["md"] == b["md"]) & ((a["year"] == b["year"]) | (a["year"] == "-") | (b["year"] == "-"))


def plausible_birthday(p: Column) -> Column:
    return p["ok"] & (p["md"] != "01-01")


def birthday_without_year(s: Column) -> Column:
    return F.regexp_replace(s, _FULL, "--$2-$3")


def prefer_birthday(priority: Column, other: Column) -> Column:
    """The priority's value; filled if empty; completed by an agreeing date with a year."""
    p, o = birthday_parts(priority), birthday_parts(other)
    completes = birthdays_agree(p, o) & (p["year"] == "-") & (o["year"] != "-")
    return F.when(priority == "", other).when(completes, other).otherwise(priority)


def split_unescaped(s: Column, separator: str = ";") -> Column:
    """Units between separators that no backslash escapes; backslashes stay."""
    return F.regexp_extract_all(F.concat(s, F.lit(separator)), F.lit(rf"((?:[^{separator}\\]|\\(?s:.)|\\(?=$))*?){separator}"), F.lit(1))


def unescape(s: Column) -> Column:
    """``\\n`` is a line feed, any other escaped character itself; a last lone backslash stays."""
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    plain = F.transform(pieces, lambda p: F.when(~p.startswith("\\") | (F.length(p) == 1), p).when(p.isin(r"\n", r"\N"), "\n").otherwise(F.substring(p, 2, 1)))
    return F.array_join(plain, "")


def escape(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"([\\;,])", r"\\$1"), "\n", r"\\n")


def org(s: Column) -> Column:
    """Wire form with trimmed units, without trailing empty ones."""
    return F.regexp_replace(F.array_join(F.transform(split_unescaped(s), strip), ";"), ";+$", "")


def org_key(s: Column) -> Column:
    return F.lower(strip(s))


def address_key(a: Column) -> Column:
    return F.lower(F.concat_ws("|", a["street"], a["city"], a["region"], a["postcode"], a["country"]))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def display_name(c: Column | None = None) -> Column:
    """Formatted name, else given and family, else first e-mail, else first phone."""
    f = (lambda n: c[n]) if c is not None else F.col
    full = F.trim(F.concat_ws(" ", f("given_name"), f("family_name")))
    return F.coalesce(first_filled(f("formatted_name"), full, F.try_element_at(f("emails"), F.lit(1))["address"], F.try_element_at(f("phones"), F.lit(1))["number"]), F.lit("(unknown)"))


def display_phone(raw: Column) -> Column:
    """``(212) 555-0100`` where ten digits are left, else as written."""
    digits = phone(raw)
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")).otherwise(raw)


def display_org(org: Column) -> Column:
    """Units as text, joined by commas; empty ones are left out."""
    units = F.transform(split_unescaped(org), lambda u: strip(unescape(u)))
    return F.array_join(F.filter(units, lambda u: u != ""), ", ")


def display_address(a: Column) -> Column:
    parts = F.filter(F.array(a["street"], a["city"], a["region"], a["postcode"], a["country"]), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("(empty)")
