import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.functions.similarity import LONG_FORM, jaro_winkler, long_form, similarity


def values(spark, column, rows, names="s"):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names.split())).select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_names(spark):
    rows = ["Prof. Dr. Jane Smith Esq.", "José", "Dr.", "  Jane \t Smith ", "John V", "M.D.", "ΟΔΟΣ", ""]
    assert values(spark, X.name(F.col("s")), rows) == ["jane smith", "jose", "dr.", "jane smith", "john v", "m.d.", "οδοσ", ""]
    assert values(spark, X.name_strict(F.col("s")), ["Ｓmith", "Nguyễn", "Dr."]) == ["smith", "nguyễn", "dr."]


def test_generational_suffix(spark):
    rows = [("MD, Jr.", "Smith", "John"), ("", "Smith Sr", "John"), ("", "Smith", "John III"), ("", "Smith", "V"), ("", "Smith", "John V"), ("V", "Smith", "John"), ("MD", "", "")]
    assert values(spark, X.generational_suffix(F.col("a"), F.col("b"), F.col("c")), rows, "a b c") == ["jr", "sr", "iii", "", "", "v", ""]


def test_identifiers(spark):
    assert values(spark, X.phone(F.col("s")), ["+1 (555) 123-4567", "15551234567", "2555123456", "abc"]) == ["5551234567", "5551234567", "2555123456", ""]
    assert values(spark, X.plausible_phone(F.col("s")), ["1111111", "5551234", "555123"]) == [False, True, False]
    assert values(spark, X.email(F.col("s")), ["  A@B.org  "]) == ["a@b.org"]
    assert values(spark, X.plausible_email(F.col("s")), ["unknown", "user@localhost", "user@domain.", "@a.b", "a@b.c", "a@.b"]) == [False, False, False, False, True, False]


@pytest.mark.parametrize("raw, want", [
    ("1989-10-22", "1989-10-22"), ("19891022", "1989-10-22"), ("--1022", "--10-22"), ("1604-10-26", "--10-26"), ("22.10.1989", "1989-10-22"), ("10/22/1989", "1989-10-22"), ("22/10/1989", "1989-10-22"),
    ("10/22", "--10-22"), ("October 22, 1989", "1989-10-22"), ("22 Oct 1989", "1989-10-22"), ("sept 3", "--09-03"), ("10/22/89", "10/22/89"), ("1989-02-31", "1989-02-31"), ("0000-01-01", "0000-01-01"),
    ("1989-10-22T00:00:00Z", "1989-10-22"), ("1989-10-22 or 23", "1989-10-22 or 23"), (" 1989 ", "1989"), ("--02-29", "--02-29"), ("Foo 3", "Foo 3"), ("1989/1/2", "1989-01-02"), ("", ""),
])
def test_birthday(spark, raw, want):
    assert values(spark, X.birthday(F.col("s")), [raw]) == [want]


def test_prefer_birthday(spark):
    rows = [("", "1989-06-29"), ("--06-29", "1989-06-29"), ("--06-29", "1989-06-30"), ("1990-01-02", "1989-06-29"), ("--06-29", "soon"), ("soon", "1989-06-29")]
    assert values(spark, X.prefer_birthday(F.col("a"), F.col("b")), rows, "a b") == ["1989-06-29", "1989-06-29", "--06-29", "1990-01-02", "--06-29", "soon"]


def test_escapes_and_org(spark):
    rows = [r"a\;b;c", "one", "", ";x;;"]
    assert values(spark, F.array_join(X.split_unescaped(F.col("s")), "|"), rows) == [r"a\;b|c", "one", "", "|x||"]
    assert values(spark, X.org(F.col("s")), ["Acme; Sales ;", ";FRIEND", " ; "]) == ["Acme;Sales", ";FRIEND", ""]
    assert values(spark, X.unescape(F.col("s")), [r"a\;b\nc\\d\,"]) == ["a;b\nc\\d,"]
    assert values(spark, X.escape(F.col("s")), ["a;b\nc\\d,"]) == [r"a\;b\nc\\d\,"]


def test_similarity():
    for a, b, want in [("jack smith", "john smith", 0.82), ("eric johnson", "erica johnson", 0.984615), ("paul nguyen", "paula nguyen", 0.983333), ("chris fielding", "kris fielding", 0.926740), ("david lee", "davids lee", 0.98)]:
        assert jaro_winkler(a.encode(), b.encode()) == pytest.approx(want, abs=1e-6)
    assert similarity("bob smith", "robert smith") == 1.0
    assert long_form("bob") == "robert" and long_form("robert bob") == "robert bob"
    assert jaro_winkler(b"", b"a") == 0 and len(LONG_FORM) > 100
