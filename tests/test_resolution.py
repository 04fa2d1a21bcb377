import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.operators import clustering, prune
from kinfold.operators.graph import connected_components
from kinfold.plans.commands import check_distinct_paths, merge, run_prune
from kinfold.plans.resolution import Resolution
from kinfold.sources import vcard
from kinfold.model import CONTACT

SF = "/root/testdata/sf0.001"


def contact(idx, given, family, source="icloud", email=None, phone=None, **more):
    row = {"idx": idx, "source": source, "given_name": given, "family_name": family, "formatted_name": f"{given} {family}".strip(), "emails": [(email, "")] if email else [], "phones": [(phone, "")] if phone else [], "addresses": [], "photo": None, "extra": {}} | more
    return tuple(row.get(f.name, "") for f in CONTACT.fields)


def resolution(spark, *rows):
    return Resolution(spark.createDataFrame(rows, CONTACT))


@pytest.mark.parametrize("name", ["scored_pairs", "merged_contacts", "review_queue", "deferred_pairs", "conflicts", "calibration_counts", "prune_detail_counts", "prune_split", "birthday_forms", "vcard_write", "vcard_parse", "vcard_roundtrip", "merged_fields", "generations", "review_breakdown", "review_evidence", "decision_state", "resolve_from_files"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("customer", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (7, 7), (None, 1)], "src int, dst int")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 10), (11, 10)]
    assert connected_components(edges.limit(0)).count() == 0


def test_tiers(spark):
    r = resolution(
        spark, contact(0, "John", "Doe", phone="2125551234"), contact(1, "John", "Doe", "google", phone="212-555-1234"), contact(2, "Eric", "Stone", phone="2125550001"), contact(3, "Erica", "Stone", "google", phone="2125550001"),
        contact(4, "J.R.", "Ray", phone="2125550009"), contact(5, "J.R.", "Ray", "google", phone="2125550009"), contact(6, "Bob", "Fox", phone="2125550007", suffix="Jr."), contact(7, "Bob", "Fox", "google", phone="2125550007", suffix="Sr."),
        contact(8, "Ann", "Lee", phone="2125550011", birthday="1980-02-03"), contact(9, "Ann", "Lee", "google", phone="2125550011", birthday="1981-02-03"),
    )
    tiers = {(x.a, x.b): x.tier for x in r.scored.collect()}
    assert tiers[0, 1] == "auto_merge" and tiers[2, 3] == tiers[4, 5] == tiers[6, 7] == tiers[8, 9] == "review"


def test_near_names_pair_across_sources(spark):
    names = [contact(i, "Maria", "Silva", "icloud" if i < 3 else "google") for i in range(6)]
    r = resolution(spark, *names)
    assert sorted((x.cluster, x.idx) for x in r.placed.collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    late = r.deferred.collect()
    assert sorted((x.side_a, x.side_b) for x in late) == [([0, 3], [1, 4]), ([0, 3], [2, 5]), ([1, 4], [2, 5])]


def test_survivorship(spark):
    r = resolution(
        spark,
        contact(0, "Ann", "Lee", "google", email="ann@x.org", phone="2125550011", title="CEO", birthday="1980-02-03", extra={"UID": ["g"], "X-A": ["1", "2"]}, addresses=[("HOME", "1 A St", "", "", "", "", "", "")]),
        contact(1, "Ann", "Lee", "icloud", email="ANN@x.org", phone="+1 212 555 0011", birthday="--02-03", extra={"UID": ["i"], "X-A": ["2"]}, addresses=[("WORK", "1 a st", "", "", "", "", "", "")]),
    )
    m = r.merged.collect()
    assert len(m) == 1
    m = m[0]
    assert (m.idx, m.source, m.title, m.birthday) == (1, "icloud", "CEO", "1980-02-03")
    assert [e.address for e in m.emails] == ["ANN@x.org"] and [p.number for p in m.phones] == ["+1 212 555 0011"] and len(m.addresses) == 1
    assert m.extra == {"UID": ["i"], "X-A": ["2", "1"]} and list(m.merged_from) == [0, 1] and list(m.sources) == ["google", "icloud"]


def test_decisions(spark):
    r = resolution(spark, contact(0, "Eric", "Stone", phone="2125550001"), contact(1, "Erica", "Stone", "google", phone="2125550001"), contact(2, "Zoe", "Quist"))
    for decision, kinds in (("merge", ["distinct", "resolved"]), ("skip", ["distinct"]), ("later", ["distinct", "pending", "pending"])):
        out = r.resolve(spark.createDataFrame([(0, decision)], "cluster int, decision string"))
        assert sorted(x.kind for x in out.collect()) == kinds


def test_prune(spark, tmp_path):
    with pytest.raises(ValueError):
        prune.parse_channels("fax")
    assert prune.parse_channels(" Email, URL ,email") == ["email", "url"]
    f = tmp_path / "a.vcf"
    f.write_text("BEGIN:VCARD\nVERSION:3.0\nN:A;B\nFN:B A\nEMAIL:unknown\nEND:VCARD\nBEGIN:VCARD\nVERSION:3.0\nFN:C\nTEL:+1 212 555 1234\nEND:VCARD\nBEGIN:VCARD\nFN:D\nADR:;;;Rome;;;\nEND:VCARD\n")
    got = run_prune(spark, str(f), str(tmp_path / "kept.vcf"), None)
    assert (got["total"], got["kept"], got["removed"]) == (3, 1, 2)
    assert [x["name"] for x in got["removed_contacts"]] == ["B A", "D"]
    assert "FN:C" in (tmp_path / "kept.vcf").read_text() and "FN:D" in (tmp_path / "kept-removed.vcf").read_text()


def test_merge_files(spark, tmp_path):
    card = "BEGIN:VCARD\r\nVERSION:3.0\r\nN:{}\r\nFN:{}\r\n{}END:VCARD\r\n"
    (tmp_path / "i.vcf").write_text(card.format("Chen;Wei;;;", "Wei Chen", "EMAIL:wei@x.org\r\nTEL:2125551234\r\n") + card.format("Fox;Al;;;", "Al Fox", "NOTE:a\\;b\\nc\r\n"))
    (tmp_path / "g.vcf").write_text(card.format("Chen;Wei;;;", "Wei Chen", "EMAIL:wei@x.org\r\nEMAIL:w@y.org\r\n") + "BEGIN:VCARD\r\nFN:Lost\r\n")
    r = merge(spark, *(str(tmp_path / n) for n in ("i.vcf", "g.vcf", "out.vcf", "review.vcf", "report.json")))
    assert r.output.count() == 2 and not (tmp_path / "review.vcf").exists()
    back = vcard.read_vcards(spark, str(tmp_path / "out.vcf")).orderBy("idx").collect()
    assert [e.address for e in back[0].emails] == ["w@y.org", "wei@x.org"] and back[1].note == "a;b\nc"
    assert '"warnings": 1' in (tmp_path / "report.json").read_text()


def test_parser():
    text = "BEGIN:VCARD\nN:Doe;Jo\\;hn;;Dr.;\nTEL;TYPE=cell,pref:1\nitem1.EMAIL;PREF=1:a@b.c\nADR;TYPE=home:;;1 A;\n  St;;;\nPHOTO;ENCODING=b:!!\nX-T:w\nEND:VCARD\nBEGIN:VCARD\nBEGIN:VCARD\nEND:VCARD\n"
    rows = [dict(zip([f.name for f in vcard.PARSED.fields], r, strict=True)) for r in vcard.parsed_rows(text, "unknown")]
    c = rows[0]
    assert (c["family_name"], c["given_name"], c["prefix"]) == ("Doe", "Jo;hn", "Dr.") and c["phones"][0]["type"] == "CELL" and c["emails"][0]["address"] == "a@b.c"
    assert c["photo"] is None and c["extra"] == {"X-T": ["w"]} and rows[1]["kind"] == "warning" and "absorbed" in rows[1]["warning"]
    assert vcard.provenance("merged(icloud+google)", "x") == ["icloud", "google"] and vcard.provenance("merged(a+b)", "x") == ["x"]


def test_data_source(spark, tmp_path):
    spark.dataSource.register(vcard.VCardSource)
    (tmp_path / "a.vcf").write_text("BEGIN:VCARD\nFN:A\nEND:VCARD\n")
    assert [r.formatted_name for r in spark.read.format("vcard").load(str(tmp_path)).collect()] == ["A"]


def test_paths(tmp_path):
    a = str(tmp_path / "a.vcf")
    with pytest.raises(ValueError):
        check_distinct_paths([a], [a.upper() if os.path.realpath(a).casefold() == a.casefold() else a])
    with pytest.raises(ValueError):
        check_distinct_paths([], [a, a + ".tmp"])


def test_stream(spark, tmp_path):
    from kinfold.sources import logs
    from kinfold.streaming.decisions import latest

    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"cluster_id":"a","decision":"skip","score":0.6,"timestamp":"2024-01-01T00:00:00Z"}\n{"cluster_id":"a","decision":"merge","score":0.6,"timestamp":"2024-01-02T00:00:00Z"}\n')
    q = latest(logs.stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest").collect()] == [("a", "merge", 0.6)]
