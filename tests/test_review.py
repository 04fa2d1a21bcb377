"""Review, resolve from files, run, reports and the vCard source against hand-made cases."""

import json
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from kinfold.functions import text as X
from kinfold.operators import review
from kinfold.operators.graph import connected_components
from kinfold.plans import commands, storage
from kinfold.sources import logs, vcard
from pyspark.sql import functions as F
from test_resolution import contact, resolution

CARD = "BEGIN:VCARD\r\nVERSION:3.0\r\nN:{}\r\nFN:{}\r\n{}END:VCARD\r\n"


def exports(tmp_path):
    """A sure pair, an unsure pair (Eric and Erica on one phone), and one card alone."""
    (tmp_path / "i.vcf").write_text(CARD.format("Chen;Wei;;;", "Wei Chen", "EMAIL:wei@x.org\r\nTEL:2125551234\r\n") + CARD.format("Stone;Eric;;;", "Eric Stone", "TEL:2125550001\r\nUID:1\r\n"))
    (tmp_path / "g.vcf").write_text(CARD.format("Chen;Wei;;;", "Wei Chen", "EMAIL:wei@x.org\r\n") + CARD.format("Stone;Erica;;;", "Erica Stone", "TEL:2125550001\r\nUID:2\r\nTITLE:CEO\r\n") + CARD.format("Fox;Al;;;", "Al Fox", ""))
    return [str(tmp_path / n) for n in ("i.vcf", "g.vcf")]


def log(path, *entries):
    path.write_text("".join(json.dumps({"seq": n, "cluster_id": c, "decision": d, "timestamp": "2024-01-01T00:00:00Z"}) + "\n" for n, (c, d) in enumerate(entries)))
    return str(path)


def merged(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("merged.vcf", "review.vcf", "report.json")]
    commands.merge(spark, *exports(tmp_path), *paths)
    return paths, json.loads((tmp_path / "report.json").read_text())


def test_resolve_from_files(spark, tmp_path):
    (out, cards, report), told = merged(spark, tmp_path)
    assert told["summary"]["needs_review"] == 1 and len(told["reviews"]) == 1 and told["reviews"][0]["decision"] == "pending" and len(told["members"]) == 4
    name, final = told["reviews"][0]["cluster_id"], str(tmp_path / "final.vcf")
    for said, names in (([], ["Al Fox", "Eric Stone", "Erica Stone", "Wei Chen"]), (["skip"], ["Al Fox", "Wei Chen"]), (["skip", "undo", "merge"], ["Al Fox", "Eric Stone", "Wei Chen"])):
        pending = commands.apply_decisions(spark, report, log(tmp_path / "log.jsonl", *((name, d) for d in said)))
        assert pending == (not said)
        commands.resolve(spark, report, cards, out, final)
        got = vcard.read_vcards(spark, final).collect()
        assert sorted(r.formatted_name for r in got) == names
    eric = next(r for r in got if r.formatted_name == "Eric Stone")
    assert eric.title == "CEO" and eric.extra == {"UID": ["1"], "X-KINFOLD-SOURCE": ["merged(icloud+google)"]}
    wei = next(r for r in got if r.formatted_name == "Wei Chen")
    assert wei.extra["X-KINFOLD-SOURCE"] == ["merged(icloud+google)"] and [r for r in got if r.formatted_name == "Al Fox"][0].source == "google"
    with pytest.raises(ValueError, match="not in the report"):
        commands.apply_decisions(spark, report, log(tmp_path / "log.jsonl", ("nobody", "merge")))


def test_reports_and_review_files_have_to_agree(spark, tmp_path):
    (_, cards, report), told = merged(spark, tmp_path)
    clusters, read = commands.load_report(spark, report), vcard.read_vcards(spark, cards, "review")
    assert [r.decision for r in review.aligned(clusters, read).collect()] == ["pending"] * 2
    with pytest.raises(ValueError, match="names 2"):
        review.aligned(clusters, read.limit(1))
    with pytest.raises(ValueError, match="names 2"):
        review.aligned(clusters, read.unionByName(read))
    with pytest.raises(ValueError, match="tagged"):
        review.aligned(clusters.withColumn("cluster_id", F.lit("other")), read)
    with pytest.raises(ValueError, match="without contacts"):
        review.aligned(clusters.withColumn("sources", F.array().cast("array<string>")), read)


def test_run(spark, tmp_path):
    """Paused without decisions, its workspace kept; done with them; the log is appended and --keep copies."""
    files, out = exports(tmp_path), tmp_path / "o" / "final.vcf"
    with pytest.raises(commands.Paused) as paused:
        commands.run(spark, *files, str(out))
    space = json.loads(open(f"{paused.value.workspace}/report.json").read())
    said = log(tmp_path / "log.jsonl", (space["reviews"][0]["cluster_id"], "skip"))
    assert commands.run(spark, *files, str(out), said, str(tmp_path / "saved.json"), keep=True) == 1
    assert out.read_text().count("BEGIN:VCARD") == 2 and (tmp_path / "o" / "review.vcf").exists() and (tmp_path / "o" / "merged.vcf").exists()
    assert json.loads((tmp_path / "saved.json").read_text())["reviews"][0]["decision"] == "skip" and '"skip"' in (tmp_path / "o" / "calibration.jsonl").read_text()
    with pytest.raises(ValueError, match="same file"):
        commands.run(spark, *files, files[0])


def test_review_state(spark, tmp_path):
    entries = logs.read(spark, log(tmp_path / "log.jsonl", ("a", "merge"), ("b", "skip"), ("c", "merge"), ("c", "undo")))
    clusters = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.7), ("e", 0.6)], "cluster_id string, score double")
    state = review.decision_state(clusters, entries)
    assert {r.cluster_id: r.decision for r in state.collect()} == {"a": "merge", "b": "skip", "c": "pending", "d": "pending", "e": "pending"}
    assert tuple(review.pending_counts(state).head()) == (3, 2)
    assert [review.next_pending(state, after).head().cluster_id for after in (None, (0.7, "d"), (0.1, "z"))] == ["c", "d", "c"]
    assert review.undo_entry(entries).head().cluster_id == "b" and review.next_pending(state.limit(0)).count() == 0
    assert "2 pairs reviewed" in review.session_summary(entries, 3) and "paused" in review.session_summary(entries, 3)
    queue = state.withColumn("view_mode", F.lit("compact"))
    shown = review.shown_mode(queue, queue.where("cluster_id = 'a'").withColumn("view_mode", review.toggled(F.col("view_mode"))))
    assert {r.cluster_id: r.view_mode for r in shown.collect()}["a"] == "detailed"


def test_evidence(spark):
    r = resolution(
        spark,
        contact(0, "Eric", "Stone", "google", emails=[("x@y.org", ""), ("e@s.org", "")], phones=[("(317) 555-9876", ""), ("000", "")], org=";Sales"),
        contact(1, "Erica", "Stone", "icloud", emails=[("E@s.org", "")], phones=[("13175559876", "")], addresses=[("", "1 A St", "", "", "", "Italy", "", "")]),
        contact(2, "", "", "icloud", email="e@s.org"),
    )
    best = r.scored.where("a = 0 and b = 1").withColumn("cluster", F.lit(0))
    e = review.evidence(best, r.contacts, r.norm).head()
    assert (e.left.idx, e.left.email, e.left.phone, e.left.addresses) == (1, "✓ E@s.org", "✓ (317) 555-9876", ["1 A St, Italy"])
    assert (e.right.idx, e.right.email, e.right.phone, e.right.org) == (0, "✓ e@s.org +1", "✓ (317) 555-9876 +1", "Sales")
    bare = review.breakdown(r.scored.where("a = 0 and b = 2").withColumn("cluster", F.lit(0))).head()
    assert bare.short == "email +0.45 = 0.45" and "no names" in bare.lines


def test_namesakes_without_names_score_by_the_other_weights(spark):
    r = resolution(spark, contact(0, "", "Lee", email="a@b.org", phone="2125550001"), contact(1, "", "Lee", "google", email="a@b.org", phone="2125550001"), contact(2, "Jo Ann", "Ray", phone="2125550002"), contact(3, "Jo", "Ray", "google", phone="2125550002", middle_name="Ann"), contact(4, "Jo", "Ray", "google", phone="2125550002", middle_name="B."))
    got = {(x.a, x.b): x for x in r.scored.collect()}
    assert got[0, 1].nameless and got[0, 1].score == 0.9 and got[0, 1].tier == "auto_merge"
    assert got[2, 3].name_exact and not got[3, 4].name_exact and not got[2, 4].name_exact


def test_pairs_of_a_large_key(spark, monkeypatch):
    """Blocks of pairs give every pair once."""
    from kinfold.operators import blocking

    monkeypatch.setattr(blocking, "BLOCK", 7)
    rows = spark.range(40).selectExpr("cast(id as int) as idx", "array('k') as phone_keys").unionByName(spark.range(50, 53).selectExpr("cast(id as int) as idx", "array('l', 'm') as phone_keys"))
    got = blocking.block_phone(rows).collect()
    assert len(got) == 40 * 39 // 2 + 3 and {(r.a, r.b) for r in got} == {(a, b) for a in range(40) for b in range(a + 1, 40)} | {(50, 51), (50, 52), (51, 52)}
    assert blocking.block_phone(rows, cap=10).count() == 3


def test_wire_form_is_lossless(spark):
    texts = ["a\\b", "c:\\new", "x\\n", "a;b,c\\", "line\nfeed", "\\", "\\\\;", "", "é\u2028\x85 end"]
    assert [vcard.unescape(vcard.escape(t)) for t in texts] == texts
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(X.unescape(X.escape(F.col("s")))).collect()] == texts
    assert spark.createDataFrame([("a\x01\\",)], "s string").select(X.unescape(F.col("s"))).head()[0] == "a\x01\\"
    rows = [contact(i, f"G{t}", "F", note=t) for i, t in enumerate(texts)]
    back = vcard.parse_cards(vcard.card_lines(spark.createDataFrame(rows, storage_schema()))).orderBy("idx").collect()
    assert [r.note for r in back] == [t.replace("\x85", "") for t in texts]


def storage_schema():
    from kinfold.model import CONTACT

    return CONTACT


def test_line_breaks_and_parameters():
    text = "BEGIN:VCARD\nFN:A\nNOTE:one\u2028two\x0cthree\x85four\nTEL;PREF=²:1\nTEL;PREF=1:2\nEND:VCARD\n"
    card = next(vcard.cards(text))[1]
    assert card.text("NOTE") == "one\u2028twothreefour" and card.preferred("TEL").value == "2"


def test_indexes_go_on_over_files(spark, tmp_path):
    for n, names in (("a", "AB"), ("b", ""), ("c", "CDE")):
        (tmp_path / f"{n}.vcf").write_text("".join(f"BEGIN:VCARD\nFN:{x}\nEND:VCARD\n" for x in names) + ("BEGIN:VCARD\nFN:lost\n" if n == "a" else ""))
    parsed = vcard.parse_files(spark, str(tmp_path))
    assert [(r.idx, r.formatted_name) for r in vcard.contacts(parsed).orderBy("idx").collect()] == list(enumerate("ABCDE"))
    assert [r.card for r in vcard.warnings(parsed).collect()] == [2]


def test_large_files_are_cut_between_cards(spark, tmp_path):
    body = "".join(f"BEGIN:VCARD\r\nFN:N{i}\r\nNOTE:END:VCARD\\nBEGIN:VCARD {'x' * (i % 50)}\r\nEND:VCARD\r\n" for i in range(300))
    (tmp_path / "big.vcf").write_bytes((body + "BEGIN:VCARD\r\nFN:open\r\n" + "BEGIN:VCARD\r\nFN:in\r\nEND:VCARD\r\n").encode())
    whole, parts = (vcard.contacts(f).select("idx", "formatted_name", "note").collect() for f in (vcard.parse_files(spark, str(tmp_path)), vcard.parse_large(spark, str(tmp_path), chunk_bytes=700)))
    assert sorted(parts) == sorted(whole) and len(whole) == 300
    assert vcard.warnings(vcard.parse_large(spark, str(tmp_path), chunk_bytes=700)).count() == 1


def test_prune_text_and_both_files_or_neither(spark, tmp_path, monkeypatch):
    f = tmp_path / "a.vcf"
    f.write_text(CARD.format("A;B;;;", "B A", "EMAIL:unknown\r\n") + CARD.format(";C;;;", "C", "TEL:+1 212 555 1234\r\n") + CARD.format(";D;;;", "D", ""))
    text = commands.prune_text(commands.run_prune(spark, str(f), None, None))
    assert "Reachable by email, phone, or address: 1" in text and "  1. B A — has: email\n  2. D — has: name only" in text and "dry run" in text
    real, calls = vcard.stage_file, []
    monkeypatch.setattr(vcard, "stage_file", lambda df, p, *a: calls.append(p) or (real(df, p, *a) if len(calls) == 1 else (_ for _ in ()).throw(OSError("full"))))
    with pytest.raises(OSError):
        commands.run_prune(spark, str(f), str(tmp_path / "kept.vcf"), None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.vcf"]


def test_shared_folder(spark, tmp_path):
    df = storage.materialize(spark.range(3), "three")
    assert df.count() == 3 and storage.exists(spark, df.stored_at)
    storage.release(df)
    assert not storage.exists(spark, df.stored_at)
    for name in ("a", "b"):
        spark.range(1).write.parquet(f"file://{tmp_path}/{name}")
    assert storage.rename(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/t") and not storage.rename(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/t")
    assert (tmp_path / "b").exists() and spark.read.parquet(f"file://{tmp_path}/t").count() == 1


def test_giant_component(spark):
    edges = spark.range(1, 3000).selectExpr("id - 1 as src", "id as dst").unionByName(spark.range(3001, 5000).selectExpr("3000L as src", "id as dst"))
    got = connected_components(edges).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: 3000, 3000: 2000}


def test_the_rest_works_without_the_training_data_parts():
    code = "import sys; sys.modules['kinfold.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 30 and not any(q.startswith('op') or q == 'pipeline' for q in [*e.queries(), *e.oracle_sql()])"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
