"""Archives, media files and trained models."""

import hashlib
import os
import re
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import langid, line_dedup, matroska, queries, toxicity, warc, wordhash
from kinfold.plans.storage import materialize
from test_text_operators import contamination, jaccard_components

SF = "/root/testdata/sf0.001"


def archived(rows):
    rows = [(p, (h or "").encode()) for p, _, h in rows]
    groups = {}
    for p, h in rows:
        if len(h) >= warc.LEAST:
            groups.setdefault(h, []).append(p)
    out = []
    for p, h in rows:
        ids = [x for x in groups.get(h, []) if x is not None]
        best = max(ids) if ids and len(groups[h]) > 1 else None
        revisit = best is not None and p != best
        out.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_warc(spark):
    rows = [(1, "http://www.a.org/x", "z" * 2000), (2, "http://a.org/x", "z" * 2000), (3, None, None), (None, "http://b", "z" * 2000), (2, "http://a.org/x", "z" * 2000), (9, "u", "q" * 999), (10, "u", "q" * 999), (11, "https://é.example:8080/Ä?b\n#f", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.archive(pages).collect()), key=str) == archived(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert sorted(map(tuple, warc.archive(pages).collect()), key=str) == archived([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_warc_records_name_each_other():
    """Ids are a record's own, a revisit names its response's, and the block is an HTTP response."""
    first = warc.parse_record(warc.record(7, "http://a", b"body", "d", None, False))
    again = warc.parse_record(warc.record(8, "http://b", b"body", "d", 7, True, "f 9"))
    assert again[0]["WARC-Refers-To"] == first[0]["WARC-Record-ID"] and first[1] == b"body" and again[1] == b""
    assert len({warc.parse_record(warc.record(1, "u", b"", "d", None, False, f"f {i}"))[0]["WARC-Record-ID"] for i in range(9)}) == 9
    assert first[0]["Content-Type"] == "application/http;msgtype=response"


def test_warc_lookup(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i}", f"text {i}") for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    index = warc.build_index(warc.write_archives(pages, f"{folder}/a"), f"{folder}/i")
    keys = spark.createDataFrame([("org,h3)/p10",), ("org,h3)/none",), (None,)], "key string")
    got = warc.read_captures(warc.lookup(keys, index, f"{folder}/i"), f"{folder}/a", payloads=True).collect()
    assert [(r.page_id, r.payload) for r in got] == [(10, "text 10")]


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, 576 * 1000])
def test_matroska_round_trip(size):
    payload = matroska.pad(os.urandom(size))
    data = matroska.write_mkv(payload)
    media = matroska.parse_mkv(data)
    assert len(payload) % 576 == 0 and payload and b"".join(data[a:b] for *_, a, b in media.packets) == payload
    assert [media.segment + c for _, _, c in media.cues] == media.clusters and media.tracks == [(1, 2, "A_PCM/INT/LIT")]


def test_matroska_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]

    def block(flags, body):
        return b"\x81" + struct.pack(">h", 5) + bytes([flags]) + body + b"".join(frames)

    xiph = block(0x82, bytes([2, 255, 45, 10]))
    ebml = block(0x06, bytes([2]) + matroska.vint(300) + ((10 - 300 + (1 << 13) - 1) | 1 << 14).to_bytes(2, "big"))
    e, n = matroska.element, matroska.number
    data = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + n(matroska.TIMESTAMP, 100) + e(matroska.SIMPLE_BLOCK, xiph) + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, ebml), n(0xFB, 1))
    data += e(matroska.CUES, e(matroska.CUE_POINT, n(matroska.CUE_TIME, 1), e(matroska.CUE_POSITIONS, n(matroska.CUE_TRACK, 1), n(matroska.CUE_CLUSTER, 7))))
    media = matroska.parse_mkv(data)
    assert [data[a:b] for *_, a, b in media.packets] == frames * 2 and media.cues == [(1, 1, 7)]
    assert [p[:3] for p in media.packets] == [(1, 105, True)] * 3 + [(1, 105, False)] * 3
    with pytest.raises(ValueError):
        matroska.parse_mkv(matroska.write_mkv(matroska.pad(b"x"))[:-3])


def test_matroska_query(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (None, "héllo"), (3, "x" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in matroska.features(matroska.store(docs)).collect()}
    payload = matroska.pad("héllo".encode())
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (6, 576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[None][1:] == got[1][1:] and got[2].n_bytes == 0 and got[3].payload_bytes == 5184
    assert matroska.packets(matroska.store(docs)).where("doc_id = 3").count() == 9
    assert matroska.features(matroska.store(docs.limit(0))).count() == 0


def test_matroska_of_a_table(spark):
    """Every column of the query, by other means: the padded text, a file written anew, and its packets counted by size."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_matroska(spark, SF).collect():
        raw = docs.pop(r.doc_id)
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        frames, mean = len(payload) // 576, sum(payload) // len(payload)
        spread = sum(abs(x - mean) for x in payload) // len(payload)
        file = matroska.write_mkv(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.error) == (len(file), hashlib.sha256(file).hexdigest(), None)
        last = 576 * 1000 * ((frames - 1) // 8 * 8) // 48000
        assert r.feature == f"packets={frames};clusters={-(-frames // 512)};cues={-(-frames // 512)};last={last};mean={mean};spread={spread}"
    assert not docs


def test_matroska_bad_files(spark):
    """A bad file has its error in its row and ends nothing."""
    good = matroska.write_mkv(matroska.pad(b"x"))
    short = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00")))
    files = spark.createDataFrame([(1, 1, good), (2, 1, good[:-3]), (3, 1, short), (4, 1, None)], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id: r.error is None for r in matroska.packets(files).collect()} == {1: True, 2: False, 3: False}
    got = {r.doc_id: r for r in matroska.features(files).collect()}
    assert got[1].error is None and all(got[i].error and got[i].payload_sha256 is None for i in (2, 3, 4))


def test_network_gradients():
    """Of the recurrent network against differences."""
    p = {k: v.astype(np.float64) for k, v in toxicity.init(1).items()}
    texts = [b"alpha beta gamma delta", b"one two", b"x" * 30]
    letters, h, borders = toxicity.cut_words(texts)
    kinds, where, numbers = np.unique(h, return_index=True, return_inverse=True)
    w = toxicity.Words(letters[where], kinds)
    args = (w, numbers, np.diff(borders), np.array([1.0, 0.0, 1.0]))
    _, g = toxicity.loss_and_gradients(p, *args)
    rng = np.random.default_rng(0)
    for name in ("attend", "out", "bias", "wuf", "wub", "wwf", "cuf", "cwb", "cbf", "wbf"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        kept = p[name][at]
        losses = []
        for d in (1e-4, -1e-4):
            p[name][at] = kept + d
            losses.append(toxicity.loss_and_gradients(p, *args)[0])
        p[name][at] = kept
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2, abs=2e-5), name


def plain_toxicity(p, text):
    """The network word by word and window by window."""

    def cell(x, h, u):
        n = len(h)
        hu = h @ u
        z, r = (1 / (1 + np.exp(-(x[k * n : (k + 1) * n] + hu[k * n : (k + 1) * n]))) for k in (0, 1))
        return z * h + (1 - z) * np.tanh(x[2 * n :] + r * hu[2 * n :])

    def states(xs, kind, d):
        h, out = np.zeros(p[f"{kind}u{d}"].shape[0]), []
        for x in xs if d == "f" else xs[::-1]:
            h = cell(x @ p[f"{kind}w{d}"] + p[f"{kind}b{d}"], h, p[f"{kind}u{d}"])
            out.append(h)
        return out if d == "f" else out[::-1]

    words = [w[i : i + toxicity.CHARS] for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower()) for i in range(0, len(w), toxicity.CHARS)]
    vectors = []
    for w in words:
        letters = np.frombuffer(w.ljust(toxicity.CHARS, b"\0"), np.uint8)[None]
        k = toxicity.Words(letters, toxicity._whole(letters))
        x = [p["chars"][c] for c in w]
        vectors.append(np.concatenate([states(x, "c", "f")[-1], states(x, "c", "b")[0], p["starts"][k.start[0]], p["words"][k.whole[0]]]))
    best = -np.inf
    for at in range(0, max(1, len(words) - toxicity.WORDS + toxicity.STRIDE), toxicity.STRIDE):
        window = vectors[at : at + toxicity.WORDS]
        h = np.array([np.concatenate(x) for x in zip(states(window, "w", "f"), states(window, "w", "b"), strict=True)])
        a = np.exp(h @ p["attend"])
        best = max(best, (a / a.sum()) @ h @ p["out"] + p["bias"][0])
    return 1 / (1 + np.exp(-best))


def test_toxicity_against_plain_loops():
    p = {k: v.astype(np.float64) for k, v in toxicity.init(2).items()}
    texts = ["Ein Wort, zwei W\u00f6rter".encode(), b"x" * 40, b" ".join(b"w%d" % i for i in range(120)), b"one"]
    assert np.allclose(toxicity.Scorer(toxicity.init(2)).scores(texts), [plain_toxicity(p, t) for t in texts], atol=1e-4)


def test_toxicity_of_long_texts(monkeypatch):
    """A text longer than a slice has the score it has in one piece; ties and repeats score alike."""
    text = b" ".join(b"word%d" % (i % 77) for i in range(4000))
    scorer = toxicity.Scorer(toxicity.init(3))
    whole = scorer.scores([text, text])
    monkeypatch.setattr(toxicity, "SLICE", 1000)
    monkeypatch.setattr(wordhash.slices, "__defaults__", (1000,))
    assert np.allclose(scorer.scores([text]), whole, atol=1e-6)


def test_language_network_gradients():
    """Of the byte network against differences, and its responses against plain loops."""
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], [rng.normal(0, 0.3, (w, 256, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(0, 0.3, 24), rng.normal(0, 0.3, (24, 2)), np.zeros(2))
    x, y = rng.integers(97, 110, (5, 20)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    for table, r in zip(model.tables, langid.responses(model, x), strict=True):
        assert np.allclose(r[2, 3], sum(table[j, x[2, 3 + j]] for j in range(len(table))))
    _, grads = langid.gradients(model, x, y)
    for p, g in zip(model.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = p[at], []
        for d in (1e-5, -1e-5):
            p[at] = kept + d
            losses.append(langid.gradients(model, x, y)[0])
        p[at] = kept
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3)


def test_toxicity_held_out(spark):
    """Trained on the rows that are not held out; the labels mark words in one language and word parts in others."""
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    marked, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(marked) >= 0.9 and np.mean(clean) <= 0.03


def test_toxicity_defined_cases(spark):
    scorer = toxicity.Scorer(toxicity.init())
    texts = [b"", b"...", b"one two three " * 200, b"x" * 5000]
    got = scorer.scores(texts)
    assert got[0] == got[1] and np.allclose(got, [scorer.scores([t])[0] for t in texts], atol=1e-6)
    docs = spark.createDataFrame([(1, None, "s"), (None, "a", "t")], "doc_id long, text string, score string")
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), toxicity.init()).count() == 0
    assert toxicity.fit(docs, docs.selectExpr("doc_id", "1 as toxic")) is None


def test_language_held_out(spark):
    got = queries.op7_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.95


def test_every_language_is_learned(spark):
    rows = [(3 * i + j, f"{chr(0x4E00 + i)} {chr(0x4E00 + i) * 3} " * 5, f"l{i}") for i in range(70) for j in range(3)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == sorted({r[2] for r in rows})


def test_language_defined_cases(spark):
    model = langid.train([b"abc abc abc", b"xyz xyz"], ["a", "b"], epochs=5)
    assert langid.identify(model, [b"", b"123 !?", "½ ² ① Ⅷ".encode(), b"abc"])[0][:3] == ["und"] * 3
    assert langid.identify(model, [b"abc", b"abc"])[1][0] == langid.identify(model, [b"abc"])[1][0]
    docs = spark.createDataFrame([(1, None, "x"), (None, "abc", "y")], "doc_id long, text string, score string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}[1] == "und"
    assert langid.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.drop_unidentified(docs, model).columns == docs.columns


ROWS = [(1, "The cat sat here.", "en", "a", 17, "x"), (2, None, None, None, None, None), (None, "The cat sat here.", None, "a", 17, "x"), (3, "", "en", None, 0, None), (1, "The cat sat here.", "en", "a", 17, "x"), (4, "12 !?", "de", "b", 5, ""), (5, "Wort " * 30000, "de", "b", 5, "y")]
WIDE = "doc_id long, text string, lang string, source string, n_chars long, text_md5_0 string"


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, a long text, a column with an inner name, no optional columns, empty tables."""
    spark.createDataFrame([("i", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, WIDE)
    for frame in (docs, docs.select("doc_id", "text", "lang"), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, frame, str(tmp_path))
            assert got.columns == frame.columns and got.count() <= frame.count(), name
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "None"]
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs.drop("lang"), str(tmp_path)).collect()}
    assert ids[2] == ids[3] == 0 and ids[5] > 30000


def test_pipeline(spark):
    """Each stage against brute force on its own input, and the whole run against the stages."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def rows(df):
        return {r.doc_id: r for r in df.collect()}

    was, stages, steps = rows(docs), [f for _, f in corpus_pipeline.STAGES], []
    for f in stages[:4]:
        docs = materialize(f(spark, docs, SF), "stage")
        steps.append(rows(docs))
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~queries.held_out("doc_id", 4, 2)))
    told = {i: langid.identify(model, [(r.text or "").encode()]) for i, r in was.items()}
    assert steps[0] == {i: r for i, r in was.items() if told[i][0][0] != "und" and told[i][1][0] >= langid.LEAST_SCORE}
    db = duckdb.connect()
    db.register("documents", pd.DataFrame([(i, r.text) for i, r in steps[0].items()], columns=["doc_id", "text"]))
    assert {i: r.text for i, r in steps[1].items()} == dict(db.sql(f"SELECT doc_id, clean FROM ({line_dedup.cleaned_sql()})").fetchall())
    assert all(r.n_chars == len(r.text) for r in steps[1].values())
    assert sorted(steps[2]) == [i for i, _, _, kept in jaccard_components([(i, r.text) for i, r in steps[1].items()], 5, 80) if kept]
    assert sorted(steps[3]) == sorted(r[0] for r in contamination([(i, r.text) for i, r in steps[2].items()], bench) if not r[5])
    library = Tokenizer.from_file(queries.TOKENIZER)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in out} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in steps[3].items()}
    assert all(r.n_tokens == len(r.ids) for r in out)
