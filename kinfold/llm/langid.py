"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes pass filters of widths 2, 3 and 4 over their bytes, then a maximum over positions, a
rectifier and a softmax layer, all trained here in numpy with Adam. A filter over one-hot bytes is a table look-up,
so scoring adds rows of small tables. Every text is scored whole: all its windows, the last one padded, and the
windows' probabilities averaged by their bytes.

Training takes a bounded sample of labelled windows. Of every language that occurs about ``DOCS_PER_LANG`` documents
are drawn (if there are so many languages that ``DOCS`` do not suffice, an equal share of these, but ``LEAST_DOCS``),
and of all windows of their whole texts ``WINDOWS_PER_LANG`` for each language; both draws are the first in the order of
a hash. Scores do not depend on anything but the text.

Defined results: ``und`` with score 0 for a null text or one without a letter (``\\p{L}``); ``und`` everywhere if there
is nothing to learn from. Of equal probabilities the first language in alphabetical order wins. Rows with null or
repeated ids are each judged by their own text. Further columns are ignored, whatever their names. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.wordhash import frugal, text_chunks
from kinfold.plans.storage import small_arrow_batches

WINDOW, FILTERS, WIDTHS = 256, 8, (2, 3, 4)
DOCS, DOCS_PER_LANG, LEAST_DOCS, WINDOWS_PER_LANG = 64 * 600, 600, 20, 1800
EPOCHS, BATCH, RATE = 12, 128, 0.01
#: The pipeline rejects a document whose best language has less probability than this.
LEAST_SCORE = 0.4
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def responses(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Per width the filters' sums at all positions: (windows, positions, FILTERS)."""
    out = []
    for table in model.tables:
        w = len(table)
        n = x.shape[1] - w + 1
        r = table[0].take(x[:, :n], axis=0)
        for j in range(1, w):
            r += table[j].take(x[:, j : j + n], axis=0)
        out.append(r)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(model: Model, x: np.ndarray, step: int = 64) -> np.ndarray:
    out = [np.zeros((0, len(model.langs)), np.float32)]
    for a in range(0, len(x), step):
        h = np.concatenate([r.max(1) for r in responses(model, x[a : a + step])], 1) + model.bias
        out.append(softmax(np.maximum(h, 0) @ model.out + model.out_bias))
    return np.concatenate(out)


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of windows and its gradient; only a filter's strongest position passes one."""
    rs = responses(model, x)
    places = [r.argmax(1) for r in rs]
    h = np.concatenate([np.take_along_axis(r, p[:, None], 1)[:, 0] for r, p in zip(rs, places, strict=True)], 1) + model.bias
    a = np.maximum(h, 0)
    p = softmax(a @ model.out + model.out_bias)
    rows = np.arange(len(x))
    loss = float(-np.log(p[rows, y] + 1e-9).mean())
    d = p.copy()
    d[rows, y] -= 1
    d /= len(x)
    dh = (d @ model.out.T) * (h > 0)
    grads = []
    for n, (table, place) in enumerate(zip(model.tables, places, strict=True)):
        g, part = np.zeros_like(table), dh[:, n * FILTERS : (n + 1) * FILTERS]
        for j in range(len(table)):
            np.add.at(g[j], (x[rows[:, None], place + j], np.arange(FILTERS)[None]), part)
        grads.append(g)
    return loss, [*grads, dh.sum(0), a.T @ d, d.sum(0)]


def train(texts: list[bytes], labels: list[str], seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Fit on windows (one label each)."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    f = len(WIDTHS) * FILTERS
    model = Model(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    x = np.concatenate([windows(t)[:1] for t in texts])
    number = {v: i for i, v in enumerate(langs)}
    y = np.array([number[v] for v in labels])
    params = model.arrays()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            some, t = order[a : a + BATCH], t + 1
            _, grads = gradients(model, x[some], y[some])
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame) -> Model | None:
    """Train on labelled rows (``doc_id, text, lang``); the caller leaves out what is held out."""
    rows = docs.where("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = min(DOCS_PER_LANG, max(LEAST_DOCS, DOCS // len(counts)))
    # Twice the share is drawn by hash, so that almost surely enough are left to take the first of.
    shares = docs.sparkSession.createDataFrame([(lang, 2 * each / n) for lang, n in counts], "lang string, share double")
    part = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40)) / float(1 << 40) / F.col("share")
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("part", part).where("part < 1")
    chosen = drawn.orderBy("part", F.xxhash64("text")).limit(each * len(counts))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1)).cast("int") - 1))
    cut = chosen.select("lang", F.encode("text", "UTF-8").alias("raw"), at.alias("at")).select("lang", F.substring("raw", F.col("at") * WINDOW + 1, F.lit(WINDOW)).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("cut"), "cut"))
    sample = cut.withColumn("rank", rank).where(F.col("rank") <= max(WINDOWS_PER_LANG * each // DOCS_PER_LANG, LEAST_DOCS)).select("lang", "cut").collect()
    sample.sort(key=lambda r: (r[0], bytes(r[1])))
    return train([bytes(r[1]) for r in sample], [r[0] for r in sample])


def identify(model: Model | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    letters = [bool(_LETTER.search(t.decode())) for t in texts] if model else [False] * len(texts)
    known = [t for t, has in zip(texts, letters, strict=True) if has]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        parts = [windows(t) for t in known]
        n = np.array([len(p) for p in parts])
        p = probabilities(model, np.concatenate(parts))
        weight = np.full(len(p), float(WINDOW))
        weight[np.cumsum(n) - 1] = [len(t) - (k - 1) * WINDOW for t, k in zip(known, n.tolist(), strict=True)]
        mean = np.add.reduceat(p * weight[:, None], np.cumsum(n) - n, axis=0) / np.array([len(t) for t in known])[:, None]
        best = mean.argmax(1)
        for i, (at, b) in enumerate(zip(np.flatnonzero(letters).tolist(), best.tolist(), strict=True)):
            lang[at], score[at] = model.langs[b], min(1.0, float(mean[i, b]))
    return lang, score


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                lang, score = identify(model, texts)
                names = [c for c in part.column_names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return frugal(run)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns, ``lang_pred`` and ``score`` of every row's ``text``."""
    small_arrow_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(_predict(model), schema + ", lang_pred string, score double")


def _filter(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                lang, score = identify(model, texts)
                keep = [v != "und" and s >= LEAST_SCORE for v, s in zip(lang, score, strict=True)]
                yield from part.filter(pa.array(keep, pa.bool_())).to_batches()

    return frugal(run)


def drop_unidentified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` in a language that the model tells with ``LEAST_SCORE`` or more; all columns stay."""
    small_arrow_batches(docs.sparkSession)
    return docs.mapInArrow(_filter(model), docs.schema)
