"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs: a text's words (digits, letters and all bytes from 128, A-Z lower-cased; longer runs go on as further words
of ``CHARS`` bytes). A word's vector joins the end states of a bidirectional GRU over its bytes with hashed
embeddings of its first bytes and of the whole word. A second bidirectional GRU runs over windows of ``WORDS`` words
that overlap by a quarter; attention pools its states and a logistic layer scores the window. A text's score is that of
its highest window, over all windows of the whole text.

Training takes a bounded sample of labelled texts: of each class at most about ``DOCS_PER_CLASS`` (the first in the order
of a hash of their id). All windows of the whole texts are scored in every step and the label is held against the highest,
through which alone a gradient goes. Both classes come equally often in ``STEPS`` steps; a share of the words is shown
without its hashed embeddings, so that the network learns spellings; the result is the mean of the parameters over the
second half of the steps. Word vectors of frequent words are kept in a table of bounded size while a partition is scored.

Defined results: a null or wordless text gets the score of an empty window; without both labels to learn from every
score is 0. Rows with null or repeated ids are each scored by their own text, and equal texts get the same score but for
the last digits (float32 sums depend on the batch). Further columns are ignored, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordhash import SLICE, U64, WORD_BYTES, frugal, mix, slices, text_chunks
from kinfold.plans.storage import small_arrow_batches

CHARS, WORDS, STRIDE = 12, 32, 24
BUCKETS, EMBED, CHAR_EMBED, CHAR_HIDDEN, HIDDEN = 4096, 6, 8, 8, 8
DOCS_PER_CLASS = 1200
STEPS, BATCH, RATE = 500, 32, 0.01
TOXIC = 0.7
KNOWN = 200_000
#: Bucket of words whose hash the training hides (its row stays 0), so that the network has to spell them; how many it hides.
UNKNOWN, HIDDEN_WORDS = 0, 0.55
_FIRST, _SECOND = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)

Params = dict[str, np.ndarray]


def init(seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float = 0.0) -> np.ndarray:
        return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

    size = 2 * CHAR_HIDDEN + 2 * EMBED
    p = {"chars": normal(256, CHAR_EMBED, scale=0.3), "starts": normal(BUCKETS, EMBED, scale=0.1), "words": normal(BUCKETS, EMBED, scale=0.1)}
    p["words"][UNKNOWN] = p["starts"][UNKNOWN] = 0
    for d in "fb":
        p |= {f"cw{d}": normal(CHAR_EMBED, 3 * CHAR_HIDDEN), f"cu{d}": normal(CHAR_HIDDEN, 3 * CHAR_HIDDEN), f"cb{d}": np.zeros(3 * CHAR_HIDDEN, np.float32)}
        p |= {f"ww{d}": normal(size, 3 * HIDDEN), f"wu{d}": normal(HIDDEN, 3 * HIDDEN), f"wb{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.full(1, -1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """States (steps, batch, hidden) over projected inputs ``x`` (steps, batch, 3 hidden: update, reset, new); where
    the mask is 0 the state stays; no mask: it is 1 everywhere."""
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), x.dtype)
    out = np.empty((x.shape[0], x.shape[1], n), x.dtype)
    for t in range(x.shape[0] - 1, -1, -1) if back else range(x.shape[0]):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
        if mask is None:
            new -= h
            new *= 1 - z
            h = np.add(h, new, out=out[t])
            continue
        m = mask[t][:, None]
        if tape is not None:
            tape.append((t, h, z, r, new, hu[:, 2 * n :], m))
        h = h + m * (1 - z) * (new - h)
        out[t] = h
    return out


def gru_back(dout: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``gru``'s projected inputs and of ``u``."""
    n = u.shape[0]
    dx, du = np.zeros((*dout.shape[:2], 3 * n), dout.dtype), np.zeros_like(u)
    dh = np.zeros(dout.shape[1:], dout.dtype)
    for t, h, z, r, new, hn, m in reversed(tape):
        dh = dh + dout[t]
        dz = dh * m * (h - new) * z * (1 - z)
        dn = dh * m * (1 - z) * (1 - new * new)
        dr = dn * hn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = dh * (1 - m * (1 - z)) + dhu @ u.T
    return dx, du


def _whole(letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of words as rows of CHARS bytes (zeros behind their ends; no word holds one)."""
    wide = np.zeros((len(letters), 16), np.uint8)
    wide[:, :CHARS] = letters
    k = wide.view(U64)
    return mix(k[:, 0] * _FIRST + mix(k[:, 1] * _SECOND))


class Words:
    """Distinct words: their bytes (count, CHARS), byte masks and the two hash buckets."""

    def __init__(self, letters: np.ndarray, whole: np.ndarray) -> None:
        self.bytes, self.mask = letters, (letters > 0).astype(np.float32)
        self.start = (mix(np.ascontiguousarray(letters[:, :4]).view(np.uint32)[:, 0].astype(U64) * _FIRST) % U64(BUCKETS - 1)).astype(np.int64) + 1
        self.whole = (whole % U64(BUCKETS - 1)).astype(np.int64) + 1


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words (count, CHARS), their hashes, and the texts' borders in them."""
    buf = np.frombuffer(b" ".join(texts).translate(WORD_BYTES) + b" " * CHARS, np.uint8)
    edge = np.flatnonzero(np.diff(buf != 0x20, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    pieces = -(-(ends - starts) // CHARS)
    first = np.repeat(starts, pieces) + CHARS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(np.repeat(ends, pieces) - first, CHARS)
    letters = np.lib.stride_tricks.sliding_window_view(buf, CHARS)[first]
    letters[np.arange(CHARS) >= size[:, None]] = 0
    borders = np.cumsum([len(t) + 1 for t in texts])
    return letters, _whole(letters), np.concatenate([[0], np.searchsorted(first, borders)])


def word_vectors(p: Params, w: Words, tape: dict | None = None) -> np.ndarray:
    x = p["chars"][w.bytes.T]
    mask = w.mask.T
    ends = []
    for d in "fb":
        steps: list | None = [] if tape is not None else None
        h = gru(x @ p[f"cw{d}"] + p[f"cb{d}"], mask, p[f"cu{d}"], d == "b", steps)
        ends.append(h[-1] if d == "f" else h[0])
        if tape is not None:
            tape[d] = steps
    if tape is not None:
        tape["x"] = x
    return np.concatenate([*ends, p["starts"][w.start], p["words"][w.whole]], 1)


def window_words(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts with so many words: word numbers (windows, WORDS; -1: none) and each text's windows."""
    n = np.maximum(1, -(-(counts - WORDS + STRIDE) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    within = STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    at = within[:, None] + np.arange(WORDS)
    base = np.cumsum(counts) - counts
    return np.where(at < counts[text][:, None], at + base[text][:, None], -1), n


def window_logits(p: Params, projected: dict[str, np.ndarray], index: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logits of windows; ``projected`` has each direction's input rows, ``index`` (windows, WORDS) their numbers."""
    mask = (index.T >= 0).astype(np.float32)
    states, full = [], tape is None and bool(mask.all())
    for d in "fb":
        steps: list | None = [] if tape is not None else None
        states.append(gru(projected[d].take(index.T, axis=0, mode="wrap"), None if full else mask, p[f"wu{d}"], d == "b", steps))
        if tape is not None:
            tape[d] = steps
    h = np.concatenate(states, 2)
    e = np.where(mask > 0, h @ p["attend"], -1e9)
    a = np.exp(e - e.max(0)) * (mask > 0)
    a = a / np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", a, h)
    if tape is not None:
        tape |= {"h": h, "a": a, "pooled": pooled, "mask": mask}
    return pooled @ p["out"] + p["bias"][0]


def loss_and_gradients(p: Params, w: Words, numbers: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Cross entropy of texts (by their highest windows) and its gradients. ``numbers``: the texts' words, in ``w``."""
    ct: dict = {}
    vectors = word_vectors(p, w, ct)
    index, n = window_words(counts)
    index = np.where(index >= 0, numbers[np.maximum(index, 0)] if len(numbers) else 0, -1)
    projected = {d: vectors @ p[f"ww{d}"] + p[f"wb{d}"] for d in "fb"}
    wt: dict = {}
    logits = window_logits(p, projected, index, wt)
    firsts = np.cumsum(n) - n
    best = np.array([a + logits[a : a + k].argmax() for a, k in zip(firsts, n, strict=True)])
    q = sigmoid(logits[best])
    loss = float(-(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)).mean())
    dl = np.zeros_like(logits)
    dl[best] = (q - y) / len(y)
    g: Params = {"bias": dl.sum(keepdims=True), "out": wt["pooled"].T @ dl}
    dpool = dl[:, None] * p["out"]
    a, h = wt["a"], wt["h"]
    da = (h * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    g["attend"] = (h * de[:, :, None]).sum((0, 1))
    dh = a[:, :, None] * dpool + de[:, :, None] * p["attend"]
    dv = np.zeros_like(vectors)
    flat, used = index.T.ravel(), index.T.ravel() >= 0
    for k, d in enumerate("fb"):
        dx, g[f"wu{d}"] = gru_back(dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], p[f"wu{d}"], wt[d])
        rows = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        np.add.at(rows, flat[used], dx.reshape(-1, 3 * HIDDEN)[used])
        g[f"ww{d}"], g[f"wb{d}"] = vectors.T @ rows, rows.sum(0)
        dv += rows @ p[f"ww{d}"].T
    dchars = np.zeros_like(ct["x"])
    for k, d in enumerate("fb"):
        dout = np.zeros((CHARS, len(vectors), CHAR_HIDDEN), np.float32)
        dout[-1 if d == "f" else 0] = dv[:, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN]
        dx, g[f"cu{d}"] = gru_back(dout, p[f"cu{d}"], ct[d])
        g[f"cw{d}"] = np.tensordot(ct["x"], dx, ((0, 1), (0, 1)))
        g[f"cb{d}"] = dx.sum((0, 1))
        dchars += dx @ p[f"cw{d}"].T
    for name, rows, part in (("chars", w.bytes.T.ravel(), dchars.reshape(-1, CHAR_EMBED)), ("starts", w.start, dv[:, 2 * CHAR_HIDDEN : 2 * CHAR_HIDDEN + EMBED]), ("words", w.whole, dv[:, 2 * CHAR_HIDDEN + EMBED :])):
        g[name] = np.zeros_like(p[name])
        np.add.at(g[name], rows, part)
    return loss, g


def highest(p: Params, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words (as bytes) of each text's highest window side by side, and how many each has.

    All windows of the whole texts are scored; only the highest one of a text passes a gradient.
    """
    scorer, parts, counts = Scorer(p), [np.zeros((0, CHARS), np.uint8)], []
    for text in texts:
        logits, _, index = scorer.windows([text])
        letters, h, _ = cut_words([text])
        at = STRIDE * int(logits.argmax())
        parts.append(letters[at : at + WORDS])
        counts.append(len(parts[-1]))
    return np.concatenate(parts), np.array(counts)


def train(texts: list[bytes], labels: list[int], seed: int = 0, steps: int = STEPS) -> Params:
    rng, p = np.random.default_rng(seed), init(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    y, mean = np.array(labels, np.float32), {k: np.zeros_like(x) for k, x in p.items()}
    while t < steps:
        # Each round takes the rarer label as often as the other.
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == v)), max((y == 0).sum(), (y == 1).sum())) for v in (0, 1) if (y == v).any()]))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            words, counts = highest(p, [texts[i] for i in some])
            h = _whole(words)
            kinds, where, numbers = np.unique(h, return_index=True, return_inverse=True)
            w = Words(words[where], kinds)
            w.whole[rng.random(len(kinds)) < HIDDEN_WORDS] = UNKNOWN
            w.start[rng.random(len(kinds)) < HIDDEN_WORDS] = UNKNOWN
            _, g = loss_and_gradients(p, w, numbers, counts, y[some])
            g["words"][UNKNOWN] = g["starts"][UNKNOWN] = 0
            t += 1
            for k, x in p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                x -= RATE * max(0.1, 1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if 2 * t > steps:
                for k, x in p.items():
                    mean[k] += (x - mean[k]) / (t - steps // 2)
            if t == steps:
                return mean
    return mean


class Scorer:
    """A trained model with a table of known words' projected vectors."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, U64), np.zeros(0, np.int64)
        self.rows, self.size = {d: np.zeros((1 << 14, 3 * HIDDEN), np.float32) for d in "fb"}, 0

    def _append(self, d: str, at: int, rows: np.ndarray) -> None:
        while at + len(rows) > len(self.rows[d]):
            self.rows[d] = np.concatenate([self.rows[d], np.zeros_like(self.rows[d])])
        self.rows[d][at : at + len(rows)] = rows

    def _numbers(self, texts: list[bytes], step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as rows of the table, and the texts' borders in them; new words enter the table."""
        letters, h, borders = cut_words(texts)
        kinds, where, numbers = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, kinds), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == kinds if len(self.hashes) else np.zeros(len(kinds), bool)
        number = np.where(known, self.numbers[at], -1) if len(self.hashes) else np.full(len(kinds), -1)
        new = np.flatnonzero(~known)
        for a in range(0, len(new), step):
            some = new[a : a + step]
            vectors = word_vectors(self.p, Words(letters[where[some]], kinds[some]))
            number[some] = self.size + np.arange(len(some))
            for d in "fb":
                self._append(d, number[some[0]], vectors @ self.p[f"ww{d}"] + self.p[f"wb{d}"])
            self.size += len(some)
        if len(new):
            hashes, all_numbers = np.concatenate([self.hashes, kinds[new]]), np.concatenate([self.numbers, number[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.numbers = hashes[order], all_numbers[order]
        return number[numbers], borders

    def windows(self, texts: list[bytes], step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows, how many each text has, and the windows' rows of the table."""
        if len(self.hashes) > KNOWN:
            self._forget()
        if len(texts) == 1 and len(texts[0]) > SLICE:
            words = np.concatenate([self._numbers([x])[0] for x in slices(texts[0].translate(WORD_BYTES))])
            counts = np.array([len(words)])
        else:
            words, borders = self._numbers(texts)
            counts = np.diff(borders)
        index, n = window_words(counts)
        index = np.where(index >= 0, words[np.maximum(index, 0)] if len(words) else 0, -1)
        # Windows without gaps go first: they need no masks.
        order = np.argsort(index[:, -1] < 0, kind="stable")
        full = int((index[:, -1] >= 0).sum())
        cuts = [*range(0, full, step), *range(full, len(index), step), len(index)]
        logits = np.empty(len(index), np.float32)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            logits[order[a:b]] = window_logits(self.p, self.rows, index[order[a:b]])
        return logits, n, index

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits, n, _ = self.windows(texts)
        return sigmoid(np.maximum.reduceat(logits, np.cumsum(n) - n).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame) -> Params | None:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0 or 1); the caller leaves out what is held out.

    The sample is drawn from the labels, so that only its ids, a bounded number, meet the texts.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)")
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, DOCS_PER_CLASS / counts[1]).otherwise(DOCS_PER_CLASS / counts[0])
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40) / (2 * share)
    # Twice the share is drawn by hash, so that almost surely enough are left to take the first of.
    drawn = rows.select("doc_id", "toxic", part.alias("part")).where("part < 1").orderBy("part", "doc_id").limit(2 * DOCS_PER_CLASS)
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = chosen.orderBy("part", "doc_id", F.xxhash64("text")).limit(2 * DOCS_PER_CLASS).select("text", "toxic").collect()
    sample.sort(key=lambda r: (r[1], r[0]))
    return train([r[0].encode() for r in sample], [r[1] for r in sample]) if sample else None


def _score(p: Params | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p) if p else None
        for batch in batches:
            for part, texts in text_chunks(batch):
                score = scorer.scores(texts) if scorer else np.zeros(len(texts))
                names = [c for c in part.column_names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in names), pa.array(score, pa.float64()), pa.array((score >= TOXIC).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    return frugal(run)


def score(docs: DataFrame, p: Params | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns, ``score`` and ``predicted`` of every row's whole ``text``."""
    small_arrow_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(_score(p), schema + ", score double, predicted int")
