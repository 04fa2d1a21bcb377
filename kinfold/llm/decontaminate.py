"""Benchmark decontamination with a distributed positional inverted index.

Build: each task takes documents in blocks of about ``BLOCK_BYTES`` of text and stores one index segment a block:
a sorted term dictionary (64-bit word hashes), posting counts, and the delta-coded positions of every term of the
training text. Segments hold whole documents, so no query ever needs two of them, and no term's list is
gathered in one place: a word that a third of all documents use is spread over all segments.

Search: the benchmark's windows are looked up in every segment. A window takes its terms from the one that is
rarest in the segment to the most frequent one; the rarest term's positions minus its offset are the candidates,
and each further list, shifted by its own offset, is intersected with them. What is left is an exact phrase match.
``proximity_matches`` instead asks that every term occur near the rarest one, in any order.

The benchmark is measured first. Its windows go to the tasks in parts of about ``PART_CHARS`` characters, one
pass over the index a part, so what the driver holds and what is broadcast (some 12 bytes a character) is bounded
whatever the benchmark's size. Words are known by 64-bit hashes; a hit needs as many equal ones as the window has words.

Defined results: a null or empty text, or one without words, has no words, hits or items; a null or wordless
benchmark item has no windows; an item shorter than the window is one window as a whole. Rows that repeat a
doc_id are each judged by their own text; rows that repeat an item_id are one item. A null doc_id is carried
through; an item with a null item_id is left out. Other columns are ignored. An empty table gives an empty table,
an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordhash import U64, WORD_BYTES, doc_words, frugal, text_chunks
from kinfold.plans.storage import materialize, release, small_arrow_batches

WINDOW, CONTAMINATED = 8, 2
BLOCK_BYTES = 1 << 20
PART_CHARS = 2 << 20
#: Candidates of one intersection step held at once, at about 100 bytes each; a step may end within a window's.
STEP = 1 << 17

SEGMENT = "doc_ids array<bigint>, keys array<string>, borders binary, terms binary, counts binary, deltas binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_chunks(batch, limit=BLOCK_BYTES):
            h, at = doc_words(texts, WORD_BYTES)
            order = np.argsort(h, kind="stable")
            terms, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            deltas = np.diff(order, prepend=0)
            deltas[first] = order[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column("text_md5").to_pylist()], pa.list_(pa.string())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int64), terms, counts.astype(np.uint32), deltas.astype(np.uint32))),
                ],
                ["doc_ids", "keys", "borders", "terms", "counts", "deltas"],
            )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): one row a segment, written in the shared folder."""
    small_arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return materialize(source.mapInArrow(frugal(_segments), SEGMENT), "postings")


class Segment:
    """One decoded index segment."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.keys = row["doc_ids"], row["keys"]
        self.borders = np.frombuffer(row["borders"], np.int64)
        self.terms = np.frombuffer(row["terms"], U64)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        deltas = np.frombuffer(row["deltas"], np.uint32).astype(np.int64)
        # A list restarts at its first posting: take the running sum before it away.
        total = np.cumsum(deltas)
        base = np.concatenate([[0], total])[self.starts[:-1]]
        self.positions = total - np.repeat(base, self.counts)
        #: (term number, position), ascending: one sorted array in which any posting is found by bisection.
        self.postings = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The segment's numbers of terms; -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term << 32 | np.maximum(position, 0)
        at = np.minimum(np.searchsorted(self.postings, want), len(self.postings) - 1)
        return (self.postings[at] == want) & (position >= 0)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, position, "right") - 1

    def _anchored(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows whose terms all occur, with terms and offsets rarest first; in steps, of each candidate the place of
        its window among these and its anchor position."""
        number = self.numbers(windows)
        rows = np.flatnonzero((number >= 0).all(1))
        if not len(rows):
            return
        number = number[rows]
        offset = np.argsort(self.counts[number], axis=1, kind="stable")
        number = np.take_along_axis(number, offset, 1)
        ends = np.cumsum(self.counts[number[:, 0]])
        # The candidates of a window are numbered up to its end; this leads from there to its rarest term's list.
        shift = self.starts[number[:, 0] + 1] - ends
        for low in range(0, int(ends[-1]), STEP):
            candidate = np.arange(low, min(low + STEP, int(ends[-1])))
            which = np.searchsorted(ends, candidate, "right")
            yield rows, number, offset, which, self.positions[candidate + shift[which]]

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every exact occurrence of the windows (all of one length)."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, number, offset, which, anchor in self._anchored(windows):
            start = anchor - offset[which, 0]
            for j in range(1, windows.shape[1]):
                left = self.holds(number[which, j], start + offset[which, j])
                which, start = which[left], start[left]
            left = (start >= 0) & (self.doc_of(start) == self.doc_of(start + windows.shape[1] - 1))
            found.append((rows[which[left]], start[left]))
        which, start = (np.concatenate(x) for x in zip(*found, strict=True))
        return which, start

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every term occurs within length + ``slop`` - 1 words of it."""
        found, reach = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], windows.shape[1] - 1 + slop
        for rows, number, _, which, anchor in self._anchored(windows):
            for j in range(1, windows.shape[1]):
                doc = self.doc_of(anchor)
                low = np.maximum(anchor - reach, self.borders[doc])
                high = np.minimum(anchor + reach + 1, self.borders[doc + 1])
                term = number[which, j] << 32
                left = np.searchsorted(self.postings, term | low) < np.searchsorted(self.postings, term | high)
                which, anchor = which[left], anchor[left]
            found.append((rows[which], anchor))
        which, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        return which, anchor


class Windows:
    """The distinct windows of benchmark items, grouped by length, with the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.items = sorted({str(i) for i, _ in items})
        number = {x: n for n, x in enumerate(self.items)}
        h, at = doc_words([(t or "").encode() for _, t in items], WORD_BYTES)
        sizes = np.minimum(window, np.diff(at))
        owner = np.array([number[str(i)] for i, _ in items], np.int64)
        #: By length: the distinct windows, and of each the items that have it, side by side with their borders.
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            n = at[mine + 1] - at[mine] - size + 1
            start = np.repeat(at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            every = h[start[:, None] + np.arange(size)]
            windows, which = np.unique(every, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(owner[mine], n)], 1), axis=0)
            self.groups.append((windows, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))))


def _part_count(benchmark: DataFrame) -> int:
    chars = benchmark.where("item_id is not null").agg(F.sum(F.length("text") + 16)).head()[0] or 0
    return -(-chars // PART_CHARS) or 1


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items in parts of about ``PART_CHARS`` characters."""
    items, n = benchmark.where("item_id is not null").select("item_id", "text"), _part_count(benchmark)
    for part in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).collect()]


def _matches(items: Windows, slop: int | None):
    """Per segment and document of it: hit intervals (flat start, end pairs of word numbers) and item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                n = len(seg.doc_ids)
                spans: list[list[int]] = [[] for _ in range(n)]
                named: list[set[int]] = [set() for _ in range(n)]
                for windows, owners, borders in items.groups:
                    which, start = seg.phrases(windows) if slop is None else seg.near(windows, slop)
                    size = windows.shape[1] if slop is None else 1
                    for w, s, d in zip(which.tolist(), start.tolist(), seg.doc_of(start).tolist(), strict=True):
                        s -= int(seg.borders[d])
                        spans[d] += [s, s + size]
                        named[d].update(owners[borders[w] : borders[w + 1]].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.doc_ids, pa.int64()),
                        pa.array(seg.keys, pa.string()),
                        pa.array([row["segment"]] * n, pa.string()),
                        pa.array(range(n), pa.int64()),
                        pa.array(np.diff(seg.borders), pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())),
                        pa.array([[items.items[i] for i in sorted(x)] for x in named], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_md5", "segment", "place", "n_words", "spans", "items"],
                )

    return frugal(run)


MATCH = "doc_id long, text_md5 string, segment string, place long, n_words long, spans array<bigint>, items array<string>"


def _named(index: DataFrame) -> DataFrame:
    """Segments with a name that is the same in every pass."""
    return index.withColumn("segment", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string")))


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``doc_id, text_md5, n_words, spans, items`` for every indexed document: the word intervals that match and
    the items (as strings, distinct). Exact phrases where ``slop`` is None, else proximity matches."""
    named = _named(index)
    passes = [named.mapInArrow(_matches(Windows(part, window), slop), MATCH) for part in _parts(benchmark)]
    if len(passes) > 1:
        rows = passes[0]
        for more in passes[1:]:
            rows = rows.unionByName(more)
        # A document has one row a pass: its group is as large as the number of passes.
        return rows.groupBy("segment", "place").agg(
            *(F.first(c).alias(c) for c in ("doc_id", "text_md5", "n_words")), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        ).select("doc_id", "text_md5", "n_words", "spans", "items")
    return passes[0].select("doc_id", "text_md5", "n_words", "spans", "items")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return matches(build_index(docs), benchmark, window)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 4) -> DataFrame:
    return matches(build_index(docs), benchmark, window, slop)


def covered(spans: list[int]) -> int:
    """Words inside any of the intervals."""
    total = end = 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [sorted(x) for x in batch.column("items").to_pylist()]
        hits = [covered(x) for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "text_md5", "n_words")),
                pa.array(hits, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([len(x) >= CONTAMINATED for x in items], pa.bool_()),
            ],
            ["doc_id", "text_md5", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


VERDICT = "doc_id long, text_md5 string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdicts(index: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Verdicts on all indexed documents; with one pass over the index, one worker a task finds and digests the matches."""
    if _part_count(benchmark) > 1:
        return matches(index, benchmark, window).mapInArrow(frugal(_digest), VERDICT)
    find = _matches(Windows(next(_parts(benchmark)), window), None)
    return _named(index).mapInArrow(frugal(lambda batches: _digest(find(batches))), VERDICT)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_md5, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    return _verdicts(build_index(docs), benchmark, window)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated. A verdict depends on the text alone and is joined by its
    digest, so rows with null or repeated ids get their own; all columns stay, whatever their names."""
    index = build_index(docs)
    bad = materialize(_verdicts(index, benchmark, window).where("contaminated").select("text_md5").distinct(), "contaminated")
    release(index)
    digest = next(c for i in range(len(docs.columns) + 1) if (c := f"text_md5_{i}") not in docs.columns)
    return docs.join(bad.select(F.col("text_md5").alias(digest)), F.md5(F.coalesce("text", F.lit(""))) == F.col(digest), "left_anti")


def oracle_sql(window: int = WINDOW) -> str:
    """``contamination``'s rows in DuckDB SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS text_md5, {words} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    s AS (SELECT item, w, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
    dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hit AS (SELECT r, i, n, item FROM dw JOIN win USING (n, key)),
    c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
    g AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
    SELECT doc_id, text_md5, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {CONTAMINATED} AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)"""
