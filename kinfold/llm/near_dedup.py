"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct ``shingle``-word shingles and a MinHash signature. Texts with equal
   sets form a *class*; only one row a class goes on, so exact copies are never paired.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
3. Candidates of a bucket are compared in signature batches. After each batch a pair is pruned as soon as the
   posterior probability that its similarity reaches the threshold (uniform prior, Beta posterior) falls below
   ``miss``. Survivors are verified exactly on their full sets.
4. Linked classes are joined into components.

No bucket is paired with itself in full. The first round compares members only with the bucket's most central
class. The second looks only at buckets that still hold several components: a member outside the most frequent
one is compared with members of other components, and with no component again once it is linked to it, until every
surviving pair is linked, verified or already connected. Only links leave the tasks. Large buckets are dealt in
blocks, by members and by bytes, and pairs of blocks are the tasks' units. A bucket or a class may hold a third of all
rows: what is joined by it are stored tables on both sides, so that each join stands on two plain exchanges, which
Spark's adaptive skew join splits; texts without words, which have no class, are not joined at all.

Words are known by 64-bit hashes and shingles by 64-bit hashes of these: two shingles are taken for one with a chance of
about 2**-64 a pair. Classes are told by 128-bit digests of whole sets.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a text
with fewer words than ``shingle`` has its whole word sequence as one shingle. Rows that repeat a doc_id are
each judged by their own text. A null doc_id takes no part in linking: its component is null and it is kept.
Of rows of one class the one with the smallest doc_id is kept. Other input columns are ignored, whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordhash import NOT_SPACE, U64, doc_words, frugal, mix, text_chunks
from kinfold.operators.graph import connected_components
from kinfold.plans.storage import materialize, release, small_arrow_batches

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BANDED, BATCH = 240, 120, 40
MISS = BAND_MISS = 1e-4
BLOCK, BLOCK_BYTES = 1024, 32 << 20

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_PART = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_NONE = U64(0x5851F42D4C957F2D)


def band_rows(threshold: float) -> int:
    """Most rows a band can have while a pair at the threshold shares no band with probability below ``BAND_MISS``."""
    return max(r for r in range(1, 13) if BANDED % r == 0 and (r == 1 or (1 - threshold**r) ** (BANDED // r) <= BAND_MISS))


@cache
def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """For batch 1, 2, ...: a pair with fewer matches so far is pruned.

    With m of n hashes equal the posterior is Beta(m+1, n-m+1), and P(similarity >= t) is the probability
    that a binomial of n+1 trials at t has at most m successes.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    h, at = doc_words(texts, NOT_SPACE)
    n = len(h)
    m = max(n - k + 1, 0)
    whole = np.zeros(m, U64)
    for j in range(k):
        whole += h[j : j + m] * _PART[j] if m else h[:0]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            few = np.full(k, _NONE, U64)
            few[: b - a] = h[a:b]
            out.append(mix((few * _PART[:k]).sum(keepdims=True, dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) minima, 16 middle bits of each; rows of empty sets are 0."""
    sig = np.zeros((len(sets), HASHES), np.uint16)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    if len(full):
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        y = np.empty_like(x)
        for j in range(HASHES):
            np.bitwise_xor(x, _XOR[j], out=y)
            np.multiply(y, _MUL[j], out=y)
            sig[full, j] = np.minimum.reduceat(y, starts) >> U64(32) & U64(0xFFFF)
    return sig


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                sets = shingle_sets(texts, k)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").combine_chunks(),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([row.tobytes() if len(s) else None for s, row in zip(sets, sig, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "class", "sig"],
                )

    return frugal(run)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the paired signatures that no batch prunes, and their matches over all hashes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, m in enumerate(least):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        got = (a[alive, cut] == b[alive if len(b) == len(a) else slice(None), cut]).sum(1)
        matches[alive] += got.astype(np.int32)
        alive = alive[matches[alive] >= m]
    return alive, matches[alive]


def _prune(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, _ = surviving(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), least)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return frugal(run)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sorted sets' Jaccard similarity is ``percent`` or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def cross_links(sig: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, band: int, rows: int, least: list[int], percent: int) -> list[tuple[int, int]]:
    """Verified links between components within a block, or between its two sides; enough of them to connect all
    that are linked.

    A pair that agrees on an earlier band than ``band`` is left to that band's bucket.
    """
    names, label, counts = np.unique(label, return_inverse=True, return_counts=True)
    earlier = sig[:, : band * rows].reshape(len(sig), band, rows)
    two = side.any() and not side.all()
    home = np.arange(len(names))
    out = []
    for i in np.flatnonzero(label != counts.argmax()) if len(names) > 1 else ():
        apart = home[label] != home[label[i]]
        alive = np.flatnonzero(apart & (side != side[i]) if two else apart)
        got = np.zeros(len(alive), np.int32)
        for n, m in enumerate(least):
            cut = slice(n * BATCH, (n + 1) * BATCH)
            got += (sig[alive, cut] == sig[i, cut]).sum(1).astype(np.int32)
            alive, got = alive[got >= m], got[got >= m]
        own = ~(earlier[alive] == earlier[i]).all(2).any(1)
        for j in alive[own][np.argsort(-got[own], kind="stable")].tolist():
            if home[label[i]] != home[label[j]] and similar(sets[i], sets[j], percent):
                home[home == home[label[j]]] = home[label[i]]
                out.append((int(i), j))
    return out


def _cross(least: list[int], rows: int, percent: int):
    """``cross_links`` of each run of rows with one (bucket, x, y); a run has at most two blocks of members."""
    keys = ["bucket", "x", "y"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(x, U64) for x in t.column("words").to_pylist()]
        ids = t.column("id").to_numpy()
        pairs = cross_links(_matrix(t.column("sig")), sets, t.column("component").to_numpy(), t.column("side").to_numpy(), t.column("band")[0].as_py(), rows, least, percent)
        ends = [sorted((ids[i], ids[j])) for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            k = [t.column(c).to_numpy() for c in keys]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1
            cuts = [0, *new.tolist(), len(t)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[-1].column(c)[-1].as_py() != t.column(c)[a].as_py() for c in keys):
                    yield solve(pa.concat_tables(held))
                    held = []
                held.append(t.slice(a, b - a))
        if held:
            yield solve(pa.concat_tables(held))

    return frugal(run)


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                sets = [s.tobytes() for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.large_binary())], ["doc_id", "class", "words"])

    return frugal(run)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return frugal(run)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id long, text string)."""
    least, rows, percent = least_matches(threshold), band_rows(threshold), round(100 * threshold)
    small_arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(source.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, class binary, sig binary"), "sketches")
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    # Only the smallest doc_id of a class goes on; each task sends one row a class.
    one = usable.groupBy("class", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    reps = materialize(one.select(F.col("first.doc_id").alias("id"), "class", "n_shingles", F.col("first.sig").alias("sig")), "classes")
    classes = reps.select("class", "id")
    width = 2 * rows
    bands = materialize(
        reps.select("id", F.posexplode(F.array(*[F.substring("sig", 1 + width * i, width) for i in range(BANDED // rows)]))).select("id", F.col("pos").alias("band"), F.xxhash64("pos", "col").alias("bucket")),
        "bands",
    )
    sizes = materialize(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = materialize(bands.join(sizes, "bucket").select("bucket", "band", "id", "n"), "buckets")
    central = shared.groupBy("id").agg(F.sum(F.log2("n")).alias("c"))
    pivots = materialize(shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("pivot")), "pivots")
    star = shared.join(pivots, "bucket").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    sig = reps.select("id", "sig")
    scored = star.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    candidates = materialize(scored.mapInArrow(_prune(least), "a long, b long"), "candidates")
    release(bands, sizes, pivots)

    def sets_of(ids: DataFrame) -> DataFrame:
        """``id, words`` of classes: their texts are read again, but only theirs."""
        ends = ids.join(reps.select("id", "class"), "id").select(F.col("id").alias("doc_id"), F.col("class").alias("own"))
        texts = source.join(ends.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets_of(shingle), "doc_id long, class binary, words binary")
        return materialize(texts.join(ends, "doc_id").where("class = own").groupBy(F.col("doc_id").alias("id")).agg(F.first("words").alias("words")), "sets")

    sets = sets_of(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct())
    both = candidates.join(sets.select(F.col("id").alias("a"), F.col("words").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("set_b")), "b")
    links = materialize(both.mapInArrow(_verify(percent), "a long, b long"), "links")
    release(candidates, sets)
    found = connected_components(links, "a", "b")
    placed = materialize(shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(reps.select("id", "n_shingles"), "id"), "placed")
    # A bucket of two had its only pair tried in the first round.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), blocks.alias("blocks")).where("lo < hi and m > 2")
    open_buckets = materialize(several.select("bucket", "blocks"), "open-buckets")
    member = materialize(placed.join(open_buckets, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("bucket", "band", "id", "component", "blocks", "block"), "open")
    if not member.isEmpty():
        dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "bucket", "band", "id", "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side")
        )
        ids = member.select("id").distinct()
        sets = sets_of(ids)
        runs = dealt.join(sets.join(reps.select("id", "sig"), "id"), "id").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        more = materialize(runs.mapInArrow(_cross(least, rows, percent), "a long, b long"), "cross-links")
        release(sets)
        if not more.isEmpty():
            found = connected_components(links.unionByName(more), "a", "b")
    label = materialize(classes.join(found, "id", "left").select("class", F.coalesce("component", "id").alias("component_id")), "labels")
    release(reps, shared, links, placed, open_buckets, member)
    worded = F.col("class").isNotNull() & F.col("doc_id").isNotNull()
    joined = sketch.where(worded).select("doc_id", "n_shingles", "class").join(label, "class").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where(~worded).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component (and of each repeated row); all columns stay."""
    kept = near_duplicates(docs, shingle, threshold).where("kept and doc_id is not null").select("doc_id").distinct()
    digest = next(c for i in range(len(docs.columns) + 1) if (c := f"text_md5_{i}") not in docs.columns)
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(digest, F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", digest])
    return one.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def oracle_sql(shingle: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    """``near_duplicates``' rows in DuckDB SQL, by brute force over shared shingles; for tables without null or repeated ids."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, least({shingle}, len(w)) AS k, unnest(range(1, len(w) - least({shingle}, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {round(100 * threshold)} * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""
