"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member a record into archives below a shared folder, a response for the page with
the largest page_id of an equal payload and revisits for the others (payloads below ``LEAST`` bytes are all
responses). Pages are written where they are read: only digests and ids are shuffled.

``build_index`` sorts the captures by reversed-host URL key over range partitions. Each shard is one file of
compressed blocks of captures and, behind them, a sparse directory with a block's first key, offset and length. The
top level holds a row a shard with its first key, so it is as large as the number of shards. ``lookup`` routes keys to shards by
bisection, bisects a shard's directory, reads one block by range, bisects it, and gives archive ranges;
``read_captures`` then reads just those ranges.

Files go through Hadoop-independent ``pyarrow`` file systems, so the shared folder may be a local mount, HDFS or an
object store. Every task writes under a name of its own attempt, and only names in the returned tables count.

Defined results: null html is an empty payload; a null URL has the empty key; a null page_id is below all others.
Rows that repeat the page_id of an equal payload's response are responses too and share its record id. Further columns
are ignored, whatever their names. An empty table gives no archives, an empty index and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordhash import frugal
from kinfold.plans.storage import materialize, new_path, small_arrow_batches

LEAST = 1000
BLOCK_LINES = 512
#: Bytes of ranges between two wanted ones that are read rather than skipped.
GAP = 1 << 16


def url_key(url: Column) -> Column:
    """Reversed host, then path and query, lower-cased: ``https://a.B.org:80/x?y#z`` is ``org,b,a)/x?y``."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^[^@]*@|:[0-9]*$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    host = F.regexp_replace(host, r"^www\.", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(bare == "", "").otherwise(key)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _response_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str | None = None) -> bytes:
    """One record as a gzip member, with an HTTP response as its block; a revisit's has no payload.

    A record's id comes from its ``place`` in the archives, that of a response that others refer to (no place) from its
    page and payload, so that they can name it.
    """
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record {place}')}>" if place else _response_id(page_id, digest)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": own,
        "WARC-Target-URI": json.dumps(url or "")[1:-1],
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Refers-To": _response_id(refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (what follows the HTTP head) of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


CAPTURE = "key string, page_id long, url string, digest string, file string, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], r["revisit"], None if r["referred"] else f"{name} {at}")
                out.write(member)
                rows.append((at, len(member)))
                at += len(member)
            if out is not None:
                out.flush()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "page_id", "url", "digest")), pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                ["key", "page_id", "url", "digest", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return frugal(run)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the archives below ``folder``; the table of captures (``key, page_id, url, digest, file, offset, length``)."""
    small_arrow_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_key(F.col("url")).alias("key"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    big = keyed.where(F.col("bytes") >= least)
    repeated = materialize(big.groupBy("digest", "bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "response"), "repeated")
    # One payload may be a third of all pages: a join of two plain exchanges, which the adaptive skew join splits.
    ruled = keyed.join(repeated, ["digest", "bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = ruled.select("key", "page_id", "url", "html", "digest", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"), (F.col("response").isNotNull() & ~revisit).alias("referred"))
    return materialize(rows.mapInArrow(_write(folder), CAPTURE), "captures")


SHARD = "shard string, first_key string, directory_at long, directory_length long, captures long"


def _write_shard(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at, total = None, f"{uuid.uuid4().hex}.cdx", 0, 0
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []
        first = ""

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append((json.loads(lines[0])[0], at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), r["key"]
                lines.append(json.dumps([r["key"], r["page_id"], r["url"], r["digest"], r["file"], r["offset"], r["length"]]))
                total += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first, at, len(packed), total)], ["shard", "first_key", "directory_at", "directory_length", "captures"])

    return frugal(run)


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted shards below ``folder``; the top level, a row a shard.

    Range bounds hold the page_id too, so that one key with many captures can be split over shards.
    """
    order = ["key", "page_id", "file", "offset"]
    return materialize(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write_shard(folder), SHARD), "shards")


class Shard:
    """One shard file, opened by range reads."""

    def __init__(self, folder: str, row: dict) -> None:
        fs, base = _open(folder)
        self.file = fs.open_input_file(f"{base}/{row['shard']}")
        self.directory = json.loads(zlib.decompress(self.file.read_at(row["directory_length"], row["directory_at"])))
        self.keys = [d[0] for d in self.directory]
        self.held: tuple[int, list[list], list[str]] = (-1, [], [])

    def block(self, n: int) -> tuple[list[list], list[str]]:
        if self.held[0] != n:
            _, at, length = self.directory[n]
            rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]
            self.held = (n, rows, [r[0] for r in rows])
        return self.held[1], self.held[2]

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key here: bisect the directory, then blocks, until a larger key comes."""
        from bisect import bisect_left

        for n in range(max(0, bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[n] > key:
                return
            rows, keys = self.block(n)
            for i in range(bisect_left(keys, key), len(rows)):
                if keys[i] != key:
                    return
                yield rows[i]


def _lookup(folder: str, top: list[dict]):
    """Wanted keys, sorted within a shard's number, to captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = -1, None
        for batch in batches:
            found = []
            for n, key in zip(batch.column("shard_no").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if n != at:
                    at, shard = n, Shard(folder, top[n])
                found += shard.find(key)
            cols = list(zip(*found, strict=True)) if found else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in CAPTURE.split(", ")])

    return frugal(run)


def _route(firsts: list[str]):
    """Numbers of all shards that may hold a key: those from the last one that starts below it to the last that
    starts at it or below."""
    from bisect import bisect_left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(n, key) for key in batch.column("key").to_pylist() for n in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.string())], ["shard_no", "key"])

    return frugal(run)


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The captures of the distinct ``key``s of a table. The top level (a row a shard) goes to every task."""
    top = sorted((r.asDict() for r in index.collect()), key=lambda r: (r["first_key"], r["shard"]))
    routed = keys.where("key is not null").select("key").distinct().mapInArrow(_route([r["first_key"] for r in top]), "shard_no int, key string")
    return routed.repartition("shard_no", F.substring(F.md5("key"), 1, 1)).sortWithinPartitions("shard_no", "key").mapInArrow(_lookup(folder, top), CAPTURE)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, file = None, None
        for batch in batches:
            rows, captures, at = [], batch.to_pylist(), 0
            while at < len(captures):
                # Neighbours in a file are fetched by one range read.
                stop, begin, end = at + 1, captures[at]["offset"], captures[at]["offset"] + captures[at]["length"]
                while stop < len(captures) and captures[stop]["file"] == captures[at]["file"] and 0 <= captures[stop]["offset"] - end <= GAP and end - begin < 4 << 20:
                    end = captures[stop]["offset"] + captures[stop]["length"]
                    stop += 1
                if captures[at]["file"] != name:
                    if file is not None:
                        file.close()
                    name = captures[at]["file"]
                    file = fs.open_input_file(f"{base}/{name}")
                data = file.read_at(end - begin, begin)
                for c in captures[at:stop]:
                    head, body = parse_record(data[c["offset"] - begin : c["offset"] - begin + c["length"]])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {c['url']} does not match its digest")
                    page = int(head["X-Page-Id"]) if head["X-Page-Id"] else None
                    refers = int(head["X-Refers-To-Page"]) if kind == "revisit" else None
                    rows.append((page, int(head["X-Payload-Length"]), digest, kind, refers, body.decode() if with_payload and kind == "response" else None))
                at = stop
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

    return frugal(run)


def read_captures(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at the captures' ranges: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and,
    if asked for, responses' ``payload``."""
    dealt = captures.repartition("file", (F.col("offset") / (64 << 20)).cast("long")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder, payloads), READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html), index them, and read every page's record back through the index."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    index = build_index(captures, f"{folder}/index")
    wanted = pages.select(url_key(F.col("url")).alias("key"))
    return read_captures(lookup(wanted, index, f"{folder}/index"), f"{folder}/archives").drop("payload")


def oracle_sql() -> str:
    """``archive``'s rows in DuckDB SQL; what it cannot say is how they pass through the files."""
    revisit = "response IS NOT NULL AND page_id IS DISTINCT FROM response"
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    r AS (SELECT n, d, max(page_id) AS response FROM p WHERE n >= {LEAST} GROUP BY n, d HAVING count(*) > 1)
    SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN {revisit} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {revisit} THEN response END AS refers_to FROM p LEFT JOIN r USING (n, d)"""
