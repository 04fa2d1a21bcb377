"""Media columns: Matroska files as columns, parsed into packet tables.

``write_mkv`` stores samples of one byte as an uncompressed audio track in laced SimpleBlocks of clusters, with cues;
``parse_mkv`` walks any EBML bytes: variable-length ids and sizes (unknown sizes too), clusters, SimpleBlocks and
BlockGroups with all four lacings, and cues. Its packet table has a row a frame with track, timestamp, keyframe flag
and byte range, so payloads are cut out of the file by range. Both read and write bytes only; equal payloads give
equal files (no dates, no random ids).

Defined results: a null text is an empty one: its payload is one frame of filler. Texts of any length are stored
whole. Rows with null or repeated ids stand as they are; further columns are ignored, whatever their names. An empty
table gives an empty table. Bytes that are no whole file raise ``ValueError`` in ``parse_mkv``; in tables such a file has
one row with its ``error`` and nulls, and a null file none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm.wordhash import frugal, text_chunks
from kinfold.plans.storage import small_arrow_batches

FRAME = 576
RATE = 48_000
LACED, CLUSTER_FRAMES = 8, 512

# The element ids of the format that are used here.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE_ID, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, EBML}
#: Children of a segment: any of them ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


def vint(value: int, size: int = 0) -> bytes:
    """A variable-length size; the all-ones pattern of a length is kept for "unknown"."""
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def write_mkv(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A file whose frames are ``payload`` cut in ``frame`` bytes (a multiple of it), laced with a fixed size."""
    head = element(EBML, element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE_ID, struct.pack(">d", rate)), number(CHANNELS, 1), number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), element(CODEC, b"A_PCM/INT/LIT"), audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    total = len(payload) // frame
    for first in range(0, total, CLUSTER_FRAMES):
        base = first * frame * 1000 // rate
        parts = [number(TIMESTAMP, base)]
        for f in range(first, min(first + CLUSTER_FRAMES, total), LACED):
            n = min(LACED, first + CLUSTER_FRAMES - f, total - f)
            flags = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", f * frame * 1000 // rate - base) + flags, payload[f * frame : (f + n) * frame]))
        cluster = element(CLUSTER, *parts)
        cues.append(element(CUE_POINT, number(CUE_TIME, base), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *body, element(CUES, *cues))


@dataclass
class Media:
    """What a file holds: per frame (track, timestamp in ticks, keyframe, byte start, byte end); cues as (time, track,
    cluster's byte position in the segment); tracks as (number, type, codec); clusters' byte starts."""

    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: list[tuple[int, int, str]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    segment: int = 0


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """Value and next position; with ``keep`` the length marker stays in (ids). Unknown sizes are -1."""
    if at >= len(data):
        raise ValueError("the data end within an element")
    size = 9 - data[at].bit_length()
    if size > 8 or at + size > len(data):
        raise ValueError("no valid variable-length number")
    value = int.from_bytes(data[at : at + size], "big")
    if not keep:
        value ^= 1 << 7 * size
        if value == (1 << 7 * size) - 1:
            value = -1
    return value, at + size


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block's laced part, and where the frames start. Lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("the fixed lacing does not divide the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            begin = at
            size, at = read_vint(data, at)
            if i:
                # Later sizes are differences, shifted by half of what their length can hold.
                size += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("the lacing exceeds its block")
    return sizes, at


def _block(data: bytes, at: int, end: int, base: int, key: bool | None, out: Media) -> None:
    track, at = read_vint(data, at)
    (offset,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    for size in sizes:
        out.packets.append((track, base + offset, bool(flags & 0x80) if key is None else key, at, at + size))
        at += size


def parse_mkv(data: bytes) -> Media:
    try:
        return _parsed(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the data end within a block") from e


def _parsed(data: bytes) -> Media:
    out = Media()
    # Open masters: id, end (None: unknown), and the values gathered in them.
    stack: list[tuple[int, int | None, dict[int, object]]] = []

    def close(ident: int, got: dict[int, object]) -> None:
        if ident == TRACK_ENTRY:
            out.tracks.append((int(got.get(TRACK_NUMBER, 0)), int(got.get(TRACK_TYPE, 0)), bytes(got.get(CODEC, b"")).decode("ascii", "replace")))
        elif ident == CUE_POINT:
            out.cues += [(int(got.get(CUE_TIME, 0)), t, c) for t, c in got.get("places", [])]
        elif ident == CUE_POSITIONS and stack and stack[-1][0] == CUE_POINT:
            stack[-1][2].setdefault("places", []).append((int(got.get(CUE_TRACK, 0)), int(got.get(CUE_CLUSTER, 0))))
        elif ident == BLOCK_GROUP and BLOCK in got:
            cluster = next((s[2] for s in reversed(stack) if s[0] == CLUSTER), {})
            _block(data, *got[BLOCK], int(cluster.get(TIMESTAMP, 0)), 0xFB not in got, out)

    at = 0
    while at < len(data) or stack:
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            ident, _, got = stack.pop()
            close(ident, got)
        if at >= len(data):
            while stack:
                ident, end, got = stack.pop()
                if end is not None and end > len(data):
                    raise ValueError("the data end within an element")
                close(ident, got)
            break
        begin = at
        ident, at = read_vint(data, at, keep=True)
        size, at = read_vint(data, at)
        if ident in TOP:
            while stack and stack[-1][1] is None and stack[-1][0] != SEGMENT:
                inner, _, got = stack.pop()
                close(inner, got)
        if size >= 0 and at + size > len(data):
            raise ValueError("the data end within an element")
        if ident in MASTERS:
            if ident == SEGMENT:
                out.segment = at
            elif ident == CLUSTER:
                out.clusters.append(begin)
            stack.append((ident, at + size if size >= 0 else None, {}))
            continue
        if size < 0:
            raise ValueError("an element of unknown size that is no master")
        got = stack[-1][2] if stack else {}
        if ident == SIMPLE_BLOCK:
            _block(data, at, at + size, int(got.get(TIMESTAMP, 0)), None, out)
        elif ident == BLOCK:
            got[BLOCK] = (at, at + size)
        elif ident in (CODEC, DOC_TYPE):
            got[ident] = data[at : at + size]
        elif ident in (TIMESTAMP, TRACK_NUMBER, TRACK_TYPE, CUE_TIME, CUE_TRACK, CUE_CLUSTER, TIMESTAMP_SCALE, 0xFB):
            got[ident] = int.from_bytes(data[at : at + size], "big")
            if ident == TIMESTAMP_SCALE:
                out.scale = got[ident]
        at += size
    return out


PACKETS = "doc_id long, packet int, track int, timestamp_ns long, keyframe boolean, byte_start long, byte_end long, error string"


def _packet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            if not data.is_valid:
                continue
            try:
                media = parse_mkv(data.as_py())
                rows = [(doc_id, i, track, time * media.scale, key, a, b, None) for i, (track, time, key, a, b) in enumerate(media.packets)]
            except ValueError as e:
                rows = [(doc_id, None, None, None, None, None, None, str(e))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PACKETS.split(", ")])


def packets(media: DataFrame) -> DataFrame:
    """The packet table of ``doc_id, media`` (binary files; null: no packets)."""
    return media.select("doc_id", "media").mapInArrow(frugal(_packet_rows), PACKETS)


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    return raw + b"\xff" * (-len(raw) % frame or (0 if raw else frame))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_chunks(batch, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_mkv(pad(t)) for t in texts], pa.large_binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each row's text as the samples of a Matroska file."""
    small_arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(frugal(_store), "doc_id long, n_bytes long, media binary")


def feature(media: Media, payload: bytes) -> str:
    """Packets, clusters, cues, last timestamp, and the samples' mean and deviation from it."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) // len(x)
    spread = int(np.abs(x.astype(np.int16) - mean).sum(dtype=np.int64)) // len(x)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last={media.packets[-1][1]};mean={mean};spread={spread}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("media"):
            raw = data.as_py()
            try:
                media = parse_mkv(raw)
                payload = b"".join(raw[a:b] for *_, a, b in media.packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(media, payload), None))
            except (ValueError, TypeError) as e:
                rows.append((None, None, None, None if raw is None else len(raw), None, None, "no file" if raw is None else str(e)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])


def features(media: DataFrame) -> DataFrame:
    """What is read back of ``doc_id, n_bytes, media``: payload and file digests, and a feature string."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(frugal(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
