"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are split at the added tokens and then into pretokens, about ``PIECE`` characters at a time; a longer text is
cut between a word and the blank before the next, where a pretoken ends in any case. The distinct pretokens of a piece
that the worker does not know yet are laid out in one array of symbols. An index maps every adjacent pair to all its
positions there; the ranks of the pairs that occur are taken in ascending order from a heap, each merge is applied at
all listed positions from left to right, and the lists of the pairs that touch the merged symbols are updated. The ids
of the first pretokens are kept for later pieces by the pretokens' bytes, in a table of bounded size; once it is full,
others are encoded anew in each piece. (One index over a whole partition would grow with it; pieces give the same ids.)

Defined results: a null text is an empty text: no tokens. Texts of any length are encoded whole. Rows with null
or repeated ids are each encoded as they stand; further columns are ignored, whatever their names. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.wordhash import frugal, text_chunks
from kinfold.plans.storage import small_arrow_batches

#: The pattern of byte-level pretokenizers (a fixed value of the published vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens, and bytes of them, whose ids a worker keeps.
KNOWN, KNOWN_BYTES = 1 << 17, 4 << 20
#: Characters that are encoded at a time, and ids that are decoded at a time.
PIECE = 1 << 19
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in vocabulary files: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Merges:
    """The merge table as arrays: pair codes in ascending order with their ranks, and each rank's parts and result."""

    def __init__(self, table: list[tuple[int, int, int]]) -> None:
        self.left, self.right, self.made = np.array(table, np.int64).reshape(-1, 3).T
        codes = self.left << 32 | self.right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)


class PairIndex:
    """Symbols of many pretokens side by side, and the positions of every adjacent pair that has a rank."""

    def __init__(self, words: list[bytes], first: np.ndarray, merges: Merges) -> None:
        self.merges = merges
        self.symbol = first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbol)
        self.borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = np.diff(self.borders) > 0
        self.before[self.borders[:-1][full]] = -1
        self.after[self.borders[1:][full] - 1] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.note(np.flatnonzero(self.after >= 0))

    def note(self, at: np.ndarray) -> None:
        """Enter the pairs that start at ``at`` in the lists of their ranks; lists that are new become active."""
        ranks = self.merges.ranks(self.symbol[at], self.symbol[self.after[at]])
        known = ranks >= 0
        ranks, at = ranks[known], at[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if rank in self.places:
                self.places[rank].append(some)
            else:
                self.places[rank] = [some]
                heapq.heappush(self.active, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply all merges; all ids, and how many each pretoken has."""
        symbol, after, before, merges = self.symbol, self.after, self.before, self.merges
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.places.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = merges.left[rank], merges.right[rank]
            next_ = after[at]
            good = (symbol[at] == a) & (next_ >= 0) & (symbol[next_] == b)
            at, next_ = at[good], next_[good]
            if a == b and len(at) > 1:
                # In a run of equal symbols every other pair is taken, from the left.
                place = np.arange(len(at))
                begins = np.concatenate([[True], next_[:-1] != at[1:]])
                even = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
                at, next_ = at[even], next_[even]
            if not len(at):
                continue
            beyond = after[next_]
            symbol[at], symbol[next_] = merges.made[rank], -1
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            left = before[at]
            self.note(np.concatenate([left[left >= 0], at[more]]))
        kept = symbol >= 0
        total = np.concatenate([[0], np.cumsum(kept)])[self.borders]
        return symbol[kept].astype(np.uint32), np.diff(total)


@cache
def letter_classes() -> np.ndarray:
    """Of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    out = np.full(0x110000, 2, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for n, what in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(what, points):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = n
    out[0xD800:0xE000] = 2
    return out


def pretoken_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where ``PATTERN``'s matches start in the code points of texts laid side by side; ``begins``: the texts' starts.

    The pattern cuts runs of letters, numbers, other characters and white space. A run takes a blank before it
    along; of white space before a run the last character stands alone or goes with it. An apostrophe on its own
    and one of the listed endings after it are one match.
    """
    n = len(points)
    kind = letter_classes()[points]
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    start = np.zeros(n + 1, bool)
    start[runs] = True
    spaces = (kind[runs] == 3) & ~first[ends]
    last = ends[spaces] - 1
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    lone = np.flatnonzero((points[runs] == 0x27) & (ends - runs == 1) & ~first[ends] & start[runs])
    lone = lone[kind[ends[lone]] == 0]
    if len(lone):
        at, stop = runs[lone], ends[lone + 1]
        one = points[at + 1]
        two = np.where(at + 2 < stop, points[np.minimum(at + 2, n - 1)], 0)
        size = np.isin(one, [ord(c) for c in "stmd"]) * 1
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
        start[at + 1] = False
        cut = at + 1 + size
        start[cut[cut < stop]] = True
    return np.flatnonzero(start[:n])


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        #: Bytes of all tokens side by side, with each one's start and size by id.
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def _encode(self, text: str, borders: np.ndarray, known: "Known") -> list[np.ndarray]:
        """Ids of texts without added tokens that stand side by side in ``text``."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(points, borders[:-1][np.diff(borders) > 0])
        raw = text.encode()
        size = (1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)).cumsum(dtype=np.int64)
        at = np.append(np.concatenate([[0], size])[starts], len(raw)).tolist()
        begin, n, flat = known.places([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], self)
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = flat[np.repeat(begin - (end - n), n) + np.arange(total)]
        cuts = np.concatenate([[0], end])[np.searchsorted(starts, borders)]
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def _plain(self, texts: list[str], known: "Known") -> Iterator[np.ndarray]:
        """Ids of texts without added tokens, short ones together and long ones in pieces."""
        group: list[str] = []
        for text in [*texts, None]:
            if group and (text is None or sum(map(len, group)) + len(text) > PIECE):
                yield from self._encode("".join(group), np.concatenate([[0], np.cumsum([len(t) for t in group])]), known)
                group = []
            if text is None:
                return
            if len(text) <= PIECE:
                group.append(text)
                continue
            parts, at = [], 0
            while at < len(text):
                cut = _CUT.search(text, at + PIECE)
                end = cut.start() if cut else len(text)
                parts += self._encode(text[at:end], np.array([0, end - at]), known)
                at = end
            yield np.concatenate(parts)

    def encode_batch(self, texts: list[str], known: "Known | None" = None) -> list[np.ndarray]:
        """Ids of each text, added tokens included, without special tokens around it."""
        parts = [self.split_added(t) if self.split_added and any(a in t for a in self.added) else [t] for t in texts]
        ids = self._plain([p for some in parts for p in some[::2]], Known() if known is None else known)
        return [next(ids) if len(some) == 1 else np.concatenate([np.array([self.added[p]], np.uint32) if n % 2 else next(ids) for n, p in enumerate(some)]) for some in parts]

    def _bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of tokens, and how many each has."""
        ids = ids.astype(np.int64)
        n = self.token_size[ids]
        end = np.cumsum(n)
        return self.token_bytes[np.repeat(self.token_start[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)].tobytes(), n

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids, added tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return [b"".join(self._bytes(x[a : a + PIECE])[0] for a in range(0, len(x), PIECE)).decode("utf-8", "replace") for x in ids]


class Known:
    """Ids of pretokens by their bytes."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        #: All ids side by side, and where each pretoken's begin and how many it has.
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: list[bytes], bpe: Bpe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each pretoken's ids begin, how many they are, and all ids; new pretokens pass through a pair index."""
        known, flat, begin, size = self.number, self.flat, self.begin, self.size
        new = list(dict.fromkeys(w for w in words if w not in known))
        if new:
            ids, sizes = PairIndex(new, bpe.first, bpe.merges).run()
            begin = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes])
            flat, size = np.concatenate([flat, ids]), np.concatenate([size, sizes])
            numbers = dict(zip(new, range(len(self.size), len(size)), strict=True))
            total = self.bytes + sum(map(len, new))
            if len(size) <= KNOWN and total <= KNOWN_BYTES:
                known.update(numbers)
                self.flat, self.begin, self.size, self.bytes = flat, begin, size, total
            else:
                number = np.fromiter((known[w] if w in known else numbers[w] for w in words), np.int64, len(words))
                return begin[number], size[number], flat
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return begin[number], size[number], flat


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


@cache
def _known(path: str) -> Known:
    return Known()


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load(path), _known(path)
        for batch in batches:
            for part, raw in text_chunks(batch, limit=PIECE):
                ids = bpe.encode_batch([t.decode() for t in raw], known)
                names = [c for c in part.column_names if c != "text"]
                cols = [
                    *(part.column(c).combine_chunks() for c in names),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([_hex(x.astype("<u4").tobytes()) for x in ids], pa.string()),
                    pa.array([_hex(x.encode()) for x in bpe.decode_batch(ids)], pa.string()),
                ]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return frugal(run)


def encode(docs: DataFrame, tokenizer: str, ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns and ``n_tokens, ids_sha256, decoded_sha256`` of every row's ``text``; with ``ids``, the
    token ids themselves. ``tokenizer`` is the path of a vocabulary file that every executor has."""
    small_arrow_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(_encode(tokenizer, ids), schema + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            text = [None if x is None else t for x, t in zip(ids, bpe.decode_batch([np.array(x or [], np.int64) for x in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return frugal(run)


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` (null ids: null text)."""
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(tokenizer), "doc_id long, text string")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load(path), _known(path)
        for batch in batches:
            for part, raw in text_chunks(batch, limit=PIECE):
                n = [len(x) for x in bpe.encode_batch([t.decode() for t in raw], known)]
                names = [c for c in part.column_names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return frugal(run)


def count(docs: DataFrame, tokenizer: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``'s columns and the exact token count ``n_tokens`` of every row's ``text``."""
    small_arrow_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(_count(tokenizer), schema + ", n_tokens long")
