"""Words of UTF-8 texts as 64-bit hashes, texts in slices of bounded size, and memory that workers give back.

Words are hashed one by one with XXH3 (64 bits), which mixes every byte: different words of a corpus share a hash by
chance only (probability about 2**-64 a pair), whatever their structure. Long texts are split slice by slice, so what
is held beside a text is 8 bytes a word and the words of one slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of text that are split into words at a time.
SLICE = 1 << 20


def _table(is_word: Callable[[int], bool]) -> bytes:
    """Translation that lower-cases A-Z and turns all bytes outside words into blanks."""
    lowered = [b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if is_word(b) else 0x20 for b in lowered)


#: Words between ASCII white space, and words of digits, letters and all bytes from 128.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
WORD_BYTES = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text whose separators are blanks in slices of about ``size`` bytes, cut between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end] if at or end < len(text) else text
        at = end


def text_words(text: bytes, words: bytes) -> np.ndarray:
    """Hashes of a text's words, in their order. ``words``: one of the translations above."""
    parts = []
    for piece in slices(text.translate(words)):
        some = piece.split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, some), U64, len(some)))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, U64), *parts])


def doc_words(texts: list[bytes], words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased), and the texts' borders in them (len + 1 values)."""
    each = [text_words(t, words) for t in texts]
    return np.concatenate([np.zeros(0, U64), *each]), np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)


def text_chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Slices of ``batch`` whose texts have about ``limit`` bytes, with these as UTF-8 (null: empty).

    A text longer than the limit is a slice of its own and stays whole.
    """
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    texts = table.column(column).combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        room = np.searchsorted(np.cumsum(sizes[at:]), limit, "right")
        n = max(1, int(room))
        part = table.slice(at, n)
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
        at += n


def give_back() -> None:
    """Return freed memory to the system: a reused worker keeps what its allocators hold otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function that gives memory back after each batch and when its partition ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        try:
            yield from run(told())
        finally:
            give_back()

    return wrapped
