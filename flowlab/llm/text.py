"""Vectorised words, hashes and shingles over Arrow string columns.

Helpers for kernels that run inside ``mapInArrow`` tasks.  They work on the
UTF-8 bytes of a whole Arrow slice at once, so a task handles megabytes of
text with a handful of numpy calls.  Slices hold about ``SLICE_BYTES`` of
text (one row at least), which bounds a task's memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: What a kernel gathers before it writes rows, where it gathers over slices.
GROUP_BYTES = 1 << 22

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x + _GOLD
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of lower-cased words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1]


class Words:
    """The words of a slice of texts.

    ``data``: bytes; ``start``/``end``: byte range of each word; ``first``:
    index of each text's first word (one entry more than texts).
    """

    def __init__(self, texts: pa.Array, keep: np.ndarray, lower: bool = True):
        self.data, offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = keep[self.data]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Row number of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in every process."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        power, inverse = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * power, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * _M1))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if offsets and len(texts) else np.zeros(len(texts) + 1, dtype=np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[list[pa.RecordBatch]]:
    """Slices of a batch in groups of about GROUP_BYTES of text."""
    now, size = [], 0
    for part in slices(batch, column):
        now.append(part)
        size += part.column(column).nbytes
        if size >= GROUP_BYTES:
            yield now
            now, size = [], 0
    if now:
        yield now


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Column names as Spark reads them whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; runs may cross texts."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h *= U(_BASE)
        h += word_hashes[i:i + n]
    return mix(h)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + counts[i] - 1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - skip, counts)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given ranges, joined, and each range's offset in them."""
    counts = ends - starts
    return data[expand(starts, counts)], np.concatenate([[0], np.cumsum(counts)])
