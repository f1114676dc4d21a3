"""Words of many texts at once, as NumPy arrays over one buffer.

A word is a longest run of bytes outside space and 0x09-0x0D, so words are found on
UTF-8 bytes without decoding.  Inputs are worked off in slices of about
``SLICE_BYTES``; one text is never cut, so a worker holds some forty bytes for each
byte of a slice or of the longest single text, whichever is more.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
_SUMMED = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_SEED.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 3
_PLACE = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def _power_table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_tables = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, n of each at least."""
    global _tables
    if len(_tables[0]) < n:
        size = min(max(2 * n, 4096), _SUMMED + 1)
        _tables = [_power_table(base, max(size, n)) for base in (_STEP, pow(_STEP, -1, 1 << 64))]
    return _tables


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; at least one row each."""
    if not len(column):
        return
    ends = np.cumsum(_lengths(column))
    at, n = 0, len(column)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int64)


def filled(column) -> pa.Array:
    """The strings of a column as one array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("")


@dataclass
class TextBlock:
    """Texts behind each other in ``data``, a space after each.

    ``text_at[i]`` is where text i starts.  For each word: ``doc`` (its text's
    index), ``start`` and ``end`` in ``data``.
    """

    data: np.ndarray
    text_at: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> "TextBlock":
        n = len(column)
        offsets = _offsets(column) if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        text = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        data = np.full(len(text) + n, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[offsets[1:] - offsets[0] + np.arange(n)] = False
        data[keep] = _LOWER[text] if lower else text
        text_at = offsets - offsets[0] + np.arange(n + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        return cls(data, text_at, np.searchsorted(text_at, start, "right") - 1, start, end)

    @property
    def n(self) -> int:
        return len(self.text_at) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit key for each word."""
        return span_hashes(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        """Words in each text."""
        return np.bincount(self.doc, minlength=self.n)

    def first_word(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def bytes_of(self, i: int) -> bytes:
        """Text i."""
        return self.data[self.text_at[i] : self.text_at[i + 1] - 1].tobytes()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of disjoint, ascending byte spans.

    By running sums over all bytes; over more than ``_SUMMED`` bytes, whose tables would
    be kept, byte by byte.  The keys are the same.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    raw = data[start[0] : end[-1]]
    if len(raw) <= _SUMMED:
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        values = _BYTE[raw]
        values *= up[: len(raw)]
        np.cumsum(values, out=sums[1:])
        at = start - start[0]
        total = (sums[at + size] - sums[at]) * down[at]
    else:
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        at = place + np.repeat(start, size)
        values = _BYTE[data[at]] * _power_table(_STEP, int(size.max()))[place]
        total = np.add.reduceat(values, ends - size)
    return mixed(total + size.astype(np.uint64) * _M2)


def windows(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of k words within one text, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _PLACE[j]
    return mixed(total[inside]), inside


def in_order(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (doc, key), and where in that order an equal entry stands before."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    again = np.zeros(len(order), bool)
    again[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    return order, again
