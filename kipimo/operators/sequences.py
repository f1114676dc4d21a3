"""Batches of integer sequences for the edit-distance kernels (NumPy, in tasks).

A batch is one flat code array with a start and a length per sequence, so that
encoding, trimming and padding are array operations over all pairs at once.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Elements of one matrix while trimming, and elements of a pair that are compared first.
_AREA = 2_000_000
_STEP = 32


@dataclass
class Batch:
    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of_lists(cls, codes: list[int], lengths: list[int]) -> "Batch":
        sizes = np.array(lengths, dtype=np.int64)
        return cls(np.array(codes, dtype=np.int32), np.cumsum(sizes) - sizes, sizes)

    @classmethod
    def of_texts(cls, texts: list[str]) -> "Batch":
        """Characters as code points."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
        return cls(codes, np.cumsum(sizes) - sizes, sizes)

    @classmethod
    def of_column(cls, texts: pa.Array) -> "Batch":
        """The same of an Arrow column without nulls, joined there."""
        sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
        whole = pa.ListArray.from_arrays([0, len(texts)], texts)
        joined = pc.binary_join(whole, pa.scalar("", texts.type))[0].as_py()
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.int32)
        return cls(codes, np.cumsum(sizes) - sizes, sizes)

    def matrix(self, rows: np.ndarray, fill: int) -> np.ndarray:
        """Padded (rows, longest) matrix."""
        starts, lengths = self.starts[rows], self.lengths[rows]
        column = np.arange(int(lengths.max(initial=0)))
        inside = column < lengths[:, None]
        at = starts[:, None] + column
        if self.codes.size == 0:
            return np.full(inside.shape, fill, dtype=np.int32)
        return np.where(inside, self.codes.take(at, mode="clip"), np.int32(fill))

    def cut(self, head: np.ndarray, tail: np.ndarray) -> "Batch":
        return Batch(self.codes, self.starts + head, self.lengths - head - tail)


def encode_words(word_lists: list[list[list[str]]]) -> list[Batch]:
    """Batches of several columns of word lists under one vocabulary."""
    ids: dict[str, int] = {}
    return [
        Batch.of_lists(
            [ids.setdefault(w, len(ids)) for words in column for w in words],
            [len(words) for words in column],
        )
        for column in word_lists
    ]


def encode_texts(columns: list[pa.Array]) -> list[tuple[Batch, pa.Array]]:
    """Each column of texts as codes of its white-space words under one vocabulary, and the words."""
    split = []
    for texts in columns:
        lists = pc.utf8_split_whitespace(texts)
        words, row = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
        sizes = np.bincount(row.filter(full).to_numpy().astype(np.int64), minlength=len(texts))
        split.append((words.filter(full), sizes))
    codes = pa.concat_arrays([words for words, _ in split]).dictionary_encode().indices.to_numpy()
    out, at = [], 0
    for words, sizes in split:
        out.append((Batch(codes[at : at + len(words)], np.cumsum(sizes) - sizes, sizes), words))
        at += len(words)
    return out


def groups(order: np.ndarray, heights: np.ndarray, budget: int):
    """Consecutive index groups, largest first, with rows x largest <= budget."""
    at = len(order)
    while at > 0:
        rows = max(1, budget // (int(heights[order[at - 1]]) + 1))
        yield order[max(0, at - rows) : at]
        at -= rows


def _common(a: Batch, b: Batch, backwards: bool) -> np.ndarray:
    """How many elements at the beginning, or at the end, both sequences of a pair share.

    Most pairs differ early, so a few elements are compared at a time, and more of the
    pairs that go on.
    """
    shorter = np.minimum(a.lengths, b.lengths)
    common = np.zeros(len(shorter), dtype=np.int64)
    rows, step = np.flatnonzero(shorter), _STEP
    while len(rows):
        on, size = [], max(1, _AREA // step)
        for part in (rows[k : k + size] for k in range(0, len(rows), size)):
            column = np.arange(min(step, int((shorter - common)[part].max())))
            alike = column < (shorter - common)[part, None]
            sides = []
            for x in (a, b):
                first = x.starts[part] + (x.lengths[part] - 1 - common[part] if backwards else common[part])
                sides.append(x.codes.take(first[:, None] + (-column if backwards else column), mode="clip"))
            alike &= sides[0] == sides[1]
            count = np.where(alike.all(axis=1), len(column), alike.argmin(axis=1))
            common[part] += count
            on.append(part[count == len(column)])
        rows = np.concatenate(on)
        rows, step = rows[common[rows] < shorter[rows]], min(2 * step, _AREA)
    return common


def trim(a: Batch, b: Batch) -> tuple[Batch, Batch, np.ndarray, np.ndarray]:
    """Both batches without common ends, with prefix and suffix lengths."""
    found = []
    for backwards in (False, True):
        common = _common(a, b, backwards)
        nothing = np.zeros_like(common)
        ends = (nothing, common) if backwards else (common, nothing)
        a, b = a.cut(*ends), b.cut(*ends)
        found.append(common)
    return a, b, *found
