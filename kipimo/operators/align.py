"""Word alignment as an Arrow UDF.

Spark partitions the utterances; inside a task a whole Arrow batch is aligned at
once: pairs of similar size share one padded NumPy edit-distance table, and the
trace back walks all of them in lock step.  A pair too large for a full table
keeps one table row per block of reference words and recomputes block by block,
so memory grows with sqrt(reference) x hypothesis.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ALIGNMENT
from .sequences import Batch, encode_texts, encode_words, groups, trim

_CELL_BUDGET = 4_000_000
_EQUAL, _SUBSTITUTE, _DELETE, _INSERT = range(4)


def _rows(first: np.ndarray, words: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """Edit-distance rows below ``first`` for a block of reference words.

    first: (pairs, m+1); words: (pairs, block); hyp: (pairs, m).  Insertions run
    along a row, hence the running minimum of (cost - column).
    """
    columns = np.arange(first.shape[1], dtype=np.int32)
    table = np.empty((words.shape[1] + 1, *first.shape), dtype=np.int32)
    table[0] = first
    for i in range(words.shape[1]):
        above, row = table[i], table[i + 1]
        row[:] = above + 1
        np.minimum(row[:, 1:], above[:, :-1] + (hyp != words[:, i : i + 1]), out=row[:, 1:])
        row -= columns
        np.minimum.accumulate(row, axis=1, out=row)
        row += columns
    return table


def _trace(ref: np.ndarray, hyp: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit codes, right-aligned, of padded pairs; unused cells are -1.

    Going back from the end: a deletion where the cell above is one cheaper, else
    an insertion where the left cell is one cheaper than the diagonal, else the
    diagonal.
    """
    pairs, width = ref.shape[0], hyp.shape[1]
    size = max(int(ref.shape[1]), 1)
    block = size if pairs * (size + 1) * (width + 1) <= _CELL_BUDGET else int(size**0.5) + 1
    starts = list(range(0, size, block))
    first = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (pairs, width + 1))
    tops = [first]
    for start in starts[:-1]:
        tops.append(_rows(tops[-1], ref[:, start : start + block], hyp)[-1].copy())
    codes = np.full((pairs, ref.shape[1] + width), -1, dtype=np.int8)
    i, j, at = n.copy(), m.copy(), np.full(pairs, codes.shape[1])
    for start, top in zip(reversed(starts), reversed(tops), strict=True):
        table = _rows(top, ref[:, start : start + block], hyp)
        while True:
            live = np.flatnonzero((i > start) & (i + j > 0))
            if live.size == 0:
                break
            a, b = i[live], j[live]
            up = table[a - 1 - start, live, b]
            left_of = np.maximum(b - 1, 0)
            diagonal = table[a - 1 - start, live, left_of]
            delete = (b == 0) | (table[a - start, live, b] == up + 1)
            insert = ~delete & (table[a - start, live, left_of] == diagonal - 1)
            same = ref[live, a - 1] == hyp[live, left_of] if width else np.zeros(live.size, bool)
            at[live] -= 1
            codes[live, at[live]] = np.where(
                delete, _DELETE, np.where(insert, _INSERT, np.where(same, _EQUAL, _SUBSTITUTE))
            )
            i[live] -= ~insert
            j[live] -= ~delete
    for pair in np.flatnonzero(j > 0):
        codes[pair, at[pair] - j[pair] : at[pair]] = _INSERT
    return codes


def edit_codes(ref: Batch, hyp: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Edit codes of all pairs, flat, and how many each pair has."""
    short_ref, short_hyp, head, tail = trim(ref, hyp)
    n, m = short_ref.lengths, short_hyp.lengths
    middles: list = [None] * len(n)
    for rows in groups(np.lexsort((m, n)), (n + 1) * (m.max(initial=0) + 1), _CELL_BUDGET):
        left, right = short_ref.matrix(rows, -1), short_hyp.matrix(rows, -2)
        codes = _trace(left, right, n[rows], m[rows])
        used = codes >= 0
        cuts = np.cumsum(used.sum(axis=1))[:-1]
        for row, middle in zip(rows, np.split(codes[used], cuts), strict=True):
            middles[row] = middle
    sizes = np.array([x.size for x in middles], dtype=np.int64)
    total = head + sizes + tail
    flat = np.zeros(int(total.sum()), dtype=np.int8)
    first = np.cumsum(total) - total + head
    inner = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    if middles:
        flat[inner] = np.concatenate(middles)
    return flat, total


def _runs(codes: np.ndarray, total: np.ndarray):
    """(pair, code, first reference word, first hypothesis word, length) of every
    run of equal edits other than hits."""
    pair = np.repeat(np.arange(len(total)), total)
    start = np.ones(len(codes), dtype=bool)
    start[1:] = (codes[1:] != codes[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(codes)))
    opening = (np.cumsum(total) - total)[pair[at]]

    def used(without):
        before = np.concatenate([[0], np.cumsum(codes != without)])
        return before[at] - before[opening]

    keep = codes[at] != _EQUAL
    columns = (pair[at], codes[at], used(_INSERT), used(_DELETE), length)
    return [c[keep] for c in columns]


def alignments(references: list[list[str]], hypotheses: list[list[str]]) -> pa.StructArray:
    """Counts and merged runs of every pair, as the columns of ``ALIGNMENT``."""
    words = [pa.array([w for one in column for w in one], pa.string()) for column in (references, hypotheses)]
    return _aligned(*zip(encode_words([references, hypotheses]), words, strict=True))


def _joined(words: pa.Array, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """Runs of words as texts."""
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(at))), " ")


def _aligned(reference: tuple[Batch, pa.Array], hypothesis: tuple[Batch, pa.Array]) -> pa.StructArray:
    (ref, ref_words), (hyp, hyp_words) = reference, hypothesis
    codes, total = edit_codes(ref, hyp)
    pair = np.repeat(np.arange(len(total)), total)
    counts = np.bincount(pair * 4 + codes, minlength=len(total) * 4).reshape(-1, 4)
    k, code, i, j, length = _runs(codes, total)
    first = {"reference": (ref_words, ref.starts[k] + i), "hypothesis": (hyp_words, hyp.starts[k] + j)}

    def listed(wanted, fields):
        own = np.flatnonzero(code == wanted)
        values = [_joined(first[f][0], first[f][1][own], length[own]) for f in fields]
        runs = pa.StructArray.from_arrays(values, names=fields)
        sizes = np.bincount(k[own], minlength=len(total))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), runs)

    numbers = [counts[:, c] for c in (_EQUAL, _SUBSTITUTE, _DELETE, _INSERT)] + [ref.lengths]
    return pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in numbers]
        + [
            listed(_SUBSTITUTE, ["reference", "hypothesis"]),
            listed(_DELETE, ["reference"]),
            listed(_INSERT, ["hypothesis"]),
        ],
        names=ALIGNMENT.names,
    )


@F.arrow_udf(ALIGNMENT)
def _align(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    known = np.asarray(reference.is_valid()) & np.asarray(hypothesis.is_valid())
    aligned = _aligned(*encode_texts([reference.fill_null(""), hypothesis.fill_null("")]))
    columns = [aligned.field(k) for k in range(aligned.type.num_fields)]
    return pa.StructArray.from_arrays(columns, names=ALIGNMENT.names, mask=pa.array(~known))


def align_words(reference: Column, hypothesis: Column) -> Column:
    """Alignment struct of two normalised texts (see ``schemas.ALIGNMENT``)."""
    return _align(reference, hypothesis)


def with_alignment(df: DataFrame, reference="reference", hypothesis="hypothesis") -> DataFrame:
    return df.withColumn("alignment", align_words(F.col(reference), F.col(hypothesis)))
