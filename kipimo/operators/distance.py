"""Word and character error rates of a whole Arrow batch.

The native ``word_error_rate`` / ``char_error_rate`` columns need no Python, but
``levenshtein`` walks one pair at a time.  Here pairs of similar length advance
together, one anti-diagonal at a time, which takes a fraction of the time; the
results are the same numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import Batch, encode_texts, groups, trim

# Elements of one diagonal over a group of pairs: small enough to stay in cache.
_ROW_BUDGET = 200_000

_RATES = T.StructType(
    [T.StructField("wer", T.DoubleType()), T.StructField("cer", T.DoubleType())]
)


def _group_distances(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray):
    """Edit distances of padded pairs (one per row).

    Cells of one anti-diagonal do not depend on each other, so the table is filled
    diagonal by diagonal, for all pairs at once; index i of a diagonal is the
    number of left elements used.
    """
    pairs, height, width = len(n), left.shape[1], right.shape[1]
    largest = max(left.max(initial=0), right.max(initial=0))
    # As bytes the paddings -1 and -2 become 255 and 254.
    codes = np.uint8 if largest < 254 else np.int16 if largest < 32_000 else np.int32
    left = np.ascontiguousarray(left.T, dtype=codes)
    backwards = np.ascontiguousarray(right.T[::-1], dtype=codes)
    # No cell exceeds the longer side, and one more is the largest sum.
    costs = np.uint8 if max(height, width) < 255 else np.int16 if height + width < 32_000 else np.int32
    before, above, here = (np.zeros((height + 1, pairs), costs) for _ in range(3))
    step = np.empty((height, pairs), costs)
    out = np.zeros(pairs, dtype=np.int64)
    ends = n + m
    finish = set(ends.tolist())
    for s in range(1, int(ends.max(initial=0)) + 1):
        lo, hi = max(1, s - width), min(height, s - 1)
        if lo <= hi:
            cells, diagonal = here[lo : hi + 1], step[lo - 1 : hi]
            other = backwards[width - s + lo : width - s + hi + 1]
            np.not_equal(left[lo - 1 : hi], other, out=diagonal, casting="unsafe")
            diagonal += before[lo - 1 : hi]
            np.minimum(above[lo - 1 : hi], above[lo : hi + 1], out=cells)
            cells += 1
            np.minimum(cells, diagonal, out=cells)
        if s <= width:
            here[0] = s
        if s <= height:
            here[s] = s
        if s in finish:
            done = np.flatnonzero(ends == s)
            out[done] = here[n[done], done]
        before, above, here = above, here, before
    return out


def edit_distances(a: Batch, b: Batch) -> np.ndarray:
    """Levenshtein distance of every pair of sequences."""
    a, b, _, _ = trim(a, b)
    out = np.zeros(len(a.lengths), dtype=np.int64)
    order = np.lexsort((b.lengths, a.lengths))
    for rows in groups(order, a.lengths, _ROW_BUDGET):
        left, right = a.matrix(rows, -1), b.matrix(rows, -2)
        out[rows] = _group_distances(left, right, a.lengths[rows], b.lengths[rows])
    return out


def _texts(reference: pa.Array, hypothesis: pa.Array):
    known = np.asarray(reference.is_valid()) & np.asarray(hypothesis.is_valid())
    return known, reference.fill_null(""), hypothesis.fill_null("")


def _rate(known: np.ndarray, left: Batch, right: Batch) -> pa.Array:
    rate = edit_distances(left, right) / np.maximum(left.lengths, 1)
    return pa.array(rate, pa.float64(), mask=~known | (left.lengths == 0))


def _word_rate(known, refs, hyps) -> pa.Array:
    return _rate(known, *[batch for batch, _ in encode_texts([refs, hyps])])


def _char_rate(known, refs, hyps) -> pa.Array:
    return _rate(known, Batch.of_column(refs), Batch.of_column(hyps))


@F.arrow_udf(_RATES)
def _error_rates(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    given = _texts(reference, hypothesis)
    return pa.StructArray.from_arrays([_word_rate(*given), _char_rate(*given)], names=["wer", "cer"])


@F.arrow_udf(T.DoubleType())
def batch_word_error_rate(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """The word error rate of two normalised texts alone."""
    return _word_rate(*_texts(reference, hypothesis))


@F.arrow_udf(T.DoubleType())
def batch_char_error_rate(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """The character error rate of two normalised texts alone."""
    return _char_rate(*_texts(reference, hypothesis))


def error_rates(reference: Column, hypothesis: Column) -> Column:
    """struct(wer, cer) of two normalised texts; null where the reference is empty."""
    return _error_rates(reference, hypothesis)
