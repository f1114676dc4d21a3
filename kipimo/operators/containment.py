"""Which documents contain a text of a list, word for word.

Keys of word runs come from running sums, so the key of any run of any length costs one
subtraction.  Every listed text is filed under the key of its first words (a run of ``k``
words, doubled while it fits; the whole of a shorter text) and under that of all its
words.  Two bit tables of these keys, of bounded size, go to all tasks.  A document tries
the runs of those lengths at each of its words; only where one is a text's beginning are
the lengths of the listed texts tried, by the table of whole texts.  What both tables let
through is a row of document and digest of the run, and the digest decides.

So no run and no text is shuffled, only one small row per listed text and per hit, and
a beginning that many texts and documents share makes no pairs of them: a document tries
lengths, not texts.  A full table costs speed, not results.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .selection import SMALL_ROWS

ANCHOR_WORDS = 5
SLICE_BYTES = 1 << 20
_PART = 32_768
_MOST_BITS = 1 << 27
_CELLS = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=_U)
_UP = 0x9E3779B97F4A7C15
_DOWN = pow(_UP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> _U(33))) * _U(factor)
    return h ^ (h >> _U(33))


def _spans(value: np.ndarray):
    """A function that gives the keys of spans (start, size) of the values."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * _powers(_UP, len(value)), dtype=_U)])
    down = _powers(_DOWN, len(value) + 1)
    return lambda start, size: _mixed((sums[start + size] - sums[start]) * down[start] + np.asarray(size).astype(_U))


class _Texts:
    """The words of some texts: longest runs of bytes outside ASCII white space."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.start, text_at)
        self.size = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        words = _spans(_BYTE[raw])(self.start, self.end - self.start)
        self.keys = _spans(words)  # of word runs
        self.left = self.first[self.doc + 1] - np.arange(len(words))

    def digest(self, at: int, size: int) -> bytes:
        run = self.data[self.start[at] : self.end[at + size - 1]]
        return hashlib.sha256(b" ".join(run.split())).digest()


def _sliced(batches, column: int):
    """(batch, texts) of about ``SLICE_BYTES``; one text is never cut."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
        sums = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at), _Texts(texts[at:to])
            at = to


def _beginning(size: np.ndarray, k: int) -> np.ndarray:
    """How many first words a text of so many words is filed under."""
    power = np.frexp(np.maximum(size // k, 1).astype(float))[1] - 1
    return np.where(size < k, size, k << power)


def _filed(k: int):
    def rows(batches):
        for batch, texts in _sliced(batches, 1):
            some = np.flatnonzero(texts.size > 0)
            at, size = texts.first[some], texts.size[some]
            keys = [pa.array(texts.keys(at, n).view(np.int64)) for n in (_beginning(size, k), size)]
            digests = pa.array([texts.digest(*x) for x in zip(at.tolist(), size.tolist())], pa.binary())
            columns = [batch.column(0).take(pa.array(some)), digests, pa.array(size, pa.int64()), *keys]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "digest", "n", "beginning", "whole"])

    return rows


def listed_texts(items: DataFrame, id_col: str, text_col: str, k: int = ANCHOR_WORDS) -> DataFrame:
    """digest, n, beginning, whole, item_id, copies: one row per distinct word sequence, with its smallest id."""
    chosen = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["item_id"].dataType.simpleString()
    made = chosen.mapInArrow(_filed(k), f"item_id {kind}, digest binary, n long, beginning long, whole long")
    sums = F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies")
    return made.groupBy("digest", "n", "beginning", "whole").agg(*sums)


def _bits(listed: DataFrame, column: str, size: int) -> np.ndarray:
    """A bit table with two bits for each key."""
    key = F.col(column)
    both = F.array(*[x.bitwiseAND(F.lit(size - 1)) for x in (key, F.shiftrightunsigned(key, 32))])
    slots = listed.select(F.explode(both).alias("s")).select(F.floor(F.col("s") / _PART).alias("part"), (F.col("s") % _PART).alias("bit"))
    table = np.zeros((size // _PART, _PART // 8), np.uint8)
    for row in slots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 4 KB each, 16 MB in all
        table[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table.ravel()


def _known(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    last, seven = _U(8 * len(table) - 1), _U(7)
    at = keys & last
    found = np.flatnonzero((table[at >> _U(3)] >> (at & seven).astype(np.uint8)) & 1)
    at = (keys[found] >> _U(32)) & last
    out = np.zeros(len(keys), bool)
    out[found] = (table[at >> _U(3)] >> (at & seven).astype(np.uint8)) & 1
    return out


def _hits(texts: _Texts, lengths: dict[int, np.ndarray], beginnings: np.ndarray, wholes: np.ndarray):
    """(text, first word, words) of runs that are listed texts by both tables, each once in a text."""
    held = [np.zeros((0, 4), np.int64)]
    for least, sizes in lengths.items():
        at = np.flatnonzero(texts.left >= least)
        at = at[_known(beginnings, texts.keys(at, np.full(len(at), least)))]
        step = max(1, _CELLS // len(sizes))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            row, which = np.nonzero(texts.left[some][:, None] >= sizes)
            start, size = some[row], sizes[which]
            keys = texts.keys(start, size)
            good = _known(wholes, keys)
            found = np.stack([texts.doc[start[good]], keys[good].view(np.int64), start[good], size[good]], 1)
            held.append(found[np.unique(found[:, :2], axis=0, return_index=True)[1]])
    found = np.concatenate(held)
    found = found[np.unique(found[:, :2], axis=0, return_index=True)[1]]
    return found[:, [0, 2, 3]].tolist()


def contained_texts(
    documents: DataFrame,
    items: DataFrame,
    document_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    k: int = ANCHOR_WORDS,
) -> DataFrame:
    """One row per document and listed text that it contains as a run of whole words.

    doc_id, doc_key (hash of the document's text), item_id, copies.  Equal listed texts
    are one, under their smallest id, with their number as ``copies``; equal rows of
    ``documents`` are one.  Case and punctuation count, the kind and length of ASCII
    white space do not.  Listed texts without words are contained nowhere.
    """
    if k < 1:
        raise ValueError("an anchor has at least one word")
    listed = staged(listed_texts(items, item_id, item_text, k))
    sizes = np.array(sorted(r.n for r in listed.select("n").distinct().collect()), np.int64)  # lengths, not texts
    least = _beginning(sizes, k)
    lengths = {int(b): sizes[least == b] for b in np.unique(least)}
    n_listed = listed.count()
    n_bits = max(_PART, min(1 << (64 * n_listed).bit_length(), _MOST_BITS))
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((lengths, _bits(listed, "beginning", n_bits), _bits(listed, "whole", n_bits)))
    docs = documents.select(F.col(document_id).alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def met(batches):
        for batch, texts in _sliced(batches, 2):
            found = _hits(texts, *shared.value)
            row = pa.array([d for d, _, _ in found], pa.int64())
            digests = pa.array([texts.digest(at, size) for _, at, size in found], pa.binary())
            columns = [batch.column(0).take(row), batch.column(1).take(row), digests]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_key", "digest"])

    hits = staged(docs.mapInArrow(met, f"doc_id {kind}, doc_key long, digest binary"))
    texts = listed.select("digest", "item_id", "copies")
    found = hits.join(F.broadcast(texts) if n_listed <= SMALL_ROWS else texts, "digest")
    return found.select("doc_id", "doc_key", "item_id", "copies").distinct()


def exclude_containing(
    documents: DataFrame,
    items: DataFrame,
    document_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    k: int = ANCHOR_WORDS,
) -> DataFrame:
    """The rows of ``documents`` that contain none of the listed texts, with all their columns."""
    found = staged(contained_texts(documents, items, document_id, item_id, text, item_text, k))
    bad = found.select(F.col("doc_id").alias("_doc_id"), F.col("doc_key").alias("_doc_key")).distinct()
    same = F.col(document_id).eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_doc_key"))
    return documents.join(bad, same, "left_anti")
