"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages of ``PASSAGE`` words.

1. *TF-IDF.*  Terms are the words of the benchmark; document frequencies are counted
   over all documents.  Words that no item has keep a passage's norm honest: a passage
   of other words cannot come near an item.
2. *Distributed randomised SVD.*  All passages of the benchmark and of the documents
   form the matrix X.  One pass adds up X'X over pairs of terms, in whole numbers, so the
   sums depend neither on the order nor on the split of the rows; it holds at most one
   number per pair of benchmark words, however many passages there are.  The right
   singular vectors come from subspace iteration: tasks multiply their rows of X'X with
   the current basis, the driver adds the partial products (terms x rank, ``SVD_TASKS``
   of them) and orthonormalises.  However many they are, the document passages together
   weigh no more than ``DOCUMENT_MASS`` passages, so the benchmark's own directions are
   kept in the basis of a large table.  ``sample`` bounds the document passages, by a
   hash of document, place and words, so that copies are taken or left one by one;
   unset, none is left out.
3. *Cosine search.*  Every passage of every document is projected and compared with all
   item passages at once.  The cosine is at most the root of the passage's share of
   benchmark terms, so most passages are left out before they are projected.
   A short item is too small a share of a passage for that.  Items of fewer than
   ``EXACT`` words are therefore looked up by their rarest words, so many that every
   match holds one; all passages around those words are candidates.
4. *Checks.*  Around a candidate passage, the longest common subsequence of words with
   the item decides: ``matched`` of the item's words, or a looser share if its last
   words, the answer, are there too.  Paraphrases that keep the order pass.

Row-local but for counts of the benchmark's distinct words; a hot source or group of
copies changes nothing, and a very long text is cut into passages like any other.
Terms, frequencies and basis are those of the whole benchmark and are broadcast once.
Only the search goes by blocks of about ``block`` items, each collected and broadcast on
its own, so which items are found does not depend on ``block``.

Defined cases: null and empty texts or items match nothing; items of fewer than
``SHORT`` words must match wholly, their words in order around one passage (a short item
of common words is in many texts); repeated documents or items each give rows; an empty
table gives an empty result; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.stage import staged
from .textblock import TextBlock, filled, mixed, slices, span_hashes

PASSAGE, STRIDE = 20, 10
RANK, SPARE, ROUNDS = 192, 8, 3
SVD_TASKS = 4
BENCHMARK_WEIGHT, DOCUMENT_MASS = 8.0, 20_000
COSINE = 0.5
MATCHED, MATCHED_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.75
ANSWER_WORDS, SHORT, EXACT = 8, 8, 13
BLOCK = 2_000
_CHUNK = 1_000
_HITS = 10_000
_CELLS = 1 << 24  # pairs of terms that a task sums in one table
_UNIT = 1 << 32  # of whole numbers in X'X
_PAIRS = "term int, other array<int>, total array<long>"
_TRIM = np.zeros(256, bool)
_TRIM[np.frombuffer(b".,;:!?\"'()[]{}<>*#$%&|-_", np.uint8)] = True


class Words:
    """Lower-case words without punctuation at their ends."""

    def __init__(self, column: pa.Array):
        block = TextBlock.of(column, lower=True)
        start, end, doc = block.start.copy(), block.end.copy(), block.doc
        for edge, step in ((start, 1), (end, -1)):
            at = np.flatnonzero(start < end)
            while len(at):
                at = at[(start[at] < end[at]) & _TRIM[block.data[np.minimum(edge[at] - (step < 0), len(block.data) - 1)]]]
                edge[at] += step
        stay = start < end
        self.data, self.start, self.end, self.doc = block.data, start[stay], end[stay], doc[stay]
        self.n = block.n
        self.key = span_hashes(self.data, self.start, self.end)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last word of all passages, text by text."""
        size = np.diff(self.first)
        count = np.where(size > 0, np.maximum(-(-(size - PASSAGE) // STRIDE), 0) + 1, 0)
        doc = np.repeat(np.arange(self.n), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = self.first[doc] + place * STRIDE
        return begin, np.minimum(begin + PASSAGE, self.first[doc + 1])


def _terms(vocabulary: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of each word in the vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
    return np.where(vocabulary[at] == key, at, -1)


def common_subsequence(masks: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence of ``words`` and the ``size`` masked ones."""
    full = (1 << size) - 1
    row = full
    for w in words:
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _masks(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def least_share(size: int) -> float:
    """The share of an item of ``size`` words without which nothing matches."""
    return MATCHED_WITH_ANSWER if size >= SHORT else 1.0


class Item:
    """One benchmark item with what its checks need."""

    def __init__(self, item_id, words: list):
        self.item_id, self.size = item_id, len(words)
        answer = words[-min(ANSWER_WORDS, max(len(words) // 3, 1)) :]
        self.masks, self.answer, self.answer_size = _masks(words), _masks(answer), len(answer)

    def check(self, words: list) -> tuple[float, float] | None:
        """Shares of the item and of its answer that the words hold in order, if enough."""
        matched = common_subsequence(self.masks, self.size, words) / self.size
        if matched < least_share(self.size):
            return None
        answer = common_subsequence(self.answer, self.answer_size, words) / self.answer_size
        return (matched, answer) if matched >= MATCHED or answer >= ANSWER else None


def _document_frequencies(vocabulary: np.ndarray):
    """(term, documents that have it), and as term -1 the number of passages."""

    def rows(batches):
        total, n_passages = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            text = filled(batch.column(0))
            for lo, hi in slices(text):
                words = Words(text.slice(lo, hi - lo))
                term = _terms(vocabulary, words.key)
                known = term >= 0
                pairs = np.unique(words.doc[known] * len(vocabulary) + term[known])
                total += np.bincount(pairs % max(len(vocabulary), 1), minlength=len(vocabulary))
                n_passages += len(words.passages()[0])
        found = np.flatnonzero(total)
        terms, counts = np.concatenate([found, [-1]]), np.concatenate([total[found], [n_passages]])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])

    return rows


def _word_keys(batches):
    """The distinct words of each slice."""
    for batch in batches:
        text = filled(batch.column(0))
        for lo, hi in slices(text):
            keys = np.unique(Words(text.slice(lo, hi - lo)).key)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _sampled(vocabulary: np.ndarray, share: float):
    """Terms of the passages whose hash is below ``share`` of all hashes; of all from 1.0 on."""
    limit = int(min(share, 1.0) * (1 << 62))

    def rows(batches):
        for batch in batches:
            text = filled(batch.column(1))
            ids = batch.column(0).to_numpy().view(np.uint64)
            for lo, hi in slices(text):
                words = Words(text.slice(lo, hi - lo))
                begin, end = words.passages()
                if share < 1.0:
                    doc = words.doc[begin]
                    own = mixed(ids[lo + doc] + (begin - words.first[doc]).astype(np.uint64))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.key)])
                    mark = (mixed(own + sums[end] - sums[begin]) >> np.uint64(2)).astype(np.int64)
                    begin, end = begin[mark < limit], end[mark < limit]
                term = _terms(vocabulary, words.key).astype(np.int32)
                at, place = _expanded(begin, end - begin)
                inside = term[at + place]
                known = np.concatenate([[0], np.cumsum(inside >= 0)])
                ends = np.concatenate([[0], known[np.cumsum(end - begin)]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(inside[inside >= 0]))
                yield pa.RecordBatch.from_arrays([lists], ["terms"])

    return rows


class PairSums:
    """Whole-number sums per pair of terms (larger x smaller, as a triangle).

    One table if it has at most ``_CELLS`` cells; else sorted pairs, which are handed on
    whenever there are as many.
    """

    def __init__(self, n_terms: int):
        cells = n_terms * (n_terms + 1) // 2
        self.rows = np.arange(n_terms + 1, dtype=np.int64) * np.arange(1, n_terms + 2) // 2
        self.table = np.zeros(cells, np.int64) if cells <= _CELLS else None
        self.pending, self.n_pending = [], 0

    def add(self, terms: np.ndarray, owner: np.ndarray, value: np.ndarray) -> None:
        """All pairs of the terms of one owner (ascending); ``value`` is the owner's."""
        terms, lag = terms.astype(np.int64), 0
        at = np.arange(len(terms))
        while len(at):
            a, b = terms[at], terms[at + lag]
            high = np.maximum(a, b)
            twice = (a == b) & (lag > 0)  # both orders of the pair are in one cell
            self._put(self.rows[high] + np.minimum(a, b), value[owner[at]] << twice)
            lag += 1
            at = at[at + lag < len(terms)]
            at = at[owner[at] == owner[at + lag]]

    def _put(self, cell: np.ndarray, value: np.ndarray) -> None:
        if self.table is not None:
            np.add.at(self.table, cell, value)
            return
        self.pending.append((cell, value))
        self.n_pending += len(cell)
        if self.n_pending > _CELLS:
            self._merge()

    def _merge(self) -> None:
        cell, value = (np.concatenate(x) for x in zip(*self.pending))
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
        self.pending = [(cell[edge], np.add.reduceat(value, edge))]
        self.n_pending = len(edge)

    def full(self) -> bool:
        """Whether merging no longer makes room."""
        return self.table is None and 2 * self.n_pending > _CELLS

    def taken(self):
        """Batches of (term, other terms, sums), which are then forgotten."""
        if self.table is not None:
            cell = np.flatnonzero(self.table)
            value = self.table[cell]
            self.table[:] = 0
        elif self.pending:
            self._merge()
            cell, value = self.pending[0]
            self.pending, self.n_pending = [], 0
        else:
            return
        yield from _pair_rows(np.searchsorted(self.rows, cell, "right") - 1, cell, value, self.rows)


def _pair_rows(term: np.ndarray, cell: np.ndarray, value: np.ndarray, rows: np.ndarray):
    """One row per term, in batches of about a million pairs."""
    edge = np.flatnonzero(np.concatenate([[True], np.diff(term) != 0, [True]])) if len(term) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 1_000_000, "right")) - 1)
        own = slice(edge[lo], edge[hi])
        offsets = pa.array((edge[lo : hi + 1] - edge[lo]).astype(np.int32))
        other = (cell[own] - rows[term[own]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (other, value[own])]
        yield pa.RecordBatch.from_arrays([pa.array(term[edge[lo:hi]].astype(np.int32)), *lists], ["term", "other", "total"])
        lo = hi


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and the row of each."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def _pair_sums(idf: np.ndarray):
    """Sums of (weight / length)^2 of the passages over their pairs of terms."""

    def rows(batches):
        sums = PairSums(len(idf))
        for batch in batches:
            terms, owner = _flat(batch.column(0))
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            square = np.bincount(owner, idf[terms] ** 2, minlength=len(weight))
            value = np.rint(weight**2 / np.where(square > 0, square, 1.0) * _UNIT).astype(np.int64)
            sums.add(terms, owner, value)
            if sums.full():
                yield from sums.taken()
        yield from sums.taken()

    return rows


def _summed(n_terms: int):
    """Rows of equal terms, which follow each other, as one."""

    def rows(batches):
        last, whole = -1, np.zeros(n_terms, np.int64)

        def row():
            other = np.flatnonzero(whole).astype(np.int32)
            columns = [pa.array([last], pa.int32()), pa.array([other], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([whole[other]], pa.list_(pa.int64()))], ["term", "other", "total"])

        for batch in batches:
            for i, term in enumerate(batch.column(0).to_pylist()):
                if term != last and last >= 0:
                    yield row()
                    whole[:] = 0
                last = term
                whole[batch.column(1)[i].values.to_numpy()] += batch.column(2)[i].values.to_numpy()
        if last >= 0:
            yield row()

    return rows


def _product(batch: pa.RecordBatch, idf: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` what rows of the triangle of X'X give of X'X basis."""
    every = batch.column(0).to_numpy()
    step = max(1, 2_000_000 // len(idf))
    for lo in range(0, len(every), step):
        term = every[lo : lo + step].astype(np.int64)
        other, row = _flat(batch.column(1).slice(lo, step))
        total, _ = _flat(batch.column(2).slice(lo, step))
        block = np.zeros((len(term), len(idf)))
        block[row, other] = total / _UNIT * idf[other] * idf[term[row]]
        out[term] += block @ basis
        block[np.arange(len(term)), term] = 0.0
        out += block.T @ basis[term]


def singular_vectors(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of weighted passages."""
    n = len(idf)
    parts = passages.select("terms", "weight").mapInArrow(_pair_sums(idf), _PAIRS)
    square = staged(parts.repartition("term").sortWithinPartitions("term").mapInArrow(_summed(n), _PAIRS))
    width = min(rank + SPARE, n)
    basis = np.linalg.qr(np.random.default_rng(3).normal(size=(n, width)))[0]
    context = passages.sparkSession.sparkContext
    image = basis
    for _ in range(ROUNDS):
        shared = context.broadcast(basis.astype(np.float32))

        def partial(batches, shared=shared):
            total, basis = np.zeros((n, width)), shared.value.astype(np.float64)
            for batch in batches:
                _product(batch, idf, basis, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["z"])

        image = np.zeros(basis.shape)
        for row in square.coalesce(SVD_TASKS).mapInArrow(partial, "z binary").collect():  # SVD_TASKS rows
            image += np.frombuffer(bytes(row["z"]), np.float32).reshape(image.shape)
        last, basis = basis, np.linalg.qr(image)[0]
    small = last.T @ image
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return (last @ turn[:, ::-1][:, :rank]).astype(np.float32)


class ShortItems:
    """Items of fewer than ``EXACT`` words by their rarest words.

    A match holds ``need`` of an item's words, so it holds one of any ``size - need + 1``.
    """

    def __init__(self, terms: list, frequency: np.ndarray):
        self.item = np.array([i for i, t in enumerate(terms) if 0 < len(t) < EXACT], np.int64)
        self.size = np.array([len(terms[i]) for i in self.item], np.int64)
        self.need = np.array([next(k for k in range(1, n + 1) if k / n >= least_share(n)) for n in self.size.tolist()], np.int64)
        self.terms = np.full((len(self.item), EXACT - 1), -2, np.int64)
        listed = []
        for k, i in enumerate(self.item):
            own = np.asarray(terms[i], np.int64)
            self.terms[k, : len(own)] = own
            rare = own[np.argsort(frequency[own], kind="stable")][: len(own) - self.need[k] + 1]
            listed += [(t, k) for t in np.unique(rare).tolist()]
        by_term = np.array(sorted(listed), np.int64).reshape(-1, 2)
        self.listed = by_term[:, 1]
        self.count = np.bincount(by_term[:, 0], minlength=len(frequency))
        self.at = np.cumsum(self.count) - self.count

    def candidates(self, words: Words, term: np.ndarray):
        """(first words, item indices) of all passages that may match a short item."""
        if not len(self.item):
            return
        place = np.flatnonzero(term >= 0)
        place = place[self.count[term[place]] > 0]
        total = np.cumsum(self.count[term[place]])
        lo = 0
        while lo < len(place):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + _HITS, "right")))
            yield from self._around(words, term, place[lo:hi])
            lo = hi

    def _around(self, words: Words, term: np.ndarray, place: np.ndarray):
        begin, owner = _expanded(place, self.count[term[place]])
        short = self.listed[self.at[term[begin]] + owner]
        first = words.first[words.doc[begin]]
        near, size = begin - first, self.size[short]
        n_passages = np.maximum(-(-(words.first[words.doc[begin] + 1] - first - PASSAGE) // STRIDE), 0) + 1
        low = np.maximum(-(-(near - size - PASSAGE + 1) // STRIDE), 0)
        high = np.minimum((near + size) // STRIDE, n_passages - 1)
        row, step = _expanded(np.arange(len(begin)), np.maximum(high - low + 1, 0))
        pairs = np.unique(np.stack([first[row] + (low[row] + step) * STRIDE, short[row]], 1), axis=0)
        for lo in range(0, len(pairs), _HITS):
            begin, short = pairs[lo : lo + _HITS].T
            size, doc = self.size[short], words.doc[begin]
            at = (begin - size)[:, None] + np.arange(PASSAGE + 2 * int(size.max()))
            inside = (at >= words.first[doc][:, None]) & (at < np.minimum(begin + PASSAGE + size, words.first[doc + 1])[:, None])
            window = np.where(inside, term[np.clip(at, 0, len(term) - 1)], -1)
            held = sum((window == self.terms[short, j][:, None]).any(1).astype(np.int64) for j in range(int(size.max())))
            stay = held >= self.need[short]
            yield begin[stay], self.item[short[stay]]


def _expanded(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value ``count`` times, and its number among them."""
    return np.repeat(values, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Space:
    """Terms of the whole benchmark, their weights and the latent basis."""

    def __init__(self, vocabulary: np.ndarray, frequency: np.ndarray, idf: np.ndarray, vectors: np.ndarray):
        self.vocabulary, self.frequency, self.idf, self.vectors = vocabulary, frequency, idf, vectors
        self.other = float(idf.mean()) if len(idf) else 1.0

    def project(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit latent vectors of passages; of zero length where nothing is known."""
        size = end - begin
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        row = np.repeat(np.arange(len(size)), size)
        known = term[at] >= 0
        at, row = at[known], row[known]
        out = np.zeros((len(size), self.vectors.shape[1]), np.float32)
        if len(at):
            value = self.vectors[term[at]] * self.idf[term[at]].astype(np.float32)[:, None]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
            out[row[edge]] = np.add.reduceat(value, edge)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Index:
    """Items with the latent vectors of their passages."""

    def __init__(self, space: Space, rows: list):
        words = Words(pa.array([r["text"] or "" for r in rows], pa.string()))
        first, term = words.first, _terms(space.vocabulary, words.key)
        begin, end = words.passages()
        self.items = [Item(r["item_id"], [words.word(k) for k in range(first[i], first[i + 1])]) for i, r in enumerate(rows)]
        self.owner, self.latent = words.doc[begin] if len(begin) else begin, space.project(term, begin, end)
        self.short = ShortItems([term[first[i] : first[i + 1]] for i in range(words.n)], space.frequency)

    def candidates(self, space: Space, words: Words):
        """(first word, item index) of passages near an item."""
        term = _terms(space.vocabulary, words.key)
        for begin, owner in self.short.candidates(words, term):
            yield from zip(begin.tolist(), owner.tolist())
        begin, end = words.passages()
        square = np.where(term >= 0, space.idf[term] if len(space.idf) else 0.0, space.other) ** 2
        whole = np.concatenate([[0.0], np.cumsum(square)])
        inside = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, square, 0.0))])
        share = (inside[end] - inside[begin]) / np.maximum(whole[end] - whole[begin], 1e-9)
        near = np.flatnonzero(share >= COSINE**2)
        for lo in range(0, len(near), _CHUNK):
            at = near[lo : lo + _CHUNK]
            cosine = space.project(term, begin[at], end[at]) @ self.latent.T
            row, passage = np.nonzero(cosine * np.sqrt(share[at])[:, None] >= COSINE)
            yield from zip(begin[at[row]].tolist(), self.owner[passage].tolist())

    def matches(self, space: Space, words: Words) -> dict:
        """(text index, item index) -> best shares of item and answer."""
        found: dict = {}
        tried = set()
        for begin, owner in self.candidates(space, words):
            if (begin, owner) in tried:
                continue
            tried.add((begin, owner))
            doc, item = int(words.doc[begin]), self.items[owner]
            if found.get((doc, owner)) == (1.0, 1.0):
                continue
            lo = max(begin - item.size, words.first[doc])
            hi = min(begin + PASSAGE + item.size, words.first[doc + 1])
            result = item.check([words.word(i) for i in range(lo, hi)])
            if result and result > found.get((doc, owner), (0.0, 0.0)):
                found[doc, owner] = result
        return found


def _fitted(docs: DataFrame, items: DataFrame, sample: int | None = None, stage_passages: bool = False) -> Space:
    """The space of all passages of items and documents, or of about ``sample`` of the latter."""
    keys = items.select("text").mapInArrow(_word_keys, "key long").distinct().collect()  # words of the benchmark
    vocabulary = np.sort(np.array([r["key"] for r in keys], np.int64).view(np.uint64))
    text = docs.select("text")
    counts = {
        r["term"]: r["n"]
        for r in text.mapInArrow(_document_frequencies(vocabulary), "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .collect()  # one row per term of the benchmark
    }
    frequency = np.array([counts.get(t, 0) for t in range(len(vocabulary))], float)
    idf = np.log((max(text.count(), 1) + 1) / (frequency + 1)) + 0.1
    if not len(vocabulary):
        return Space(vocabulary, frequency, idf, np.zeros((0, 1), np.float32))

    def passages(rows: DataFrame, share: float, weight: float) -> DataFrame:
        terms = rows.mapInArrow(_sampled(vocabulary, share), "terms array<int>")
        return terms.withColumn("weight", F.lit(weight))

    n_passages = max(counts.get(-1, 0), 1)
    share, weight = (1.0, min(DOCUMENT_MASS / n_passages, 1.0) ** 0.5) if sample is None else (sample / n_passages, 1.0)
    some = passages(docs.select(F.xxhash64("doc_id"), "text"), share, weight)
    every = passages(items.select(F.xxhash64("item_id"), "text"), 1.0, BENCHMARK_WEIGHT)
    weighted = some.unionByName(every)
    if stage_passages:
        weighted = staged(weighted)
    return Space(vocabulary, frequency, idf, singular_vectors(weighted, idf))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    sample: int | None = None,
    block: int = BLOCK,
    stage_passages: bool = False,
) -> DataFrame:
    """doc_id, item_id, matched, answer: the items that each row of ``docs`` holds.

    ``stage_passages`` writes the passages' terms before their pairs are summed, so that no
    task has two Python workers at once.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind, item_kind = (d.schema[0].dataType.simpleString() for d in (chosen, items))
    n_blocks = max(-(-items.count() // block), 1)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    context = chosen.sparkSession.sparkContext
    space = _fitted(chosen, items, sample, stage_passages)
    shared_space, found = context.broadcast(space), None
    for b in range(n_blocks):
        index = Index(space, items.filter(key == b).collect())  # about ``block`` rows
        shared = context.broadcast(index)

        def searched(batches, shared=shared):
            space, index = shared_space.value, shared.value
            for batch in batches:
                text = filled(batch.column(1))
                for lo, hi in slices(text):
                    matches = index.matches(space, Words(text.slice(lo, hi - lo)))
                    docs_at = pa.array([lo + d for d, _ in matches], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(docs_at),
                            pa.array([index.items[i].item_id for _, i in matches], item_type),
                            pa.array([round(m, 6) for m, _ in matches.values()], pa.float64()),
                            pa.array([round(a, 6) for _, a in matches.values()], pa.float64()),
                        ],
                        ["doc_id", "item_id", "matched", "answer"],
                    )

        part = chosen.mapInArrow(searched, f"doc_id {kind}, item_id {item_kind}, matched double, answer double")
        found = part if found is None else found.unionByName(part)
    return found
