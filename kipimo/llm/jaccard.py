"""Exact join of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric; sets at distance 0.2 or less are to be linked.

1. Equal sets become one class before anything else, whatever their number.
2. *Pivots and regions.*  Pivots are the singletons {shingle}, in one fixed order: rare
   shingles first (by a count sketch of all documents), then by hash.  A set's nearest
   pivots are its own shingles, and the first of them is its Voronoi region.
3. *Windows.*  A set of n shingles within the distance must hold one of the first
   n - ceil(0.8 n) + 1, so a class is replicated to those regions and no others.  If the
   first shingle of a pair is at place i of one set, the other has at most
   ``reach`` = 1.25 n - 2.25 i shingles; so a pair is possible only in regions where each
   size is within the other's reach.  Towards the empty set as a pivot, regions are cut
   into rings of sizes that differ by a factor of 1.25; a class is replicated to the next
   ring only if its reach gets there.  Regions with one class, or without one that
   reaches its own size, are dropped.
4. *Rounds.*  In a round every class is compared with one of its regions' two leaders
   (the one with the longest reach, and one by hash) of another component.  The links
   found are contracted into components, and regions whose classes are in one component
   by then are finished, which is where large groups of near copies end.  A round that
   links less than one in ``FRUITFUL`` of its pairs is the last.
5. *Recursion.*  A region left with more than ``LEAF`` classes is cut by document pivots
   of its own: a class goes to its nearest pivot and to every pivot that is farther by at
   most twice its largest distance to a partner, distances being those of the counts in
   256 cells of the shingle space (at most the symmetric difference).  Cut regions are cut
   again as long as that halves the possible pairs.  In the regions that remain, which
   are dealt into blocks if they are larger, the classes of different components within
   each other's reach are compared by cells where they lie; only pairs within the distance
   by cells leave a task.  Large sets have more cells, which are folded for smaller ones.
   Those pairs are compared, and contracted again.

Document pivots are not used for the first level: unrelated texts are all at distance 1
from each other, where every window reaches every region.

Nothing is dropped: every pair within the distance shares a region, and is compared
unless its classes are connected already.  Sets are compared shingle by shingle from
the texts, which are read by the pairs' documents only.  The sketch (16 MB) and the bit
table (1 MB) that are broadcast have a fixed size.  A hot region is one row per task in
the aggregations and split by adaptive skew handling in the joins.

Defined cases: null and empty texts, or texts without words, have no shingles and link
with nothing; fewer than five words are one shingle; rows with the same doc_id are
documents of their own; a null doc_id never names a component that has another id; an
empty table gives an empty result; other columns are not read.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .components import components
from .idfilter import HashFilter, IdFilter, slots
from .textblock import TextBlock, filled, in_order, mixed, slices, windows

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
SKETCH_BITS = 24
SKETCH_PART = 1 << 15
COUNTED = 1 << 20
CELLS, MOST_CELLS = 256, 4096
ROUNDS = 3
FRUITFUL = 2
LEAF = 64
PIVOTS = 8
KEPT = 500_000
_NULL = -(1 << 63)
_RING = np.uint64(0x9E3779B97F4A7C15)


def _occurrences(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle key) of all places of all texts, longer texts first."""
    block = TextBlock.of(column, lower=True)
    words = block.hashes()
    key, at = windows(words, block.doc, k)
    doc = block.doc[at]
    counts = block.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = block.first_word()
        places = np.arange(3, 2 * k + 3, 2, dtype=np.uint64)
        sums = [(words[first[i] : first[i + 1]] * places[: counts[i]]).sum(dtype=np.uint64) for i in short]
        whole = mixed(np.array(sums, np.uint64) + counts[short].astype(np.uint64))
        key, doc = np.concatenate([key, whole]), np.concatenate([doc, short])
    return doc, key


def _shingles(column: pa.Array, k: int = WORDS) -> np.ndarray:
    return _occurrences(column, k)[1]


def shingle_sets(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle key) of all texts' sets, ordered by both."""
    doc, key = _occurrences(column, k)
    order, again = in_order(doc, key)
    order = order[~again]
    return doc[order], key[order]


def _set_rows(batches, make):
    for batch in batches:
        text = filled(batch.column(1))
        for lo, hi in slices(text):
            doc, key = shingle_sets(text.slice(lo, hi - lo))
            yield make(batch.column(0).slice(lo, hi - lo), hi - lo, doc, key)


def _sketches(batches):
    total = np.zeros(1 << SKETCH_BITS, np.uint16)
    shift = np.uint64(64 - SKETCH_BITS)
    held, n_held = [], 0

    def count():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        total[cell] = np.minimum(total[cell] + n, 65535)

    for batch in batches:
        text = filled(batch.column(0))
        for lo, hi in slices(text):
            held.append(_shingles(text.slice(lo, hi - lo)) >> shift)
            n_held += len(held[-1])
            if n_held > COUNTED:
                count()
                held, n_held = [], 0
    if n_held:
        count()
    if total.any():
        for p, counts in enumerate(total.reshape(-1, SKETCH_PART)):
            kind = np.uint8 if counts.max() < 256 else np.uint16  # most tasks see few of each
            packed = zlib.compress(counts.astype(kind).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = zlib.decompress(counts)
            own = np.frombuffer(counts, np.uint8 if len(counts) == SKETCH_PART else np.uint16)
            sums[part] = sums.get(part, 0) + own.astype(np.int64)
    for part, total in sums.items():
        level = np.round(4 * np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "levels"]
        )


def rarity(docs: DataFrame) -> np.ndarray:
    """Logarithmic counts of the shingles in each cell of a sketch of fixed size."""
    rows = (
        docs.select("text")
        .mapInArrow(_sketches, "part int, counts binary")
        .repartition("part")
        .mapInArrow(_summed, "part int, levels binary")
        .collect()  # 2 ** SKETCH_BITS bytes in all
    )
    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_PART, SKETCH_PART), np.uint8)
    for row in rows:
        out[row["part"]] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return out.ravel()


def _class_keys(n_texts: int, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and a key of each whole set."""
    size = np.bincount(doc, minlength=n_texts)
    total = np.zeros(n_texts, np.uint64)
    if len(key):
        begin = np.searchsorted(doc, np.flatnonzero(size))
        total[size > 0] = np.add.reduceat(mixed(key), begin)
    return size, mixed(total + size.astype(np.uint64)).view(np.int64)


def _fresh(seen: set[int], cls: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One text of each class; a task that has seen many classes starts anew."""
    if len(seen) > KEPT:
        seen.clear()
    out = np.zeros(len(cls), bool)
    for i, c in enumerate(cls.tolist()):
        if size[i] and c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _prefixes(doc, key, size, level):
    """(offsets, shingles) of each set's window, in the order of the pivots."""
    order = np.lexsort((key, level, doc))
    begin = np.cumsum(size) - size
    place = np.arange(len(doc)) - begin[doc]
    window = np.where(size > 0, size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1, 0)
    chosen = key[order[place < window[doc]]]
    return np.concatenate([[0], np.cumsum(window)]), chosen.view(np.int64)


def _widths(size: np.ndarray) -> np.ndarray:
    """Number of cells of sets: a power of two, an eighth of the set or more up to ``MOST_CELLS``."""
    wanted = np.ceil(np.log2(np.maximum(size, 1) / (8 * CELLS))).astype(np.int64)
    return CELLS << np.clip(wanted, 0, int(math.log2(MOST_CELLS // CELLS)))


def _members(shared):
    shift = np.uint64(64 - SKETCH_BITS)

    def rows(batches):
        seen: set[int] = set()

        def make(ids, n, doc, key):
            size, cls = _class_keys(n, doc, key)
            new = _fresh(seen, cls, size)
            stay = new[doc]
            doc, key = doc[stay], key[stay]
            held = np.where(new, size, 0)
            ends, chosen = _prefixes(doc, key, held, shared.value[(key >> shift).astype(np.int64)])
            width = np.where(new, _widths(size), 0)
            at = np.cumsum(width) - width
            cells = np.bincount(at[doc] + (key % width[doc].astype(np.uint64)).astype(np.int64), minlength=width.sum())
            raw = np.minimum(cells, 255).astype(np.uint8).tobytes()
            arrays = [
                ids,
                pa.array(size),
                pa.array(cls),
                pa.array([raw[i : i + w] if w else None for i, w in zip(at.tolist(), width.tolist())], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen)),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["id", "n", "cls", "cells", "prefix"])

        return _set_rows(batches, make)

    return rows


def _region_rows(shared=None):
    """Rows of classes with their prefixes, spread over their regions; only those of taken slots, if given."""

    def ring(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(size) / math.log(DENOMINATOR / NUMERATOR)).astype(np.int64)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cls, n, prefix = batch.slice(at, 256).columns
                length = pc.list_value_length(prefix).to_numpy()
                row = np.repeat(np.arange(len(cls)), length)
                place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                pivot = prefix.flatten().to_numpy().view(np.uint64)
                size = n.to_numpy()[row]
                reach = (DENOMINATOR * size - (DENOMINATOR + NUMERATOR) * place) // NUMERATOR
                own, last = ring(size), ring(np.maximum(size, reach))
                for step in range(int((last - own).max(initial=-1)) + 1):
                    held = np.flatnonzero(own + step <= last)
                    key = mixed(pivot[held] + (own[held] + step + 1).astype(np.uint64) * _RING).view(np.int64)
                    if shared is not None:
                        taken = shared.value[slots(key)].astype(bool)
                        held, key = held[taken], key[taken]
                    columns = [pa.array(key), cls.take(pa.array(row[held])), pa.array(size[held]), pa.array(reach[held])]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "cls", "n", "reach"])

    return rows


def _regions(classes: DataFrame) -> DataFrame:
    """h, cls, n, reach: the classes of each ring of each pivot that may hold a pair."""
    kinds = "h long, cls long, n long, reach long"
    prefixes = classes.select("cls", "n", "prefix")
    rows = prefixes.mapInArrow(_region_rows(), kinds)
    # a class has one row in a region; counts take half the room of its least and greatest key
    spans = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("reach") >= F.col("n")).alias("pairs"))
    shared = staged(spans.filter((F.col("k") > 1) & F.col("pairs")).select("h"))
    return staged(prefixes.mapInArrow(_region_rows(HashFilter(shared, "h").shared), kinds).join(shared, "h"))


def _counts(column: list[bytes], width: int) -> np.ndarray:
    """Each set's counts in ``width`` cells; those of more cells are folded."""
    out = np.empty((len(column), width), np.int16)
    length = np.array([len(c) for c in column], np.int64)
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        raw = np.frombuffer(b"".join([column[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, width)
        out[at] = raw[:, 0] if size == width else np.minimum(raw.sum(1, dtype=np.int64), 255)
    return out


class _Cells:
    """Which pairs of some sets the triangle inequalities allow."""

    def __init__(self, size: np.ndarray, cells: list[bytes]):
        self.size, self.cells, self.few = size, cells, _counts(cells, CELLS)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = DENOMINATOR * np.minimum(self.size[a], self.size[b]) >= NUMERATOR * np.maximum(self.size[a], self.size[b])
        for at in np.array_split(np.flatnonzero(keep), max(int(keep.sum()) // 4096, 1)):
            keep[at] = self._within(self.few[a[at]], self.few[b[at]], a[at], b[at])
        for i in np.flatnonzero(keep).tolist():  # few are left; large sets differ in more cells
            pair = [self.cells[a[i]], self.cells[b[i]]]
            width = min(map(len, pair))
            if width > CELLS:
                one, two = _counts(pair, width)
                keep[i] = self._within(one[None], two[None], a[i : i + 1], b[i : i + 1])[0]
        return keep

    def _within(self, one, two, a, b) -> np.ndarray:
        at_least = np.abs(one - two).sum(1, dtype=np.int64)
        # similar: the symmetric difference is at most (1 - t) / (1 + t) of both sizes
        return (DENOMINATOR + NUMERATOR) * at_least <= (DENOMINATOR - NUMERATOR) * (self.size[a] + self.size[b])


def _near(batches):
    for batch in batches:
        n = batch.num_rows
        cells = _Cells(
            np.concatenate([batch.column(i).to_numpy() for i in (2, 4)]),
            batch.column(3).to_pylist() + batch.column(5).to_pylist(),
        )
        kept = batch.filter(pa.array(cells.allowed(np.arange(n), np.arange(n, 2 * n))))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    return wide.select("a", "b", "n_a", "cells_a", "n_b", "cells_b").mapInArrow(_near, "a long, b long")


def _compared(batches):
    for batch in batches:
        left, right = filled(batch.column(2)), filled(batch.column(3))
        for lo, hi in slices(left):
            n = hi - lo
            doc_a, key_a = shingle_sets(left.slice(lo, n))
            doc_b, key_b = shingle_sets(right.slice(lo, n))
            doc = np.concatenate([doc_a, doc_b])
            order, again = in_order(doc, np.concatenate([key_a, key_b]))
            common = np.bincount(doc[order[again]], minlength=n)
            union = np.bincount(doc, minlength=n) - common
            keep = pa.array((DENOMINATOR * common >= NUMERATOR * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, n).filter(keep) for i in (0, 1)], ["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of classes that are similar, compared by their documents' texts."""
    pairs = staged(pairs)
    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = staged(classes.join(nodes, "cls").select("cls", F.col("doc").alias("id"), "row"))
    texts = IdFilter(named, "id", "row").rows(docs, "id", "row").join(named, ["id", "row"]).dropDuplicates(["cls"])
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return staged(wide.mapInArrow(_compared, "a long, b long"))


def _reachable(n_a, reach_a, n_b, reach_b):
    """Whether two classes of a region are within each other's reach."""
    return (n_a <= reach_b) & (n_b <= reach_a)


def _open_regions(regions: DataFrame, found: DataFrame | None) -> DataFrame:
    """h, cls, n, reach, comp of the regions whose classes are in several components."""
    labelled = regions.withColumn("comp", F.col("cls"))
    if found is not None:
        labels = found.select(F.col("node").alias("cls"), F.col("comp").alias("c"))
        labelled = regions.join(labels, "cls", "left").withColumn("comp", F.coalesce("c", "cls")).drop("c")
    spans = labelled.groupBy("h").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("most")
    )
    spans = spans.filter(F.col("lo") < F.col("hi")).select("h", "least", "most")
    within = (F.col("n") <= F.col("most")) & (F.col("least") <= F.col("reach"))
    return staged(labelled.join(spans, "h").filter(within).select("h", "cls", "n", "reach", "comp"))


def _leader_pairs(labelled: DataFrame, number: int) -> DataFrame:
    """At most one pair for each class: with a leader of another component."""
    by_hash = F.xxhash64(F.col("cls"), F.lit(number)).alias("r")
    farthest = F.struct((F.col("reach") / F.col("n")).alias("far"), by_hash, "cls", "n", "reach", "comp")
    leaders = labelled.groupBy("h").agg(
        F.max(farthest).alias("one"), F.min(F.struct(by_hash, "cls", "n", "reach", "comp")).alias("two")
    )
    fits = lambda c: (F.col("comp") != F.col(f"{c}.comp")) & _reachable(
        F.col("n"), F.col("reach"), F.col(f"{c}.n"), F.col(f"{c}.reach")
    )
    other = F.when(fits("one"), F.col("one.cls")).when(fits("two"), F.col("two.cls"))
    return (
        labelled.join(leaders, "h")
        .select("cls", other.alias("leader"))
        .filter("leader is not null")
        .groupBy("cls", "leader")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("cls")
        .agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))
        .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
        .distinct()
    )


def _cut(batches):
    """Rows of regions, sent to their nearest pivot and to the pivots of their window."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            h = part.column(0).to_numpy().view(np.uint64)
            n, reach = part.column(2).to_numpy(), part.column(3).to_numpy()
            own = _counts(part.column(5).to_pylist(), CELLS)
            lists = part.column(6).to_pylist()
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pivot = np.concatenate([np.arange(len(x)) for x in lists])
            far = np.abs(own[row] - _counts([c for x in lists for c in x], CELLS)).sum(1, dtype=np.int64)
            nearest = np.minimum.reduceat(far, np.searchsorted(row, np.arange(len(lists))))
            # a partner has at most ``reach`` shingles, so this is the largest symmetric difference
            window = 2 * (DENOMINATOR - NUMERATOR) * (n + reach) // (DENOMINATOR + NUMERATOR) + 1
            keep = far <= (nearest + window)[row]
            row, pivot = row[keep], pivot[keep]
            sub = mixed(h[row] + (pivot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            sent = part.take(pa.array(row)).select([0, 1, 2, 3, 4])
            yield pa.RecordBatch.from_arrays(
                [*sent.columns, pa.array(sub.view(np.int64))], ["h", "cls", "n", "reach", "comp", "sub"]
            )


def _cut_regions(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The same table with regions above ``LEAF`` classes cut by pivots of their own.

    A cut counts only if it halves the squares of the sizes, so it ends after a number of
    levels that is logarithmic in the largest region; a region that no pivots part stays
    whole, and its pairs are found by reach alone.
    """
    cells = classes.select("cls", "cells")
    columns = ["h", "cls", "n", "reach", "comp"]
    whole = []
    level = 0
    while True:
        large = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LEAF))
        if large.isEmpty():
            break
        whole.append(rows.join(large, "h", "left_anti"))
        above = staged(rows.join(large, "h").join(cells, "cls").select(*columns, "cells"))
        pivots = (
            above.groupBy("h", F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(PIVOTS)).alias("p"))
            .agg(F.min(F.struct("cls", "cells")).alias("pivot"))
            .groupBy("h")
            .agg(F.collect_list("pivot.cells").alias("pivots"))  # PIVOTS at most
        )
        cut = staged(
            above.join(pivots, "h")
            .select(*columns, "cells", "pivots")
            .mapInArrow(_cut, "h long, cls long, n long, reach long, comp long, sub long")
        )
        sizes = cut.groupBy("h", "sub").agg(F.count(F.lit(1)).alias("s"))
        squares = sizes.groupBy("h").agg(F.sum(F.col("s") * F.col("s")).alias("squares")).join(large, "h")
        parted = staged(squares.filter(2 * F.col("squares") <= F.col("k") * F.col("k")).select("h"))
        whole.append(above.join(parted, "h", "left_anti").select(*columns))
        rows = cut.join(parted, "h").select(F.col("sub").alias("h"), *columns[1:])
        level += 1
    for part in whole:
        rows = rows.unionByName(part)
    return rows


def _region_pairs(batches):
    """Allowed pairs of each group of rows with one ``g``, which follow each other."""
    rest = None
    for batch in batches:
        batch = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks().to_batches()
        if not batch:
            continue
        batch = batch[0]
        g = batch.column(0).to_numpy()
        last = int(np.searchsorted(g, g[-1]))  # the last group may go on
        rest = batch.slice(last)
        yield from _grouped_pairs(batch.slice(0, last))
    if rest is not None:
        yield from _grouped_pairs(rest)


def _grouped_pairs(batch):
    if not batch.num_rows:
        return
    g, side, cls, n, reach, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
    cells = _Cells(n, batch.column(6).to_pylist())
    at, lag = np.arange(len(g)), 1
    while True:
        at = at[at < len(g) - lag]
        at = at[g[at] == g[at + lag]]
        if not len(at):
            return
        a, b = at, at + lag
        possible = (comp[a] != comp[b]) & (n[a] <= reach[b]) & (n[b] <= reach[a])
        possible &= (side[a] < 0) | (side[a] != side[b])
        a, b = a[possible], b[possible]
        stay = cells.allowed(a, b)
        one, two = cls[a[stay]], cls[b[stay]]
        if len(one):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])
        lag += 1


def _remaining_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Allowed pairs of classes of different components within each other's reach in a region.

    They are found where a region's rows lie together with their cells.  A region of more
    than ``LEAF`` classes, which no pivots part, is dealt into blocks of about as many, and
    every two of its blocks meet on their own, so no group is large.
    """
    large = staged(rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("blocks")).filter(F.col("blocks") > 1))
    columns = ["g", "side", "cls", "n", "reach", "comp"]
    small = rows.join(large, "h", "left_anti").select(F.col("h").alias("g"), F.lit(-1).cast("long").alias("side"), *columns[2:])
    side = F.pmod(F.xxhash64("cls", F.lit(-1)), F.col("blocks"))
    dealt = (
        rows.join(large, "h")
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("g", F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other")))
        .withColumn("side", F.when(F.col("side") == F.col("other"), -1).otherwise(F.col("side")))
    )
    wide = small.unionByName(dealt.select(*columns)).join(classes.select("cls", "cells"), "cls").select(*columns, "cells")
    return wide.repartition("g").sortWithinPartitions("g").mapInArrow(_region_pairs, "a long, b long").distinct()


def _class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """comp of every class that has a link: cls, comp."""
    regions = _regions(classes)
    links, found = None, None
    for number in range(ROUNDS):
        pairs = staged(_leader_pairs(_open_regions(regions, found), number))
        round_links = _links(_allowed(pairs, classes), classes, docs)
        links = round_links if links is None else links.unionByName(round_links)
        found = components(links)
        if FRUITFUL * round_links.count() < pairs.count():
            break  # no large groups of near copies are left
    left = staged(_cut_regions(_open_regions(regions, found), classes))
    last = _links(_remaining_pairs(left, classes), classes, docs)
    return components(last if links is None else links.unionByName(last))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("row"),
    )
    keyed = rows.select(F.struct("id", "row").alias("id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(rarity(rows))
    kinds = "id struct<id: bigint, row: bigint>, n long, cls long, cells binary, prefix array<bigint>"
    members = staged(keyed.mapInArrow(_members(shared), kinds).select("id.*", "n", "cls", "cells", "prefix"))
    sets = members.filter(F.col("n") > 0)
    only = lambda c: F.first(c, ignorenulls=True).alias(c)
    # a task leaves cells and window out for classes that it has seen
    held = F.when(F.col("cells").isNotNull(), F.struct("cells", "prefix")).alias("held")
    classes = staged(
        sets.select("cls", "n", "id", "row", held)
        .groupBy("cls", "n")
        .agg(F.min(F.struct("id", "row")).alias("m"), only("held"))
        .select("cls", "n", F.col("m.id").alias("doc"), F.col("m.row").alias("row"), "held.cells", "held.prefix")
    )
    found = staged(_class_links(rows, classes))
    linked = members.select("id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(
        found.select(F.col("node").alias("cls"), "comp"), "cls", "left"
    )
    linked = linked.withColumn("comp", F.coalesce("comp", "cls"))
    named = F.when(F.col("id") != _NULL, F.col("id"))
    smallest = linked.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(named).alias("component_id"))
    return linked.join(smallest, "comp", "left").select(
        named.cast(kind).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("component_id"), named).cast(kind).alias("component_id"),
    )


#: The same components by all shared shingles; {documents} is the table's name.
SQL = """
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM {documents}
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM toks WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), smallest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM toks LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""
