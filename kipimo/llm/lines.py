"""Line dedup within one word edit, by deletion neighbourhoods.

A line of at least ``min_words`` words is removed if an earlier line of any document
(by doc_id, then line number) can be made from it by at most one edit: a word put in,
taken out or replaced.  Shorter lines of at least ``exact_words`` words, by default all
with a word, are removed if an earlier line has the same words.  White space within a line
does not count.

1. Lines become keys (their words' hash); each distinct line keeps its first place.
2. One edit leaves one half of a line as it is.  Lines that share neither half with
   another line cannot be within the bound and need no variants.
3. *Deletion neighbourhood.*  Every other line but the shorter ones emits itself and
   itself without each one of its words, as hashed keys.  Equal keys meet: a whole line with a deletion (one is
   the other and a word), two deletions at the same place (one word replaced).  Per key
   only the earliest line is taken, so no pairs are made, however many lines meet.
4. Each line's earliest neighbour is compared with it word by word before it counts.

Only keys and places are shuffled, and the texts that lose lines; everything is
pre-aggregated by key, and a hot key is one row per task there.  The bit tables that
are broadcast have a fixed size.

Defined cases: null and empty texts have no lines and stay as they are; equal places
(repeated rows of one doc_id) do not remove each other; a null doc_id is earlier than
all others; an empty table gives an empty result; other columns come through in the
struct ``doc``, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .idfilter import HashFilter, IdFilter, slots
from .textblock import TextBlock, filled, mixed, slices

MIN_WORDS = 6
EXACT_WORDS = 1
SEEN = 300_000
_NULL = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Lines:
    """The lines of some texts that have enough words.

    For each: ``doc`` (text index), ``number`` in its text, ``size`` in words, ``key``.
    """

    def __init__(self, column: pa.Array, min_words: int):
        block = TextBlock.of(column)
        cut = np.union1d(np.flatnonzero(block.data == 10), block.text_at[1:] - 1)
        of_word = np.searchsorted(cut, block.start)
        count = np.bincount(of_word, minlength=len(cut))
        begin = np.cumsum(count) - count
        chosen = np.flatnonzero(count >= min_words)
        self.block, self.begin, self.size = block, begin[chosen], count[chosen].astype(np.int64)
        self.doc = np.searchsorted(block.text_at, cut[chosen], "right") - 1
        self.number = chosen - np.searchsorted(cut, block.text_at[self.doc])
        words = block.hashes()
        n = int(self.size.max(initial=0)) + 1
        self.up, self.down = _powers(_BASE, n), _powers(_BACK, n)
        place = np.arange(len(words)) - begin[of_word] if len(words) else np.zeros(0, np.int64)
        value = words * self.up[np.minimum(place, n - 1)]  # short lines' values are not used
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
        self.total = self.sums[self.begin + self.size] - self.sums[self.begin]
        self.key = mixed(self.total).view(np.int64)

    def ahead(self, k: np.ndarray) -> np.ndarray:
        """Hash of the first k words of each line."""
        return self.sums[self.begin + k] - self.sums[self.begin]

    def halves(self) -> np.ndarray:
        """Keys of the halves that a line shares with any line within one edit (rows)."""
        out = []
        for n in (self.size, self.size - 1):
            k = n // 2
            rest = n - k  # words in the second half
            tail = (self.total - self.ahead(self.size - rest)) * self.down[self.size - rest]
            out += [mixed(self.ahead(k) + k.astype(_U)), mixed(~tail + rest.astype(_U))]
        return np.stack(out, 1).view(np.int64)

    def variants(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line index, deleted place or -1, key) of the chosen lines and their deletions."""
        size = self.size[chosen]
        line = np.repeat(chosen, size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        at = self.begin[line] + place
        before = self.sums[at] - self.sums[self.begin[line]]
        behind = self.sums[self.begin[line] + self.size[line]] - self.sums[at + 1]
        shorter = mixed(before + behind * _U(_BACK))
        return (
            np.concatenate([chosen, line]),
            np.concatenate([np.full(len(chosen), -1), place]),
            np.concatenate([mixed(self.total[chosen]), shorter]).view(np.int64),
        )

    def text(self, i: int) -> str:
        """Line i with single spaces."""
        b, lo = self.block, self.begin[i]
        return b" ".join(b.data[b.start[lo] : b.end[lo + self.size[i] - 1]].tobytes().split()).decode()


class _Seen:
    """Picks each key once; forgets all when it holds too many."""

    def __init__(self):
        self.keys: set[int] = set()

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > SEEN:
            self.keys.clear()
        out = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in self.keys:
                self.keys.add(k)
                out[i] = True
        return out


def _sliced(batches, min_words: int):
    """(ids, rows, lines) of slices of batches with the columns id, row, text."""
    for batch in batches:
        text = filled(batch.column(2))
        for lo, hi in slices(text):
            n = hi - lo
            yield batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), Lines(text.slice(lo, n), min_words)


def _occurrences(min_words: int, exact_words: int):
    def rows(batches):
        seen = _Seen()
        for ids, row, lines in _sliced(batches, exact_words):
            at = pa.array(lines.doc)
            halves = lines.halves()
            fresh = lines.size >= min_words
            fresh[fresh] = seen.fresh(lines.key[fresh])
            begin = np.concatenate([[0], np.cumsum(np.where(fresh, 4, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(halves[fresh].ravel()))
            columns = [ids.take(at), row.take(at), pa.array(lines.number, pa.int64()), pa.array(lines.key), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "key", "halves"])

    return rows


def _variant_rows(min_words: int, shared):
    """Candidate lines and their deletions; the whole lines with their text."""

    def rows(batches):
        seen, taken = _Seen(), shared.value
        for _, _, lines in _sliced(batches, min_words):
            wanted = taken[slots(lines.key)].astype(bool)
            chosen = np.flatnonzero(wanted)
            chosen = chosen[seen.fresh(lines.key[chosen])]
            line, place, variant = lines.variants(chosen)
            texts = pa.array([lines.text(i) for i in chosen], pa.string())
            texts = pa.concat_arrays([texts, pa.nulls(len(line) - len(chosen), pa.string())])
            columns = [pa.array(variant), pa.array(place, pa.int32()), pa.array(lines.key[line]), texts]
            yield pa.RecordBatch.from_arrays(columns, ["variant", "place", "key", "text"])

    return rows


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether at most one word put in, taken out or replaced makes b from a."""
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - head - tail <= 1


def _verified(batches):
    for batch in batches:
        pairs = zip(batch.column("text").to_pylist(), batch.column("other").to_pylist())
        keep = pa.array([within_one_edit(a.split(" "), b.split(" ")) for a, b in pairs], pa.bool_())
        yield batch.select(["key", "first"]).filter(keep)


def earliest_neighbours(docs: DataFrame, occurrences: DataFrame, min_words: int) -> DataFrame:
    """key, first: the earliest place of each line within one edit of it, itself included."""
    place = F.struct("id", "line")
    firsts = staged(occurrences.groupBy("key").agg(F.min(place).alias("first"), F.max(F.size("halves")).alias("_")).drop("_"))
    halves = occurrences.select("key", F.explode("halves").alias("half"))
    open_halves = (
        halves.groupBy("half")
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        .filter(F.col("lo") < F.col("hi"))
        .select("half")
    )
    candidates = HashFilter(halves.join(open_halves, "half").select("key").distinct(), "key")
    made = staged(docs.mapInArrow(_variant_rows(min_words, candidates.shared), "variant long, place int, key long, text string"))
    variants = made.drop("text")
    meeting = (
        variants.groupBy("variant")
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        .filter(F.col("lo") < F.col("hi"))
        .select("variant")
    )
    met = staged(variants.join(meeting, "variant").join(firsts, "key"))
    earliest = F.min(F.struct("first", F.col("key").alias("other"))).alias("best")
    by_place = met.groupBy("variant", "place").agg(earliest)
    whole = by_place.filter(F.col("place") < 0).select("variant", "best")
    shorter = by_place.filter(F.col("place") >= 0).groupBy("variant").agg(F.min("best").alias("best"))
    lines = met.select("variant", "place", "key")
    neighbours = (
        lines.join(by_place, ["variant", "place"])
        .select("key", "best")
        .unionByName(lines.filter(F.col("place") >= 0).join(whole, "variant").select("key", "best"))
        .unionByName(lines.filter(F.col("place") < 0).join(shorter, "variant").select("key", "best"))
        .groupBy("key")
        .agg(F.min("best").alias("best"))
        .select("key", "best.first", "best.other")
        .filter(F.col("key") != F.col("other"))
    )
    pairs = staged(neighbours)
    named = pairs.select("key").unionByName(pairs.select(F.col("other").alias("key"))).distinct()
    whole_lines = made.filter(F.col("place") < 0).select("key", "text")
    texts = staged(whole_lines.join(named, "key").groupBy("key").agg(F.min("text").alias("text")))
    others = texts.select(F.col("key").alias("other"), F.col("text").alias("text_other"))
    verified = (
        pairs.join(texts, "key")
        .join(others, "other")
        .select("key", "first", "text", F.col("text_other").alias("other"))
        .mapInArrow(_verified, pairs.select("key", "first").schema)
        .select("key", F.col("first").alias("near"))
    )
    return firsts.join(verified, "key", "left").select("key", F.least("first", F.coalesce("near", "first")).alias("first"))


def _kept(text_col: str):
    def kept(batches):
        for batch in batches:
            text = batch.column(0).field(text_col)
            for lo, hi in slices(filled(text)):
                part = batch.slice(lo, hi - lo)
                texts, totals, removed = [], [], []
                for text_of, gone in zip(text.slice(lo, hi - lo).to_pylist(), part.column(1).to_pylist()):
                    lines = text_of.split("\n") if text_of else []
                    out = set(gone or ())
                    stay = [x for i, x in enumerate(lines) if i not in out]
                    totals.append(len(lines))
                    removed.append(len(lines) - len(stay))
                    texts.append("\n".join(stay) if out else text_of)
                arrays = [
                    part.column(0),
                    pa.array(totals, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_lines", "n_removed", "kept"])

    return kept


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    exact_words: int = EXACT_WORDS,
) -> DataFrame:
    """doc (the row as it was), n_lines, n_removed, kept (the text that stays).

    One row per row of ``docs``.
    """
    least = max(min(exact_words, min_words), 1)
    key = [
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"),
        F.xxhash64(F.col(text_col)).alias("row"),
    ]
    texts = docs.select(*key, F.col(text_col).alias("text"))
    keyed = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    occurrences = staged(
        texts.mapInArrow(_occurrences(min_words, least), "id long, row long, line long, key long, halves array<long>")
    )
    first = earliest_neighbours(texts, occurrences, min_words)
    gone = staged(
        occurrences.join(first, "key")
        .filter(F.col("first") < F.struct("id", "line"))
        .groupBy("id", "row")  # one text's lines
        .agg(F.collect_set("line").alias("gone"))
    )
    touched = IdFilter(gone, "id", "row")
    joined = touched.rows(keyed, "id", "row").join(gone, ["id", "row"], "left").select("doc", "gone")
    kind = keyed.schema["doc"].dataType.simpleString()
    changed = joined.mapInArrow(_kept(text_col), f"doc {kind}, n_lines long, n_removed long, kept string")
    text = F.col("doc")[text_col]
    rest = touched.rows(keyed, "id", "row", found=False).select(
        "doc",
        F.when(text != "", F.size(F.split(text, "\n"))).otherwise(0).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_removed"),
        text.alias("kept"),
    )
    return changed.unionByName(rest)


#: The same lines by all deletions of all lines of six words or more; {documents} is the table's name.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM {documents} WHERE coalesce(text, '') <> ''
), occ AS (
  SELECT doc_id, line, array_to_string(w, ' ') AS l, w
  FROM (SELECT doc_id, line, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS w FROM lines) WHERE len(w) >= 1
), firsts AS (
  SELECT l, any_value(w) AS w, min({{'d': doc_id, 'n': line}}) AS pos FROM occ GROUP BY l
), long AS (
  SELECT * FROM firsts WHERE len(w) >= 6
), shorter AS (
  SELECT l, pos, i, array_to_string(w[1 : i - 1], ' ') || chr(10) || array_to_string(w[i + 1 :], ' ') AS place_key,
         array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS k
  FROM (SELECT l, pos, w, unnest(range(1, len(w) + 1)) AS i FROM long)
), near AS (
  SELECT l, pos FROM firsts
  UNION ALL
  SELECT a.l, min(b.pos) FROM shorter a JOIN shorter b ON a.place_key = b.place_key AND a.i = b.i GROUP BY a.l
  UNION ALL
  SELECT a.l, min(b.pos) FROM shorter a JOIN long b ON a.k = b.l GROUP BY a.l
  UNION ALL
  SELECT a.l, min(b.pos) FROM long a JOIN shorter b ON a.l = b.k GROUP BY a.l
), best AS (
  SELECT l, min(pos) AS pos FROM near GROUP BY l
), gone AS (
  SELECT doc_id, line FROM occ JOIN best USING (l) WHERE pos < {{'d': doc_id, 'n': line}}
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM {documents} d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS r FROM gone GROUP BY doc_id) USING (doc_id)
LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) AS t FROM lines
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = lines.doc_id AND gone.line = lines.line)
  GROUP BY doc_id
) USING (doc_id)
"""
