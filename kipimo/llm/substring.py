"""Removal of long word sequences that an earlier document has, by suffix automata.

A window is ``span`` consecutive words.  A word goes if a window over it also starts in
a document with a smaller doc_id.

1. *Reference shards.*  Every window is represented by its minimizer, the word n-gram
   inside it with the lowest key; equal windows have equal minimizers.  Minimizers of
   one document only are dropped.  A minimizer's shard is the first document that has
   it, so text that was copied as a whole stays whole in one shard.
2. *Matching statistics.*  Within a shard, documents are streamed in ascending order of
   doc_id against the suffix automaton of what came before, following suffix links so
   that each word has its longest match (cut at ``span``, more is never asked).  Windows
   whose state was first reached by a smaller doc_id are removed; what is new goes into
   the automaton.
3. Step 2 runs twice, as an aggregation does: first over the documents that happen to
   lie in one task (with a bounded automaton that may forget), where a hot shard's
   copies shrink to what is new; then over what was left, dealt out by shard.

All documents are reference and stream alike, so broadcasting every shard to every task
would cost the product of both; a shard goes to the task that holds its documents
instead, and texts are read where they lie.  Shuffled are the minimizers (a sixth of the
words, pre-aggregated by key) and the texts that have shared ones; a fixed-size bit table
keeps other texts out of both joins.  A hot minimizer is one row per task in the
aggregation and is split by adaptive skew handling in the join.  The second automaton of
a shard holds the distinct texts around its shared minimizers.

Defined cases: null and empty texts have no words; fewer than ``span`` words are never
removed; windows of rows with the same doc_id do not remove each other; a null doc_id
counts as smaller than all others; repeated rows get equal results each; an empty table
gives an empty result; other columns are not read.
"""

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .idfilter import IdFilter
from .textblock import TextBlock, filled, slices, windows

SPAN, GRAM = 13, 4
LOCAL_WORDS = 60_000
_FEW_BYTES = 1 << 18
_LEAST = -(1 << 63)
_EMPTY = np.zeros(0, np.int64)


def _minimizers(block: TextBlock, span: int, gram: int):
    """Runs of windows with one minimizer: doc, key, first window (in its text), how many more."""
    key, at = windows(block.hashes(), block.doc, gram)
    reach = span - gram + 1
    n = len(key) - reach + 1
    if n <= 0:
        return _EMPTY, np.zeros(0, np.uint64), _EMPTY, _EMPTY
    inside = np.flatnonzero(block.doc[at[:n]] == block.doc[at[reach - 1 :]])
    low, place = key[inside], inside.copy()
    for j in range(1, reach):
        other = key[inside + j]
        less = other < low
        low[less] = other[less]
        place[less] = inside[less] + j
    if not len(inside):
        return _EMPTY, np.zeros(0, np.uint64), _EMPTY, _EMPTY
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(inside) != 1)]))
    size = np.diff(np.concatenate([begin, [len(inside)]]))
    word = at[inside[begin]]
    doc = block.doc[word]
    return doc, low[begin], word - block.first_word()[doc], size - 1


def _minimizer_rows(span: int, gram: int):
    names = ["h", "id", "row", "first", "more"]

    def rows(batches):
        for batch in batches:
            ids, row, text = batch.column(0), batch.column(1), filled(batch.column(2))
            for lo, hi in slices(text):
                block = TextBlock.of(text.slice(lo, hi - lo))
                doc, key, first, more = _minimizers(block, span, gram)
                at = pa.array(doc + lo)
                columns = [pa.array(key.view(np.int64)), ids.take(at), row.take(at), pa.array(first, pa.int32()), pa.array(more, pa.int8())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows


class Automaton:
    """The suffix automaton of several word sequences; 0 is no state, 1 the root."""

    def __init__(self, span: int):
        self.span = span
        self.follow, self.link, self.length, self.first = [{}, {}], [0, 0], [-1, 0], [0, 0]

    def _copy(self, p: int, c: bytes, q: int) -> int:
        copy = len(self.follow)
        self.follow.append(dict(self.follow[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.first.append(self.first[q])
        while p and self.follow[p].get(c) == q:
            self.follow[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        """Put in a sequence of a document that is no smaller than those before."""
        follow, link, length = self.follow, self.link, self.length
        last = 1
        for c in words:
            q = follow[last].get(c)
            if q:
                last = q if length[q] == length[last] + 1 else self._copy(last, c, q)
                continue
            now = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(1)
            self.first.append(doc)
            p = last
            while p and c not in follow[p]:
                follow[p][c] = now
                p = link[p]
            if p:
                q = follow[p][c]
                link[now] = q if length[q] == length[p] + 1 else self._copy(p, c, q)
            last = now

    def matched(self, words: list[bytes]) -> list[int | None]:
        """For each window: the document that first had it, or None."""
        follow, link, length, first, span = self.follow, self.link, self.length, self.first, self.span
        out, state, size = [], 1, 0
        for c in words:
            to = follow[state].get(c)
            while not to and state != 1:
                state = link[state]
                size = length[state]
                to = follow[state].get(c)
            if to:
                state, size = to, size + 1
                if size >= span:
                    size = span
                    while length[link[state]] >= span:
                        state = link[state]
            out.append(first[state] if size == span else None)
        return out[span - 1 :]


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    """First and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[0::2], edge[1::2])]


def _streamed(automaton: Automaton, pieces: list[tuple[int, list[bytes]]], doc: int):
    """Match one document's pieces, then put in what is new.

    Yields (first window, last window, removed) for all runs of windows.
    """
    span, fresh = automaton.span, []
    for first, words in pieces:
        found = automaton.matched(words)
        gone = [f is not None and f < doc for f in found]
        for a, b in _runs(gone):
            yield first + a, first + b, None
        for a, b in _runs([not g for g in gone]):
            yield first + a, first + b, words[a : b + span]
        fresh += [words[a : b + span] for a, b in _runs([f is None for f in found])]
    for words in fresh:
        automaton.add(words, doc)


_OUT = ["shard", "id", "row", "first", "last", "words"]
_OUT_SCHEMA = "shard long, id long, row long, first int, last int, words string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _OUT)


def _pieces(words: list[bytes], runs: list[dict], span: int) -> dict[int, list[tuple[int, list[bytes]]]]:
    """By shard: the stretches of a text whose windows belong to it."""
    out: dict[int, list] = {}
    for shard, group in groupby(sorted(runs, key=lambda r: (r["shard"], r["first"])), lambda r: r["shard"]):
        spans: list[list[int]] = []
        for r in group:
            if spans and r["first"] <= spans[-1][1] + 1:
                spans[-1][1] = r["first"] + r["more"]
            else:
                spans.append([r["first"], r["first"] + r["more"]])
        out[shard] = [(a, words[a : b + span]) for a, b in spans]
    return out


def _few(batches, column: int):
    """Batches cut by the bytes of a text column: their lists become Python objects."""
    for batch in batches:
        for lo, hi in slices(batch.column(column), _FEW_BYTES):
            yield batch.slice(lo, hi - lo)


def _local(span: int, local_words: int):
    def combined(batches):
        automata: dict[int, Automaton] = {}
        held = 0
        for batch in _few(batches, 2):
            rows = []
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                for shard, pieces in _pieces(words, row["runs"], span).items():
                    if held > local_words:
                        automata, held = {}, 0  # what is forgotten is left to the second pass
                    automaton = automata.setdefault(shard, Automaton(span))
                    before = len(automaton.follow)
                    for a, b, kept in _streamed(automaton, pieces, row["id"]):
                        rows.append((shard, row["id"], row["row"], a, b, b" ".join(kept).decode() if kept else None))
                    held += (len(automaton.follow) - before) // 2
                if len(rows) > 5_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return combined


def _final(span: int):
    def matched(batches):
        shard, automaton, doc, pieces = None, None, None, []
        rows: list[tuple] = []

        def finish():
            found: dict = {}
            for row, first, words in pieces:
                found.setdefault(row, []).append((first, words))
            for row, own in found.items():
                for a, b, kept in _streamed(automaton, own, doc):
                    if kept is None:
                        rows.append((shard, doc, row, a, b, None))

        for batch in _few(batches, 5):
            for row in batch.to_pylist():
                if (row["shard"], row["id"]) != (shard, doc):
                    if pieces:
                        finish()
                    if row["shard"] != shard:
                        shard, automaton = row["shard"], Automaton(span)
                    doc, pieces = row["id"], []
                pieces.append((row["row"], row["first"], row["words"].encode().split()))
            if len(rows) > 5_000:
                yield _batch(rows)
                rows.clear()
        if pieces:
            finish()
        yield _batch(rows)

    return matched


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, local_words: int = LOCAL_WORDS) -> DataFrame:
    """id, row, spans: the removed windows of each text that has any, as (first, last)."""
    minimizers = staged(docs.mapInArrow(_minimizer_rows(span, gram), "h long, id long, row long, first int, more byte"))
    shards = (
        minimizers.groupBy("h")
        .agg(F.min("id").alias("shard"), F.max("id").alias("latest"))
        .filter(F.col("shard") < F.col("latest"))
        .select("h", "shard")
    )
    runs = staged(
        minimizers.join(shards, "h")
        .groupBy("id", "row")  # one text's runs
        .agg(F.collect_list(F.struct("shard", "first", "more")).alias("runs"))
    )
    wanted = IdFilter(runs, "id").rows(docs, "id")
    texts = wanted.join(runs, ["id", "row"]).dropDuplicates(["id", "row"]).sortWithinPartitions("id")
    local = staged(texts.select("id", "row", "text", "runs").mapInArrow(_local(span, local_words), _OUT_SCHEMA))
    left = local.filter(F.col("words").isNotNull())
    final = left.repartition("shard").sortWithinPartitions("shard", "id", "row", "first").mapInArrow(_final(span), _OUT_SCHEMA)
    gone = local.filter(F.col("words").isNull()).select("id", "row", "first", "last")
    return (
        gone.unionByName(final.select("id", "row", "first", "last"))
        .groupBy("id", "row")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )


_KEPT = ["doc_id", "n_words", "n_removed", "kept"]


def _keeper(span: int):
    def kept(batches):
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, spans in zip(filled(batch.column(1)).cast(pa.binary()), batch.column(2)):
                words = text.as_py().split()
                counts.append(len(words))
                if spans.is_valid:
                    stay = np.ones(len(words), bool)
                    for s in spans.as_py():
                        stay[s["first"] : s["last"] + span] = False
                    words = [w for w, ok in zip(words, stay) if ok]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], _KEPT)

    return kept


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    local_words: int = LOCAL_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words): one row per row of ``docs``."""
    if not 0 < gram <= span:
        raise ValueError("gram must be between 1 and span")
    chosen = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
        F.col(text_col).alias("text"),
    )
    spans = staged(repeated_spans(chosen, span, gram, local_words))
    touched = IdFilter(spans, "id")
    joined = touched.rows(chosen, "id").join(spans, ["id", "row"], "left").select("id", "text", "spans")
    rest = touched.rows(chosen, "id", found=False).select(
        "id", "text", F.lit(None).cast("array<struct<first: int, last: int>>").alias("spans")
    )
    keep, schema = _keeper(span), "doc_id long, n_words long, n_removed long, kept string"
    found = joined.mapInArrow(keep, schema).unionByName(rest.mapInArrow(keep, schema))
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _LEAST, F.col("doc_id")))


#: The same windows by joining them whole; {documents} is the table's name.
SQL = """
WITH toks AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}
), wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM toks)
), firsts AS (
  SELECT k, min(doc_id) AS first FROM wins GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM wins JOIN firsts USING (k), (SELECT unnest(range(0, 13)) AS j) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM toks
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.p = words.p)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM toks LEFT JOIN kept USING (doc_id)
"""
