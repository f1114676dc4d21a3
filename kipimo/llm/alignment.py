"""Cross-tokenizer alignment by galloping intersection of token ends.

A byte-level tokenizer A encodes space + text, a piece tokenizer B encodes text (it adds
the space).  Both sequences spell the same bytes, so the offsets where a token of either
ends can be compared.  The shorter list of ends drives an exponential and then binary
search into the longer one, from where its last search stopped; all texts of a slice
search side by side, in lanes of ``LANE`` ends.  Common ends cut the tokens into
groups, and the difference of two neighbouring ranks is the range of tokens that a
token overlaps: its links.

Encoding is row-local and done once; the links of each text are staged, packed, as sorted
id pairs.  Pairs are counted in each task before they are shuffled.  How often a pair
is linked is looked up at every link: pairs from a count on, at most ``FREQUENT`` of them,
are sent to all tasks; the rest, each of which is rare, goes by a join.  Both ways are
exact, and no key of the join has more rows than that count.

Neither tokenizer joins a space with what is before it, so texts are encoded by segments (a
word with the spaces before it), each distinct one of a slice once; a worker keeps the
tokens of ``KEPT`` segments, and those of a slice of texts or of the longest one,
whichever is more.  Defined cases: null and empty texts, and those whose
tokens spell other bytes than space + text (as with U+2581, which B takes for a space),
have no tokens, groups or links, and an empty digest; null and repeated ids, and
repeated rows, are aligned and counted each; ties for a token's most frequent partner all
count as best; an empty table gives an empty result; other columns are not read.
"""

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .textblock import filled, slices

LANE = 64
KEPT = 400_000
FREQUENT = 1 << 19
_SLICE = 1 << 20  # bytes of text worked on at once
_HELD = 1 << 22  # links sorted at once when they are counted
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")
_BLANK_AND_SPACE = re.compile(r"\s ")


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones as they are, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Spelling:
    """The bytes of every token id, one behind the other."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.start[ids], self.size[ids])]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Tokenizers:
    """Both tokenizers, as the libraries of their files read them.

    Neither joins a space with what is before it, so a text falls apart into segments,
    and the tokens of up to ``most`` different ones are kept.
    """

    def __init__(self, byte_file: str, piece_file: str, most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_of_letter()
        with open(byte_file, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                tokens[i] = bytes(letters[c] for c in token)
        self.a_spelling = Spelling(tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("pieces cross spaces: texts cannot be cut at spaces")
            pieces.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_spelling = Spelling(pieces)
        self.most = most
        self.kept_a: dict[str, bytes] = {}
        self.kept_b: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) for A and for B."""
        parts = [_segments(t) for t in texts]
        fresh = list(set(chain.from_iterable(parts)).difference(self.kept_a))
        own_a = [np.array(e.ids, "<i4").tobytes() for e in self.a.encode_batch_fast([" " + p for p in fresh], add_special_tokens=False)]
        own_b = [np.array(ids, "<i4").tobytes() for ids in self.b.encode(fresh, num_threads=1)] if fresh else []
        out = []
        for kept, own in ((self.kept_a, dict(zip(fresh, own_a))), (self.kept_b, dict(zip(fresh, own_b)))):
            if len(kept) + len(own) <= self.most:
                kept.update(own)
                own = kept
            if own is kept or not own:
                rows = [b"".join(map(kept.__getitem__, p)) for p in parts]
            else:
                rows = [b"".join([kept[s] if s in kept else own[s] for s in p]) for p in parts]
            size = np.array([len(r) >> 2 for r in rows], np.int64)
            out.append((np.frombuffer(b"".join(rows), "<i4").astype(np.int64), size))
        return out


def _segments(text: str) -> list[str]:
    """The text cut at every space after another character; that space goes."""
    if text[:1] == " " or text[-1:] == " " or _BLANK_AND_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


@lru_cache(maxsize=1)
def _tokenizers(byte_file: str, piece_file: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file)


def gallop(short: np.ndarray, long: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each entry of ``short`` the index of the first entry of ``long`` that is not smaller.

    Both ascend, and the last of ``long`` is not smaller than any of ``short``.  Each
    lane of consecutive entries starts with a search over all and gallops from there.
    """
    found = np.empty(len(short), np.int64)
    at = np.searchsorted(long, short[::lane])
    for j in range(min(lane, len(short))):
        x = short[j::lane]
        at = at[: len(x)]
        low = np.flatnonzero(long[at] < x)  # those that have to move
        if len(low):
            want, below, step = x[low], at[low], 1
            reach = np.minimum(below + step, len(long) - 1)
            going = np.flatnonzero(long[reach] < want)
            while len(going):
                step *= 2
                below[going] = reach[going]
                reach[going] = np.minimum(below[going] + step, len(long) - 1)
                going = going[long[reach[going]] < want[going]]
            while True:
                wide = np.flatnonzero(reach - below > 1)
                if not len(wide):
                    break
                middle = (reach[wide] + below[wide]) >> 1
                under = long[middle] < want[wide]
                below[wide[under]] = middle[under]
                reach[wide[~under]] = middle[~under]
            at = at.copy()
            at[low] = reach
        found[j::lane] = at
    return found


class Aligned:
    """The groups and links of texts whose tokens spell the same bytes.

    ``a`` and ``b`` are (ids, number of ids of each text).  ``group_a`` and ``group_b``
    number each token's group over all texts; ``link_a`` and ``link_b`` are the ids of
    every link, text by text.
    """

    def __init__(self, a, b, spelling_a: Spelling, spelling_b: Spelling):
        (self.a, self.n_a), (self.b, self.n_b) = a, b
        end_a, end_b = np.cumsum(spelling_a.size[self.a]), np.cumsum(spelling_b.size[self.b])
        flip = len(end_a) > len(end_b)
        short, long = (end_b, end_a) if flip else (end_a, end_b)
        rank = gallop(short, long)
        common = long[rank] == short if len(short) else np.zeros(0, bool)
        first = np.zeros(len(short), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        overlapped = rank - first + 1
        of_short = np.repeat(np.arange(len(short)), overlapped)
        of_long = _ranges(first, overlapped)
        group_short = np.cumsum(common) - common
        cut = np.zeros(len(long), np.int64)
        cut[rank[common]] = 1
        group_long = np.cumsum(cut) - cut
        if flip:
            self.group_a, self.group_b = group_long, group_short
            self.link_a, self.link_b = self.a[of_long], self.b[of_short]
        else:
            self.group_a, self.group_b = group_short, group_long
            self.link_a, self.link_b = self.a[of_short], self.b[of_long]
        n = len(self.n_a)
        n_short, n_long = (self.n_b, self.n_a) if flip else (self.n_a, self.n_b)
        of_text = np.repeat(np.arange(n), n_short)
        self.n_groups = np.bincount(of_text[common], minlength=n)
        self.n_links = np.bincount(of_text, overlapped, n).astype(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group ends among the text's own A and B tokens."""
        first = np.cumsum(self.n_groups) - self.n_groups
        ends = []
        for group, size in ((self.group_a, self.n_a), (self.group_b, self.n_b)):
            end = np.cumsum(np.bincount(group, minlength=int(self.n_groups.sum())))
            ends.append(end - np.repeat(np.cumsum(size) - size, self.n_groups))
        return ends[0], ends[1]

    def written(self) -> list[bytes]:
        """Each text's groups: ids with commas, ``|`` between A and B, ``;`` between groups."""
        total = int(self.n_groups.sum())
        in_a, in_b = np.bincount(self.group_a, minlength=total), np.bincount(self.group_b, minlength=total)
        a_upto, b_upto = np.cumsum(in_a), np.cumsum(in_b)
        n = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + (b_upto - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + a_upto[self.group_b]
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[a_upto - 1]] = ord("|")
        mark[place_b[b_upto - 1]] = ord(";")
        text_end = np.cumsum(self.n_a + self.n_b)
        digits, size = _decimals(int(ids.max(initial=0)) + 1)
        wide = np.zeros((n, digits.shape[1] + 1), np.uint8)
        wide[:, :-1] = digits[ids]
        wide[np.arange(n), size[ids]] = mark
        raw = wide[np.arange(wide.shape[1]) <= size[ids][:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids] + 1)])[text_end]
        begins = np.concatenate([[0], ends[:-1]])
        return [raw[s : e - 1] if e > s else b"" for s, e in zip(begins, ends)]


@lru_cache(maxsize=2)
def _decimals_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    written = [str(i).encode() for i in range(n)]
    width = len(written[-1])
    table = np.frombuffer(b"".join(w.ljust(width) for w in written), np.uint8).reshape(n, width)
    return table, np.array([len(w) for w in written], np.int64)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. n - 1 from the left, and how many each has."""
    return _decimals_upto(1 << max(n - 1, 1).bit_length())


def align_texts(tokenizers: Tokenizers, texts: list[str]) -> tuple[np.ndarray, Aligned]:
    """Indices of the texts that have tokens, and their alignment."""
    keep = np.array([i for i, t in enumerate(texts) if t], np.int64)
    a, b = tokenizers.encoded([texts[i] for i in keep])
    raw = [b" " + texts[i].encode() for i in keep]
    size = np.array([len(r) for r in raw], np.int64)
    spelled = []
    for (ids, n), spelling in ((a, tokenizers.a_spelling), (b, tokenizers.b_spelling)):
        spelled.append(np.bincount(np.repeat(np.arange(len(n)), n), spelling.size[ids], len(n)))
    same = (spelled[0] == size) & (spelled[1] == size)
    while True:
        a, b = (_only(x, same) for x in (a, b))
        keep, size, raw = keep[same], size[same], [r for r, s in zip(raw, same) if s]
        data = np.frombuffer(b"".join(raw), np.uint8)
        other = (tokenizers.a_spelling.bytes_of(a[0]) != data) | (tokenizers.b_spelling.bytes_of(b[0]) != data)
        same = np.bincount(np.repeat(np.arange(len(size)), size)[other], minlength=len(size)) == 0
        if same.all():
            return keep, Aligned(a, b, tokenizers.a_spelling, tokenizers.b_spelling)


def _only(tokens: tuple[np.ndarray, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = tokens
    return ids[np.repeat(chosen, n)], n[chosen]


def _aligned_slices(batches, byte_file: str, piece_file: str):
    """(rows of a batch, indices of those with tokens, their alignment)."""
    tokenizers = _tokenizers(byte_file, piece_file)
    for batch in batches:
        text = filled(batch.column(batch.num_columns - 1))
        for lo, hi in slices(text, _SLICE):
            yield batch.slice(lo, hi - lo), *align_texts(tokenizers, text.slice(lo, hi - lo).to_pylist())


def _spread(values, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = values
    return out


def token_groups(
    docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, a_ids, b_ids, and a_ends, b_ends: where each group ends in them."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["a_ids", "b_ids", "a_ends", "b_ends"]

    def lists(values, sizes, at, n):
        ends = np.cumsum(_spread(sizes, at, n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, pa.int32()))

    def grouped(batches):
        for part, at, found in _aligned_slices(batches, byte_file, piece_file):
            a_ends, b_ends = found.spans()
            sides = [(found.a, found.n_a), (found.b, found.n_b), (a_ends, found.n_groups), (b_ends, found.n_groups)]
            columns = [lists(v, s, at, part.num_rows) for v, s in sides]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(grouped, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in names))


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte place, compressed."""
    step = np.diff(keys, prepend=0).astype("<u8")
    planes = step.view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_documents(
    docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links.

    ``links`` packs the keys a << 32 | b of a text's links, ascending.
    """
    chosen = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )

    def aligned(batches):
        for part, at, found in _aligned_slices(batches, byte_file, piece_file):
            n = part.num_rows
            digest, links = [""] * n, [b""] * n
            keys = found.link_a << 32 | found.link_b
            ends = np.cumsum(found.n_links)
            for i, end, size, groups in zip(at, ends, found.n_links, found.written()):
                digest[i] = hashlib.sha256(groups).hexdigest()
                links[i] = _packed(np.sort(keys[end - size : end]))
            counts = [pa.array(_spread(getattr(found, c), at, n)) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *counts, pa.array(digest), pa.array(links, pa.binary())],
                ["row", "doc_id", *_COUNTS, "groups_sha256", "links"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return chosen.mapInArrow(aligned, f"row long, doc_id {kind}, {counts}, groups_sha256 string, links binary")


def _counted_links(batches):
    """(key, n) of all links of a task; equal keys are added up before they leave it."""
    held, size, keys, counts = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged():
        new, n = np.unique(np.concatenate([keys, *(h for h in held)]), return_inverse=True)
        weights = np.concatenate([counts, np.ones(size, np.int64)])
        return new, np.bincount(n, weights, len(new)).astype(np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    for batch in batches:
        for links, n in zip(batch.column(0), batch.column(1)):
            if n.as_py():
                held.append(_unpacked(links.as_py(), n.as_py()))
                size += n.as_py()
                if size >= _HELD:
                    keys, counts = merged()
                    held, size = [], 0
                    if len(keys) >= _HELD:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
    if size:
        keys, counts = merged()
    if len(keys):
        yield out()


def link_counts(aligned: DataFrame) -> DataFrame:
    """key, n, best: how many links hold a pair, and whether its B token has no better."""
    counts = (
        aligned.select("links", "n_links")
        .mapInArrow(_counted_links, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
    )
    counts = staged(counts.withColumn("b", F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))
    # one row per id of B at most: the vocabulary bounds it
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    return counts.join(best, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest power of two that at most ``most`` pairs reach, and those pairs."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()
    total, floor = 0, 64
    for e, n in sorted(sizes, reverse=True):
        total += n
        if total > most:
            break
        floor = e
    limit = 1 << min(floor, 62)
    table = counts.filter(F.col("n") >= limit).toArrow()
    keys = table["key"].to_numpy()
    order = np.argsort(keys)
    return limit, keys[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]


def align_tokenizers(
    docs: DataFrame,
    byte_file: str,
    piece_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one of its
    B token), count_sum (over links, how often their pair is linked), groups_sha256.
    """
    aligned = staged(aligned_documents(docs, byte_file, piece_file, id_col, text_col))
    counts = staged(link_counts(aligned))
    limit, *table = _frequent(counts, frequent)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    passed = ["row", "doc_id", *_COUNTS, "groups_sha256"]

    def looked_up(batches):
        keys, n_of, best_of = sent.value
        for batch in batches:
            n_links = batch.column(len(passed) - 1 - 1).to_numpy()
            n_best, total, rare, times = [], [], [], []
            for links, n in zip(batch.column(len(passed)), n_links):
                pair, many = np.unique(_unpacked(links.as_py(), n), return_counts=True)
                at = np.searchsorted(keys, pair)
                known = at < len(keys)
                known[known] = keys[at[known]] == pair[known]
                at, m = at[known], many[known]
                n_best.append(int(m[best_of[at]].sum()))
                total.append(int((n_of[at] * m).sum()))
                rare.append(pair[~known])
                times.append(many[~known])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), _lists(rare), _lists(times)],
                [*passed, "n_best", "count_sum", "rare", "times"],
            )

    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string,"
        " n_best long, count_sum long, rare array<long>, times array<long>"
    )
    found = staged(aligned.select(*passed, "links").mapInArrow(looked_up, schema))
    pairs = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "row", F.col("p.rare").alias("key"), F.col("p.times").alias("times")
    )
    rest = (
        pairs.join(counts.filter(F.col("n") < limit), "key")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"),
        )
    )
    return found.join(rest, "row", "left").select(
        "doc_id",
        *_COUNTS,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))
