"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of labelled text is built.  A text is parsed into
phrases, each the longest match that the automaton of a language still reads; few
phrases mean a text made of that language's own strings.  Phrases times the logarithm
of the automaton's text length, per symbol, estimate the cross entropy in bits; the
language needing least wins.

Training reads a bounded sample, as documented parameters say: per language the
``sample_docs`` distinct labelled texts with the smallest hash, ``ref_symbols`` symbols
in all.  Each gives an equal stretch from its start; what short texts leave is shared by
the longer ones.  At most ``ref_symbols`` characters of each reach the driver.  The
automata's edges are broadcast (at most three a symbol).  A task holds them in hash
tables of eight bytes a slot, 2 MB for each language as set, whatever the alphabet.

Prediction is row-local over whole texts.  Symbols are cut into blocks, and all blocks
of a batch step through the automaton side by side.  A block then starts anew from the
state that the block before it ended in, up to the first phrase that begins where one
began before; this goes on until no block's start changes, so phrases are those of the
uncut text.

Defined cases: null texts and texts without letters are ``und`` with score 0; labelled
rows without text or lang teach nothing; with no labelled text at all every text is
``und``; equal entropies go to the first language by name; repeated rows are each
predicted; other columns are not read.
"""

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import staged
from .textblock import filled, slices

SAMPLE_DOCS, REF_SYMBOLS = 64, 32_768
MOST_SYMBOLS = 1 << 20
BLOCK = 256
UNKNOWN = "und"
_SLICE = 2 << 20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


class Symbols:
    """Maps texts to symbols: 0 a gap, then the letters of the sample, then any other."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.size = len(known) + 2
        self.table = np.zeros(0x110000, np.int32)
        self.table[_is_letter()] = len(known) + 1
        self.table[known] = np.arange(1, len(known) + 1)

    @classmethod
    def learned(cls, texts: list[str]) -> "Symbols":
        points = np.unique(np.concatenate([_points(t) for t in texts]))
        return cls(points[_is_letter()[points]])

    def of(self, text: str) -> np.ndarray:
        """Symbols of a text, each run of other characters as one gap."""
        out = self.table[_points(text)]
        keep = out != 0
        keep[1:] |= out[:-1] != 0
        return out[keep]


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (from, symbol, to) of the automaton that reads every substring; 1 is its root."""
    follow, link, length = [{}, {}], [0, 0], [0, 0]
    last = 1
    for c in symbols:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    sizes = [len(f) for f in follow]
    source = np.repeat(np.arange(len(follow), dtype=np.int32), sizes)
    symbol = np.fromiter((c for f in follow for c in f), np.int32, sum(sizes))
    target = np.fromiter((t for f in follow for t in f.values()), np.int32, sum(sizes))
    return source, symbol, target


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Parser:
    """Counts the phrases of many texts against one automaton.

    Edges lie in one open hash table: a slot holds (state, symbol) and the next state.
    """

    def __init__(self, edges, alphabet: int):
        source, symbol, target = (e.astype(np.int64) for e in edges)
        self.alphabet = alphabet
        self.state_bits = np.int64(int(target.max(initial=1)).bit_length())
        slot_bits = max(2 * len(source), 2).bit_length()
        self.shift, self.last = np.uint64(64 - slot_bits), np.int64((1 << slot_bits) - 1)
        self.table = np.full(1 << slot_bits, -1, np.int64)
        key = source * alphabet + symbol
        entry, slot = key << self.state_bits | target, self._slot(key)
        while len(entry):
            free = self.table[slot] < 0
            self.table[slot[free]] = entry[free]
            left = self.table[slot] != entry
            entry, slot = entry[left], slot[left] + 1 & self.last
        # after one symbol; a symbol never seen leads to state 0, which reads nothing
        symbols = np.arange(alphabet)
        self.begin = self._follow(np.ones(alphabet, np.int64), symbols)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def _follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that edges lead to, 0 where there is none."""
        key = state * self.alphabet + symbol
        slot = self._slot(key)
        entry = self.table[slot]
        found = entry >> self.state_bits == key
        to = np.where(found, entry & ((np.int64(1) << self.state_bits) - 1), 0)
        at = np.flatnonzero(~found & (entry >= 0))
        while len(at):
            slot[at] = slot[at] + 1 & self.last
            entry = self.table[slot[at]]
            found = entry >> self.state_bits == key[at]
            to[at[found]] = entry[found] & ((np.int64(1) << self.state_bits) - 1)
            at = at[~found & (entry >= 0)]
        return to

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase began."""
        to = self._follow(state, symbol)
        fresh = to == 0
        to[fresh] = self.begin[symbol[fresh]]
        return to, fresh

    def borders(self, columns: np.ndarray, active: list[int], before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block, but for the first phrase of a text.

        Column j holds the j-th symbols, of ``active[j]`` blocks; ``before`` is the block
        before each one in its text, or -1.
        """
        begun = np.ones(columns.shape[1], np.int64)
        state, fresh = begun.copy(), np.zeros(columns.shape, bool)
        for j, m in enumerate(active):
            state[:m], fresh[j, :m] = self._step(state[:m], columns[j, :m])
        inner = np.flatnonzero(before >= 0)
        while True:
            lanes = inner[state[before[inner]] != begun[inner]]
            if not len(lanes):
                return fresh.sum(0)
            begun[lanes] = now = state[before[lanes]]
            for j, m in enumerate(active):
                lanes, now = lanes[lanes < m], now[lanes < m]  # others end a text
                if not len(lanes):
                    break
                now, new = self._step(now, columns[j, lanes])
                apart = ~(new & fresh[j, lanes])
                fresh[j, lanes] = new
                lanes, now = lanes[apart], now[apart]
            state[lanes] = now


class Model:
    """What is learned: the symbols, and per language the automaton and its text length."""

    def __init__(self, known, languages: dict):
        self.known, self.languages = known, languages

    def open(self):
        symbols = Symbols(self.known)
        parsers = {k: (Parser(edges, symbols.size), np.log2(max(n, 2))) for k, (edges, n) in self.languages.items()}
        return symbols, parsers

    @classmethod
    def fitted(cls, samples: dict[str, list[str]], ref_symbols: int = REF_SYMBOLS) -> "Model":
        """From texts per language."""
        if not 0 < ref_symbols <= MOST_SYMBOLS:
            raise ValueError(f"ref_symbols must be between 1 and {MOST_SYMBOLS}")
        if not any(samples.values()):
            return cls(np.zeros(0, np.uint32), {})
        symbols = Symbols.learned([t for texts in samples.values() for t in texts])
        languages = {}
        for name in sorted(samples):
            text = np.concatenate(equal_stretches([symbols.of(t + " ") for t in samples[name]], ref_symbols)).tolist()
            if text:
                languages[name] = (suffix_automaton(text), len(text))
        return cls(symbols.known, languages)


def equal_stretches(rows: list[np.ndarray], total: int) -> list[np.ndarray]:
    """The start of each row, of one length for all that are longer, ``total`` in all at most."""
    left, out = total, list(rows)
    for n, k in enumerate(sorted(range(len(rows)), key=lambda k: len(rows[k]))):
        out[k] = rows[k][: left // (len(rows) - n)]
        left -= len(out[k])
    return out


def entropies(texts: list[str], opened) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol of each text (rows) by each language, and which texts have letters."""
    symbols, parsers = opened
    rows = [symbols.of(t) for t in texts]
    size = np.array([len(r) for r in rows])
    letters = np.array([bool(r.any()) for r in rows], bool)
    n_blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(rows)), n_blocks)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    width = np.minimum(size[doc] - place * BLOCK, BLOCK)
    order = np.argsort(-width, kind="stable")
    lane = np.argsort(order, kind="stable")
    before = np.where(place > 0, lane[np.arange(len(doc)) - 1], -1)[order]
    grid = np.zeros((len(doc), BLOCK), np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    first_block = np.cumsum(n_blocks) - n_blocks
    grid[np.repeat(first_block, size) + at // BLOCK, at % BLOCK] = flat
    columns = np.ascontiguousarray(grid[order].T)
    active = np.searchsorted(-width[order], -np.arange(BLOCK), "left").tolist()
    bits = np.zeros((len(rows), len(parsers)))
    for k, (parser, log) in enumerate(parsers.values()):
        phrases = np.bincount(doc[order], parser.borders(columns, active, before), len(rows)) + (size > 0)
        bits[:, k] = phrases * log
    return bits / np.maximum(size, 1)[:, None], letters


def sampled(
    docs: DataFrame,
    teach: Column,
    sample_docs: int = SAMPLE_DOCS,
    ref_symbols: int = REF_SYMBOLS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, list[str]]:
    """The texts to learn from: a bounded number of distinct ones per language, smallest hash first.

    Copies are made one by their hashes, so no text is shuffled for it.
    """
    lang, text = F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    labelled = docs.filter(teach & lang.isNotNull() & text.isNotNull()).select(lang, text, F.xxhash64(text).alias("key"))
    chosen = staged(  # its size is known to the planner, which then moves no texts to join it
        labelled.select("lang", "key")
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
        .filter(F.col("rank") <= sample_docs)
    )
    rows = (
        labelled.select("lang", "key", F.substring("text", 1, ref_symbols).alias("text"))
        .join(chosen, ["lang", "key"])
        .groupBy("lang", "rank")
        .agg(F.min("text").alias("text"))
        .collect()  # sample_docs texts of ref_symbols characters for each language
    )
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return out


_opened: dict = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per row of ``docs``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    shared = chosen.sparkSession.sparkContext.broadcast(model)
    names = list(model.languages)
    number = uuid.uuid4().hex  # a worker that serves several models keeps them apart

    def predicted(batches):
        if number not in _opened:
            _opened.clear()
            _opened[number] = shared.value.open()
        for batch in batches:
            text = filled(batch.column(1))
            for lo, hi in slices(text, _SLICE):
                part = text.slice(lo, hi - lo).to_pylist()
                if names:
                    bits, letters = entropies(part, _opened[number])
                    best = bits.argmin(1)
                    sizes = np.minimum([len(t) for t in part], 64)[:, None]
                    score = letters / np.exp2(-sizes * (bits - bits.min(1)[:, None])).sum(1)
                    found = [names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                else:
                    found, score = [UNKNOWN] * len(part), np.zeros(len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return chosen.mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(
    docs: DataFrame,
    teach: Column,
    sample_docs: int = SAMPLE_DOCS,
    ref_symbols: int = REF_SYMBOLS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Learn from the rows of ``docs`` where ``teach`` holds, predict all of them."""
    texts = sampled(docs, teach, sample_docs, ref_symbols, text_col, lang_col)
    return predict(docs, Model.fitted(texts, ref_symbols), id_col, text_col)
