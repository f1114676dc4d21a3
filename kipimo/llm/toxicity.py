"""Toxicity by bags of subword embeddings and a linear softmax.

A window of ``WINDOW`` words is the bag of its byte n-grams, word edges included.  Each
n-gram has an embedding in a hashed table; the bag's mean goes through a linear softmax
with two classes.  Embeddings and softmax are trained jointly in NumPy.  A misspelt
word shares most n-grams with the word it stands for, and so its vectors.  A text
scores as its most toxic window, so one insult in a long text is not averaged away; in
training the label of a text is laid on that window.

Training uses a bounded sample of labelled rows: ``sample_docs`` per class with the
smallest hash, of at most ``sample_chars`` characters each.  For scoring, embedding
and softmax collapse into one number per table row, which is broadcast (``BUCKETS``
floats, 1 MB).  Scoring is row-local over whole texts, a batch at a time.

Defined cases: null and empty texts score as an empty bag (the bias alone); labels
without document, or null, teach nothing; several labels of a document count each;
with only one class labelled, or none, every score is that class's share (0 if none);
repeated rows are each scored; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textblock import TextBlock, filled, mixed, slices

SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 8_000
BUCKETS = 1 << 18
WIDTH = 8
SIZES = (3, 4, 5)
WINDOW = 8
LEAST = 60
EPOCHS = 40
_SLICE = 1 << 20
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, (max(SIZES), 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Bags:
    """Some texts as sequences of distinct words' numbers, with those words' n-grams.

    A word that repeats the one before it is left out, so that one repeated word is a
    small bag; small bags are taken as ``LEAST`` n-grams, the missing ones neutral.
    """

    def __init__(self, column: pa.Array):
        block = TextBlock.of(column, lower=True)
        hashes = block.hashes()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (block.doc[1:] != block.doc[:-1])
        self.n, doc = block.n, block.doc[fresh]
        _, first, self.word = np.unique(hashes[fresh], return_index=True, return_inverse=True)
        start, size = block.start[fresh][first], (block.end - block.start)[fresh][first]
        self.buckets, self.held = _ngrams(block.data, start, size)
        self.size = np.concatenate([[0], np.cumsum(self.held[self.word])])
        counts = np.bincount(doc, minlength=self.n)
        ends = np.cumsum(counts)
        n_windows = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
        self.doc = np.repeat(np.arange(self.n), n_windows)
        self.lo = np.arange(len(self.doc)) + np.repeat(ends - counts - np.cumsum(n_windows) + n_windows, n_windows)
        self.hi = np.minimum(self.lo + WINDOW, ends[self.doc])
        self.weight = 1 / np.maximum(self.size[self.hi] - self.size[self.lo], LEAST)

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of each window's n-grams."""
        by_word = np.bincount(np.repeat(np.arange(len(self.held)), self.held), weights[self.buckets], len(self.held))
        total = np.concatenate([[0.0], np.cumsum(by_word[self.word])])
        return (total[self.hi] - total[self.lo]) * self.weight

    def pull(self, windows: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The sum over windows of ``error`` times the share of each n-gram."""
        share = error * self.weight[windows]
        n = len(self.word) + 1
        edge = np.bincount(self.lo[windows], share, n) - np.bincount(self.hi[windows], share, n)
        by_word = np.bincount(self.word, np.cumsum(edge)[:-1], len(self.held))
        return np.bincount(self.buckets, np.repeat(by_word, self.held), BUCKETS)

    def strongest(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text with a word: its index, and the index of its highest window."""
        order = np.lexsort((means, self.doc))
        last = np.flatnonzero(np.diff(np.concatenate([self.doc[order], [-1]])) != 0)
        return self.doc[order[last]], order[last]


def _ngrams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the words, edges as spaces, and how many each has."""
    wide = size + 2
    ends = np.cumsum(wide)
    text = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    at = np.arange(len(text)) - np.repeat(ends - wide, wide)
    inner = (at > 0) & (at <= np.repeat(size, wide))
    text[inner] = data[(np.repeat(start, wide) + at - 1)[inner]]
    room = np.repeat(wide, wide) - at
    held = sum(np.maximum(wide - n + 1, 0) for n in SIZES)
    buckets, place = [], []
    for n in SIZES:
        here = np.flatnonzero(room >= n)
        key = np.zeros(len(here), np.uint64)
        for j in range(n):
            key += _TABLE[j][text[here + j]]
        buckets.append((mixed(key) % np.uint64(BUCKETS)).astype(np.int32))
        place.append(here)
    order = np.argsort(np.concatenate(place), kind="stable")
    return np.concatenate(buckets)[order], held


class Model:
    """weights: what each n-gram adds to the log odds (over the bag's size); bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        bags = Bags(column)
        highest = np.zeros(bags.n)
        means = bags.means(self.weights)
        docs, windows = bags.strongest(means)
        highest[docs] = means[windows]
        return 1 / (1 + np.exp(-np.clip(highest + self.bias, -40, 40)))


def _softmax_one(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slopes(bags: Bags, values: list, target: np.ndarray, weight: np.ndarray, whole: bool) -> list[np.ndarray]:
    """Slopes of the weighted cross entropy by table, softmax and bias.

    A text's target is laid on all its windows in equal parts, or on its strongest one.
    """
    table, softmax, bias = values
    scores = table @ softmax
    means = np.stack([bags.means(scores[:, k]) for k in (0, 1)], 1)
    if whole:
        windows, doc = np.arange(len(bags.doc)), bags.doc
        part = 1 / np.bincount(doc, minlength=bags.n)[doc]
    else:
        doc, windows = bags.strongest(means[:, 1] - means[:, 0])
        part = np.ones(len(doc))
    error = (_softmax_one(means[windows] + bias) - target[doc]) * (weight[doc] * part)[:, None]
    pull = np.stack([bags.pull(windows, error[:, k]) for k in (0, 1)], 1)
    return [pull @ softmax.T, table.T @ pull, error.sum(0)]


def fitted(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1) -> Model:
    """Train embeddings and softmax jointly by Adam on all sampled texts at once.

    The first epochs lay a text's label on its whole bag, the later ones on its
    strongest window.
    """
    share = float(np.mean(labels)) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), 40.0 if share else -40.0)
    bags = Bags(pa.array(texts, pa.string()))
    rng = np.random.default_rng(7)
    values = [rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    target = np.stack([1 - labels, labels], 1)
    for epoch in range(epochs):
        by = slopes(bags, values, target, weight, whole=epoch < epochs // 4)
        for k, slope in enumerate(by):
            m, v = moments[k]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            step = (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-7)
            values[k] = values[k] - rate * step
    table, softmax, bias = values
    return Model((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sampled(docs: DataFrame, labels: DataFrame, teach: Column, sample_docs: int = SAMPLE_DOCS) -> list:
    """(text, label) of a bounded number of labelled rows per class."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labels.filter(teach & F.col("toxic").isin(0, 1))
        .select("doc_id", "toxic")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= sample_docs)
        .select("doc_id", "toxic")
    )
    texts = docs.filter(F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    # 2 * sample_docs rows at most
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r["text"], r["toxic"]) for r in joined.collect())


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per row of ``docs``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = shared.value
        for batch in batches:
            text = filled(batch.column(1))
            for lo, hi in slices(text, _SLICE):
                score = model.scores(text.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], ["doc_id", "score"])

    return chosen.mapInArrow(scored, f"doc_id {kind}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, teach: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the labelled rows where ``teach`` holds, score all of ``docs``."""
    rows = sampled(docs, labels, teach, sample_docs)
    model = fitted([t for t, _ in rows], np.array([y for _, y in rows], np.int64))
    return score_texts(docs, model)
