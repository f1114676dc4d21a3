"""Token predictions: one tag per word from sub-word predictions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..functions.columns import let
from ..plans.stage import staged
from .moments import weighted_sums
from .selection import SMALL_ROWS


def first_subwords(tokens: Column, word: str = "word_id") -> Column:
    """First sub-word of every word in an array of token structs.

    A token counts where its word id differs from the previous token's; tokens
    without a word are skipped.  Row-local, so a sentence table needs no shuffle.
    """

    def starts(all_tokens):
        return F.filter(
            all_tokens,
            lambda t, i: t[word].isNotNull()
            & ((i == 0) | ~t[word].eqNullSafe(F.get(all_tokens, i - 1)[word])),
        )

    return let(tokens, starts)


RUN_ROWS = 1_000_000
_RUN = "_run"


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first is another than the one before; nulls are alike."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy().astype(bool)


def _run_firsts(n_keys: int, word: int, token: int):
    """Of each run of rows with one sentence, the first token per word, with the run's number."""

    def firsts(table: pa.Table, runs: np.ndarray) -> pa.Table:
        numbered = table.append_column(_RUN, pa.array(runs, pa.int64()))
        keys = pa.table([numbered.column(_RUN), table.column(word), table.column(token)], ["run", "word", "token"])
        order = pc.sort_indices(keys, [(k, "ascending") for k in keys.column_names], null_placement="at_end")
        keys = keys.take(order)
        if len(keys):
            first = np.concatenate([[True], _differs(keys.column("run")) | _differs(keys.column("word"))])
            order = order.filter(pa.array(first))
        return numbered.take(order)

    def rows(batches):
        run = TaskContext.get().partitionId() << 33
        held: list = []  # the batches of the run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            cut = np.zeros(len(table), np.int64)
            for k in range(n_keys):
                cut[1:] |= _differs(table.column(k))
            runs = run + np.cumsum(cut)
            done = int(np.searchsorted(runs, runs[-1])) if len(table) < RUN_ROWS else len(table)
            if done:
                yield from firsts(table.slice(0, done), runs[:done]).to_batches()
            held, run = table.slice(done).combine_chunks().to_batches(), int(runs[-1]) + (done == len(table))
        if held:
            table = pa.Table.from_batches(held)
            yield from firsts(table, np.full(len(table), run)).to_batches()

    return rows


def first_subword_rows(pieces: DataFrame, sentence: list[str], word="word_id", token="token_index"):
    """The same for a table with one row per token.

    A task reduces each run of adjacent rows of one sentence to one row per word (a run ends
    at ``RUN_ROWS`` rows, so a sentence of any length passes) and stages them.  A sentence
    that is one run is finished; only sentences of several runs, such as those that lie in
    two tasks, are grouped through a shuffle, again by one row per run and word.
    """
    rest = [c for c in pieces.columns if c not in [*sentence, word]]
    worded = pieces.filter(F.col(word).isNotNull()).select(*sentence, word, *rest)

    def grouped(rows):
        first = F.min_by(F.struct(*rest), F.col(token)).alias("_first")
        return rows.groupBy(*sentence, word).agg(first).select(*sentence, word, "_first.*")

    if any(isinstance(worded.schema[c].dataType, (T.ArrayType, T.StructType)) for c in [*sentence, word, token]):
        return grouped(worded)  # Arrow does not compare these
    at = len(sentence)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in worded.schema), T.StructField(_RUN, T.LongType())])
    runs = staged(worded.mapInArrow(_run_firsts(at, at, at + 1 + rest.index(token)), schema))
    several = runs.groupBy(*sentence).agg(F.min(_RUN).alias("_lo"), F.max(_RUN).alias("_hi")).filter("_lo < _hi")
    several = staged(several.select(*[F.col(c).alias(f"_{i}_of") for i, c in enumerate(sentence)]))
    n_several = several.count()
    known = [F.when(F.col(token).isNotNull(), F.col(c)).alias(c) for c in rest]
    if not n_several:
        return runs.select(*sentence, word, *known)
    same = [F.col(c).eqNullSafe(F.col(f"_{i}_of")) for i, c in enumerate(sentence)]
    named = F.broadcast(several) if n_several <= SMALL_ROWS else several
    whole = runs.join(named, same, "left_anti").select(*sentence, word, *known)
    return whole.unionByName(grouped(runs.join(named, same, "left_semi")))


def tag_words(first: DataFrame, labels: list[str], probabilities: str = "p") -> DataFrame:
    """Adds ``tag`` (prefix stripped) and ``confidence`` from class probabilities."""
    names = F.array(*[F.lit(x) for x in labels])
    return (
        first.withColumn("_best", V.argmax_label(F.col(probabilities), names))
        .withColumn("tag", X.strip_tag_prefix(F.col("_best")["label"]))
        .withColumn("confidence", F.col("_best")["confidence"])
        .drop("_best")
    )


def validate_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``reject_reason``; null marks an accepted text."""
    return df.withColumn("reject_reason", X.reject_reason(F.col(column)))


def pool_tokens(tokens: DataFrame, sentence: list[str], vector="vector", mask="mask") -> DataFrame:
    """Masked mean of token vectors given one row per token.

    A task adds up the tokens of each sentence as one vector, so a sentence of any
    length is pooled without collecting its tokens.
    """
    found = weighted_sums(tokens, sentence, vector, F.col(mask))
    total = F.greatest("weight", F.lit(V.MASK_FLOOR))
    return found.select(*sentence, let(total, lambda t: F.transform("sums", lambda x: x / t)).alias("pooled"))
