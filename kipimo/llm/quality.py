"""Quality rules judged by document and by host.

Each document fails or passes base rules on its own words.  Failures are then summed
by host; a host's failure rate is shrunk towards all hosts by a beta prior whose mean
and strength come from the hosts themselves (mean rate, and how much more the hosts
differ than chance lets them), worth ``min_strength`` documents at least, so that a
few documents never condemn a host.  A host whose shrunk rate is above
``max_host_rate`` takes all its documents along.

Base counts are row-local; the sums by host pre-aggregate before their shuffle, so a
host with a third of all rows is one row per task.  The narrow base table is staged,
because the hosts' sums and the verdicts both read it.

Defined cases: a null or empty text has no words and fails; a document without host
gets no host verdict; repeated rows are each judged and each counted; an empty table
gives an empty result; columns other than the three named are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import staged
from .textblock import TextBlock, filled, in_order, slices, span_hashes, windows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.8
MIN_STRENGTH = 20.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _by_text(block: TextBlock, at: np.ndarray) -> np.ndarray:
    """How many of the byte positions ``at`` lie in each text."""
    return np.bincount(np.searchsorted(block.text_at, at, "right") - 1, minlength=block.n)


def _repeated_words(block: TextBlock) -> np.ndarray:
    key, first = windows(block.hashes(), block.doc, 3)
    covered = np.zeros(len(block.doc), bool)
    if len(key):
        order, again = in_order(block.doc[first], key)
        found = again.copy()
        found[:-1] |= again[1:]
        at = first[order[found]]
        for j in range(3):
            covered[at + j] = True
    return np.bincount(block.doc[covered], minlength=block.n)


def _repeated_lines(block: TextBlock) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text."""
    cut = np.union1d(np.flatnonzero(block.data == 10), block.text_at[1:] - 1)
    start, end = np.concatenate([[0], cut[:-1] + 1]).astype(np.int64), cut
    words = np.searchsorted(block.start, end) - np.searchsorted(block.start, start)
    start, end = start[words > 0], end[words > 0]
    doc = np.searchsorted(block.text_at, start, "right") - 1
    order, again = in_order(doc, span_hashes(block.data, start, end))
    return np.bincount(doc[order[again]], minlength=block.n)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, null as empty."""
    parts = []
    column = filled(column)
    for lo, hi in slices(column):
        block = TextBlock.of(column.slice(lo, hi - lo))
        lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        chars = (lead[block.end] - lead[block.start]).astype(np.int64)
        parts.append(
            [
                block.counts(),
                np.bincount(block.doc, chars, block.n).astype(np.int64),
                _by_text(block, np.flatnonzero(_SYMBOL[block.data])),
                _repeated_lines(block),
                _repeated_words(block),
            ]
        )
    return {c: np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i, c in enumerate(_COUNTS)}


def _counted(batches):
    for batch in batches:
        counts = base_counts(batch.column(2))
        columns = [batch.column(0), batch.column(1), *(pa.array(counts[c], pa.int64()) for c in _COUNTS)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", *_COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def host_rates(base: DataFrame, min_strength: float = MIN_STRENGTH) -> DataFrame:
    """host, n, fails, rate: the shrunk failure rate of each host.

    With hosts that differ no more than by chance the prior is infinitely strong and
    every host gets the mean rate.
    """
    hosts = (
        base.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    )
    sums = hosts.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("fails"), F.sum(F.col("fails") * F.col("fails") / F.col("n"))
    ).first()
    n_hosts, n, fails = (int(x or 0) for x in sums[:3])
    mean = fails / n if n else 0.0
    spread = (sums[3] or 0.0) - n * mean * mean
    likeness = (spread / (mean * (1 - mean)) - n_hosts) / (n - n_hosts) if 0 < mean < 1 and n > n_hosts else 0.0
    if likeness <= 0:
        return hosts.withColumn("rate", F.lit(mean))
    strength = max(1 / likeness - 1, min_strength)
    return hosts.withColumn("rate", (F.col("fails") + mean * strength) / (F.col("n") + strength))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, host_rejected, kept."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in _COUNTS)
    base = staged(chosen.mapInArrow(_counted, schema).withColumn("base_failed", base_failed()))
    rejected = (
        host_rates(base).filter(F.col("rate") > max_host_rate).select("host", F.lit(True).alias("host_rejected"))
    )
    return (
        base.join(rejected, "host", "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .select("doc_id", *_COUNTS, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are parsed once: the rows are staged with the verdict on their words, the
    hosts' sums read only that, and the passing rows are read back.
    """
    at, flag = docs.columns.index(text_col), "_failed"
    while flag in docs.columns:
        flag = f"_{flag}"

    def judged(batches):
        for batch in batches:
            for lo, hi in slices(filled(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                counts = base_counts(part.column(at))
                n, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(failed)], [*part.schema.names, flag])

    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
    flagged = staged(docs.mapInArrow(judged, schema))
    base = flagged.select(F.col(host_col).alias("host"), F.col(flag).alias("base_failed"))
    bad = host_rates(base).filter(F.col("rate") > max_host_rate).select(F.col("host").alias("_bad_host"))
    passing = flagged.filter(~F.col(flag)).drop(flag)
    return passing.join(bad, F.col(host_col) == F.col("_bad_host"), "left_anti")


#: Base counts, host rates and verdicts; {documents} is the table's name.
SQL = """
WITH toks AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM {documents}
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM toks)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), line_counts AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(lines) AS line FROM toks)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM toks LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS fails FROM base WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT count(*) AS h, sum(n) AS n, sum(fails) / sum(n) AS m, sum(fails * fails / n) AS q FROM hosts
), prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND n > h THEN ((q - n * m * m) / (m * (1 - m)) - h) / (n - h) ELSE 0 END AS r
  FROM sums
), rejected AS (
  SELECT source FROM hosts, prior
  WHERE CASE WHEN r <= 0 THEN m
             ELSE (fails + m * greatest(1 / r - 1, 20)) / (n + greatest(1 / r - 1, 20)) END > 0.8
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       source IS NOT NULL AND source IN (SELECT source FROM rejected) AS host_rejected,
       NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM rejected)) AS kept
FROM base
"""
