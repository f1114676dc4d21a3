"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one returns their token ids.  Rows with one doc_id
are one document to the stages that drop documents by id; rows without a doc_id are one
if their texts are equal.

Batches for Python are bounded by bytes, and no task has two Python workers at once: the
workers of an executor stay for all stages, and keep what the largest batch took.
"""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kipimo.llm import byte_bpe, decontamination, jaccard, lines, quality
from kipimo.llm.idfilter import without
from kipimo.plans.stage import bound_batches, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage whose session has bounded batches."""

    @wraps(function)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return function(spark, docs, sf_dir)

    return bounded


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that do."""
    return quality.keep_good(docs)


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; one that loses all its words goes.

    Lines of fewer than six words go if they are equal, others within one word edit.
    """
    found = lines.dedup_lines(docs, exact_words=1)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("doc.n_chars"))
    return found.filter(~emptied).select(
        "doc.doc_id", text.alias("text"), "doc.lang", "doc.source", size.alias("n_chars")
    )


_NAMELESS = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``: the id, or for a document without one a number of its text above all ids."""
    of_text = F.xxhash64("text").bitwiseAND(F.lit(_NAMELESS // 2 - 1)) + F.lit(_NAMELESS)
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), of_text))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Documents without id come after all others; of those with one text, one stays.
    """
    groups = staged(jaccard.similar_documents(keyed(docs), id_col="_key"))
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_key"))
    kept = without(keyed(docs), gone, "_key").select(*COLUMNS)
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if docs.filter(nameless).isEmpty():
        return kept
    kept = staged(kept)
    return kept.filter(~nameless).unionByName(kept.filter(nameless).dropDuplicates(["text"]))


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(keyed(docs), benchmark, id_col="_key", stage_passages=True)
    gone = staged(found.select(F.col("doc_id").alias("_key")))
    return without(keyed(docs), gone, "_key").select(*COLUMNS)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    decoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, with_bytes=True)
    return byte_bpe.digests(decoded, keep_ids=True)


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: Retrieval and encoding are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, step in STAGES:
        docs = staged(step(spark, docs, sf_dir))
    return docs
