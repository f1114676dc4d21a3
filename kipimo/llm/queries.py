"""Queries that apply the operators, with their production parameters, to whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import scratch_path
from ..plans.views import table
from . import (
    alignment,
    byte_bpe,
    decontamination,
    jaccard,
    language,
    lines,
    mixing,
    quality,
    substring,
    token_count,
    token_files,
    toxicity,
    whitening,
)

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def fold(n: int):
    """The fold of a document by the checksum of its id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query()
def op1_byte_bpe(spark, sf_dir):
    pattern = public_tokenizers.PATTERN
    encoded = byte_bpe.encode_texts(documents(spark, sf_dir), RANKS, pattern)
    return byte_bpe.digests(byte_bpe.decode_ids(encoded, RANKS, pattern))


@query()
def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = language.identify_languages(docs, fold(3) != 1)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query(jaccard.SQL.format(documents="documents"))
def op3_jaccard_join(spark, sf_dir):
    return jaccard.similar_documents(documents(spark, sf_dir))


@query(quality.SQL.format(documents="documents"))
def op4_quality_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir))


@query()
def op5_decontamination(spark, sf_dir):
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(lines.SQL.format(documents="documents"))
def op6_line_dedup(spark, sf_dir):
    found = lines.dedup_lines(documents(spark, sf_dir))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return found.select("doc.doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


@query()
def op7_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, WORDS, end_id=2)
    return token_files.file_checksums(spark, path)


@query(substring.SQL.format(documents="documents"))
def op8_substring_dedup(spark, sf_dir):
    found = substring.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_token_counts(spark, sf_dir):
    return token_count.count_tokens(documents(spark, sf_dir), PIECES)


@query()
def op10_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    found = toxicity.score_toxicity(docs, labels, fold(5) != 0)
    return found.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(mixing.SQL.format(documents="documents"))
def op13_mixing(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op12_alignment(spark, sf_dir):
    return alignment.align_tokenizers(documents(spark, sf_dir), BYTES, PIECES)
