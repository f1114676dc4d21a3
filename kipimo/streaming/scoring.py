"""Scoring of newly landed files with the batch operators.

The operators are row-local, so the stream keeps no state and needs no watermark;
the checkpoint folder gives exactly-once appends to the file sink.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.speech import normalise_utterances, score_utterances

UTTERANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "category", "model")]
    + [T.StructField(n, T.StringType()) for n in ("reference_raw", "hypothesis_raw")]
)


def score_utterance_rows(df: DataFrame) -> DataFrame:
    return score_utterances(normalise_utterances(df), digits=6)


def score_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    schema: T.StructType = UTTERANCE,
    transform: Callable[[DataFrame], DataFrame] = score_utterance_rows,
    files_per_batch: int = 1000,
):
    """Score every JSON file not seen before, append Parquet, then stop.

    Returns the query after it has caught up.  Run it on a schedule, or replace
    the trigger for continuous service.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    )
    query = (
        transform(arriving)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
