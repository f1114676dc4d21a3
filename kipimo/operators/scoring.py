"""Batch scoring of prepared clips and uncertainty metrics of predictions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .prepare import as_lists


def score_clips(
    clips: DataFrame,
    make_predict_fn,
    labels: list[str],
    length: int,
    width: int,
    frames: str = "prepared",
    batch_size: int = 256,
) -> DataFrame:
    """Adds ``p`` (class probabilities), in model class order.

    A clip that is null or empty is scored as zeros, which every model takes, and gets
    a null ``p``: one unusable file does not end the job.

    ``make_predict_fn`` is called once per Python worker and returns a function
    from a (batch, length, width) array to a (batch, classes) array.

    The flattened clip is referenced twice so that the optimizer leaves it in its
    own projection: a UDF whose argument holds a lambda is not planned correctly.
    """
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[length, width]],
    )
    flat = clips.withColumn("_flat", F.flatten(frames))
    usable = F.size("_flat") > 0
    blank = F.array_repeat(F.lit(0.0).cast("float"), length * width)
    tensor = F.when(usable, F.col("_flat")).otherwise(blank)
    scored = flat.withColumn("p", predict(tensor).cast("array<double>"))
    scored = scored.withColumn("p", F.when(usable, F.col("p"))).drop("_flat")
    return scored.withColumn("labels", labels_column(labels))


def score_variants(
    clips: DataFrame,
    make_predict_fn,
    labels: list[str],
    length: int,
    width: int,
    variants: str = "prepared",
    batch_size: int = 256,
) -> DataFrame:
    """Adds ``ps``: class probabilities of every clip in an array of clips of one row.

    All clips of a batch go to the model together, ``batch_size`` at a time, and their
    results stay side by side in the row; a null or empty clip gets null.
    ``make_predict_fn`` is as for :func:`score_clips` and called once per task.
    """

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predict_fn()
        for column in batches:
            for start in range(0, len(column), batch_size):
                rows = column.slice(start, batch_size)
                counts = np.asarray(rows.value_lengths().fill_null(0))
                flat = rows.flatten()
                frames = np.asarray(flat.value_lengths().fill_null(0))
                if not np.isin(frames, (0, length)).all():
                    raise ValueError(f"clips of another length than {length}")
                usable = np.flatnonzero(frames)
                values = np.asarray(flat.flatten().flatten(), np.float32).reshape(-1, length, width)
                found = [predict(values[at : at + batch_size]) for at in range(0, len(values), batch_size)]
                p = np.concatenate([np.zeros((0, len(labels)), np.float32), *found]).astype(np.float32)
                ends = np.zeros(len(flat) + 1, np.int32)
                ends[usable + 1] = p.shape[1]
                missing = np.append(frames == 0, False)
                single = pa.ListArray.from_arrays(
                    pa.array(np.cumsum(ends, dtype=np.int32), mask=missing), pa.array(p.ravel())
                )
                yield as_lists(single, counts)

    scored = clips.withColumn("ps", predicted(F.col(variants)).cast("array<array<double>>"))
    return scored.withColumn("labels", labels_column(labels))


def labels_column(labels: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def with_metrics(scored: DataFrame, label: str | None = "label") -> DataFrame:
    """Prediction metrics of rows with ``p`` and ``labels``; null where ``p`` is."""
    p = F.col("p")
    out = (
        scored.withColumn("predictions", V.rank_classes(p, F.col("labels")))
        .withColumn("predicted", F.get(F.col("predictions"), F.lit(0))["label"])
        .withColumn("max_probability", V.max_probability(p))
        .withColumn("margin", V.prediction_margin(p))
        .withColumn("normalized_entropy", V.normalized_entropy(p))
    )
    if label is None:
        return out
    return out.withColumn("correct", F.col("predicted") == F.col(label)).withColumn(
        "true_probability",
        F.when(p.isNotNull(), V.probability_of(F.col("predictions"), F.col(label))),
    )


def late_weighted_scorer(
    length: int, width: int, class_features: list[list[int]], sharpness: float = 8.0
):
    """A deterministic stand-in model for tests and benchmarks, not a trained one.

    A class scores the sum of its features, averaged over the frames with weight
    (frame + 1) so that the order of frames matters, through a softmax.
    """

    def make():
        import numpy as np

        weights = np.arange(1, length + 1, dtype=np.float64)
        weights /= weights.sum()

        def predict(batch):
            clips = np.asarray(batch, dtype=np.float64).reshape(-1, length, width)
            late = np.einsum("t,btf->bf", weights, clips)
            logits = sharpness * np.stack([late[:, f].sum(axis=1) for f in class_features], axis=1)
            exps = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (exps / exps.sum(axis=1, keepdims=True)).astype(np.float32)

        return predict

    return make
