"""The queries behind the report charts; drawing is left to the caller."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chart axes reach past the data by 8 % of its range, at least 0.02.
AXIS_SHARE = 0.08
AXIS_FLOOR = 0.02


def feed_sample_wer(scored: DataFrame, order: list[str]) -> DataFrame:
    """Utterances by word error rate, lowest first."""
    return scored.orderBy(F.asc("wer"), *order)


def feed_error_stack(totals: DataFrame) -> DataFrame:
    """S/D/I rates per model with the base each bar segment starts from."""
    s, d, i = (F.col(f"{k}_rate") for k in ("substitution", "deletion", "insertion"))
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("pos"), F.lit(n).alias("error"), r.alias("rate"), b.alias("base"))
            for p, n, r, b in (
                (0, "substitution", s, F.lit(0.0)),
                (1, "deletion", d, s),
                (2, "insertion", i, s + d),
            )
        ]
    )
    return totals.select("model", F.explode(cells).alias("c")).select(
        "model", "c.pos", "c.error", "c.rate", F.round("c.base", 6).alias("base")
    )


def feed_accuracy_efficiency(by_model: DataFrame) -> DataFrame:
    return by_model.select("model", "realtime_factor", "mean_wer")


def feed_shift_difference(records: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Per pair the shift of model a minus model b, ordered by its size."""
    shift = "representational_shift"
    difference = F.col("models")[a][shift] - F.col("models")[b][shift]
    return records.withColumn("difference", F.round(difference, 6)).orderBy(
        F.abs("difference"), *order
    )


def feed_similarity_space(gaps: DataFrame) -> DataFrame:
    """Both similarities per pair and, on every row, the common axis limits.

    The limits are a one-row aggregate, so attaching them is a tiny broadcast.
    """
    low = F.least(F.min("similarity_a"), F.min("similarity_b"))
    high = F.greatest(F.max("similarity_a"), F.max("similarity_b"))
    margin = F.greatest(F.lit(AXIS_FLOOR), (high - low) * AXIS_SHARE)
    limits = gaps.agg(
        F.round(low - margin, 6).alias("axis_low"), F.round(high + margin, 6).alias("axis_high")
    )
    return gaps.crossJoin(F.broadcast(limits))


def feed_category_disagreement(by_category: DataFrame) -> DataFrame:
    return by_category.select("category", "mean_abs_gap").orderBy("mean_abs_gap", "category")
