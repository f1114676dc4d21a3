"""Sentence-pair evaluation: similarity, separation, sensitivity.

Inputs are record tables (``models`` map per pair), so both models of a pair sit
in one row and comparing them needs no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, with_quantiles
from .tables import melt_models, score_of, top_per_group

# Which categories and effects form which group.
SIMILAR = ("paraphrase", "informal", "code_switching")
RELATED = ("topical_similarity",)
CONTRAST = ("contrast",)
UNRELATED = ("unrelated",)
MEANING_CHANGING = ("meaning_change", "temporal_change", "participant_change")
MEANING_PRESERVING = ("meaning_preserving", "approximately_meaning_preserving")


def relation_group(category: Column) -> Column:
    return (
        F.when(category.isin(*SIMILAR), "similar")
        .when(category.isin(*RELATED), "related")
        .when(category.isin(*CONTRAST), "contrast")
        .when(category.isin(*UNRELATED), "unrelated")
    )


def effect_group(effect: Column) -> Column:
    return F.when(effect.isin(*MEANING_CHANGING), "meaning_changing").when(
        effect.isin(*MEANING_PRESERVING), "meaning_preserving"
    )


def model_gap(records: DataFrame, a: str, b: str) -> DataFrame:
    """Adds both similarities, latencies and their unrounded gap."""
    gap = F.col("similarity_a") - F.col("similarity_b")
    return (
        records.withColumn("similarity_a", score_of(a, "similarity"))
        .withColumn("similarity_b", score_of(b, "similarity"))
        .withColumn("latency_a", score_of(a, "inference_time_ms"))
        .withColumn("latency_b", score_of(b, "inference_time_ms"))
        .withColumn("gap", gap)
        .withColumn("abs_gap", F.abs(gap))
    )


def rep_shift(similarity: Column) -> Column:
    return F.round(1.0 - similarity, 6)


def _mean(column, digits=6):
    return F.round(F.avg(column), digits)


def similarity_by_category(gaps: DataFrame, digits: int = 6, ms_digits: int = 3) -> DataFrame:
    return gaps.groupBy("category").agg(
        F.count("*").alias("count"),
        _mean("similarity_a", digits).alias("mean_similarity_a"),
        _mean("similarity_b", digits).alias("mean_similarity_b"),
        _mean("gap", digits).alias("mean_gap"),
        _mean("abs_gap", digits).alias("mean_abs_gap"),
        _mean("latency_a", ms_digits).alias("mean_latency_a"),
        _mean("latency_b", ms_digits).alias("mean_latency_b"),
    )


def similarity_global(gaps: DataFrame, digits: int = 6, ms_digits: int = 3) -> DataFrame:
    """One row: means and medians of both models and of the gap."""
    places = dict.fromkeys(("similarity_a", "similarity_b", "gap"), digits)
    places |= dict.fromkeys(("latency_a", "latency_b"), ms_digits)
    means = gaps.agg(
        F.count("*").alias("count"),
        *[_mean(c, d).alias(f"mean_{c}") for c, d in places.items()],
        _mean("abs_gap", digits).alias("mean_abs_gap"),
    )
    medians = exact_quantiles(gaps, [], {f"median_{c}": (c, 0.5) for c in places})
    rounded = medians.select(*[F.round(f"median_{c}", d).alias(f"median_{c}") for c, d in places.items()])
    return with_quantiles(means, rounded, [])


def category_stats(records: DataFrame, digits: int = 6) -> DataFrame:
    long = melt_models(records).select("model", "category", "similarity")
    by = ["model", "category"]
    stats = long.groupBy(*by).agg(
        F.count("*").alias("count"),
        _mean("similarity", digits).alias("mean"),
        F.min("similarity").alias("min"),
        F.max("similarity").alias("max"),
    )
    medians = exact_quantiles(long, by, {"median": ("similarity", 0.5)})
    return with_quantiles(stats, medians.withColumn("median", F.round("median", digits)), by)


def semantic_separation(records: DataFrame, digits: int = 6) -> DataFrame:
    """Per model: group counts and means, similar minus unrelated and minus contrast.

    Differences are null where a side has no pairs.
    """
    long = melt_models(records).select(
        "model", "similarity", relation_group(F.col("category")).alias("relation")
    )
    groups = ("similar", "related", "contrast", "unrelated")

    def of(group):
        return F.when(F.col("relation") == group, F.col("similarity"))

    return long.groupBy("model").agg(
        *[F.count(of(g)).alias(f"{g}_count") for g in groups],
        *[_mean(of(g), digits).alias(f"{g}_mean") for g in groups],
        F.round(F.avg(of("similar")) - F.avg(of("unrelated")), digits).alias("semantic_separation"),
        F.round(F.avg(of("similar")) - F.avg(of("contrast")), digits).alias("contrast_separation"),
    )


def score_gap(
    per_model: DataFrame, scores: list[str], a: str, b: str, digits: int = 6
) -> DataFrame:
    """One row: model a minus model b of already rounded scores."""

    def value(model, score):
        return F.max(F.when(F.col("model") == model, F.col(score)))

    return per_model.agg(
        *[F.round(value(a, s) - value(b, s), digits).alias(f"{s}_gap") for s in scores]
    )


def phenomenon_shift(records: DataFrame, digits: int = 6) -> DataFrame:
    return (
        melt_models(records)
        .groupBy("phenomenon", "model")
        .agg(
            F.count("*").alias("count"),
            _mean("representational_shift", digits).alias("mean_shift"),
            F.round(F.min("representational_shift"), 6).alias("min_shift"),
            F.round(F.max("representational_shift"), 6).alias("max_shift"),
        )
    )


def _effects(records: DataFrame) -> DataFrame:
    """Long shifts with their effect group; other effects are dropped."""
    return (
        melt_models(records)
        .withColumn("effect_group", effect_group(F.col("semantic_effect")))
        .filter("effect_group is not null")
    )


def sensitivity_score(records: DataFrame, digits: int = 6) -> DataFrame:
    """Per model: mean shift of changing and preserving edits, and the difference."""
    shift = F.col("representational_shift")
    changing = F.when(F.col("effect_group") == "meaning_changing", shift)
    preserving = F.when(F.col("effect_group") == "meaning_preserving", shift)
    return _effects(records).groupBy("model").agg(
        F.count(changing).alias("changing_count"),
        F.count(preserving).alias("preserving_count"),
        _mean(changing, digits).alias("changing_mean_shift"),
        _mean(preserving, digits).alias("preserving_mean_shift"),
        F.round(F.avg(changing) - F.avg(preserving), digits).alias("sensitivity_score"),
    )


def sensitivity_failures(records: DataFrame, k: int = 5, order=("input_pos",)) -> DataFrame:
    """Per model, the k meaning-changing edits that moved the vectors least."""
    changing = _effects(records).filter("effect_group = 'meaning_changing'")
    return top_per_group(changing, ["model"], [F.asc("representational_shift"), *order], k)


def invariance_failures(records: DataFrame, k: int = 5, order=("input_pos",)) -> DataFrame:
    """Per model, the k meaning-preserving edits that moved the vectors most."""
    kept = _effects(records).filter("effect_group = 'meaning_preserving'")
    return top_per_group(kept, ["model"], [F.desc("representational_shift"), *order], k)


def top_disagreements(gaps: DataFrame, k: int = 10, order=("input_pos",)) -> DataFrame:
    return gaps.orderBy(F.desc("abs_gap"), *order).limit(k)


def fastest_model(records: DataFrame, models: list[str]) -> DataFrame:
    """Per pair the fastest and the most similar model; ties go to the earlier one.

    Works inside the row: no shuffle.
    """
    entries = F.array(
        *[
            F.struct(
                score_of(m, "inference_time_ms").alias("latency"),
                (-score_of(m, "similarity")).alias("unlike"),
                F.lit(pos).alias("pos"),
                F.lit(m).alias("model"),
            )
            for pos, m in enumerate(models)
        ]
    )

    def least(field):
        keyed = F.transform(entries, lambda e: F.struct(e[field], e["pos"], e["model"]))
        return F.array_min(keyed)["model"]

    return records.withColumn("fastest_model", least("latency")).withColumn(
        "highest_similarity_model", least("unlike")
    )


def score_pairs(pairs: DataFrame, vectors: DataFrame, cosine_digits: int = 6) -> DataFrame:
    """Manifest (id, text_a, text_b, ...) and text vectors (model, text, vector)
    -> long scores.

    Each side is looked up by text; a text used by very many pairs is a skewed
    key that AQE splits, and vectors are joined after cutting them to the columns
    needed.  A pair whose text has no vector stays, with a null similarity (and a
    null model if that is the first text).
    """
    from ..functions.vectors import cosine

    side_a = vectors.select("model", F.col("text").alias("text_a"), F.col("vector").alias("va"))
    side_b = vectors.select("model", F.col("text").alias("text_b"), F.col("vector").alias("vb"))
    joined = pairs.join(side_a, "text_a", "left").join(side_b, ["model", "text_b"], "left")
    return joined.withColumn(
        "similarity", cosine(F.col("va"), F.col("vb"), cosine_digits)
    ).drop("va", "vb")
