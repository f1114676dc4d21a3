"""Clip reliability: conditions, summaries, thresholds, rejection, ablation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips as C
from ..functions.conditions import ABLATIONS, PROBES
from ..functions.layout import FULL_BODY, TARGET_LENGTH, Layout
from .clipsets import join_feature_stats
from .prepare import prepare_source, prepare_variants
from .quantiles import exact_quantiles, with_quantiles
from .scoring import with_metrics
from .tables import grid, listed, one_row

_UNCERTAINTY = {
    "median_max_probability": ("max_probability", 0.5),
    "p05_max_probability": ("max_probability", 0.05),
    "p05_margin": ("margin", 0.05),
    "p95_normalized_entropy": ("normalized_entropy", 0.95),
}


def cross_conditions(
    clips: DataFrame, registry, apply, names=None, frames: str = "frames"
) -> DataFrame:
    """Every clip under every condition: one explode, no join.

    ``apply(condition, frames)`` builds the transformed clip.
    """
    chosen = [registry[n] for n in names] if names else list(registry.values())
    cells = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("condition"), apply(c, F.col(frames)).alias(frames)
            )
            for c in chosen
        ]
    )
    keep = [c for c in clips.columns if c != frames]
    return clips.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def probe_clips(
    clips: DataFrame, stats: DataFrame, key: str, layout: Layout = FULL_BODY, registry=PROBES
) -> DataFrame:
    """Source clips under every probe, prepared for the model (``prepared``)."""
    probed = cross_conditions(clips, registry, lambda c, f: c.apply(f, F.col(key)))
    ready = join_feature_stats(probed, stats)
    return ready.withColumn(
        "prepared", prepare_source(F.col("frames"), F.col("mean"), F.col("std"), layout)
    ).drop("frames", "mean", "std")


def ablate_clips(
    clips: DataFrame, stats: DataFrame, layout: Layout = FULL_BODY, registry=ABLATIONS
) -> DataFrame:
    """Resampled source clips under every ablation, prepared for the model.

    Resampling runs once per clip, before the clip is multiplied; preparing a clip
    that already has the target length only pads and standardises it.
    """
    resampled = clips.withColumn("frames", C.interpolate_linear(F.col("frames"), TARGET_LENGTH))
    ready = join_feature_stats(resampled, stats)
    mean = F.col("mean").cast("array<float>")
    ablated = cross_conditions(ready, registry, lambda c, f: c.apply(f, mean, layout))
    prepared = prepare_source(F.col("frames"), F.col("mean"), F.col("std"), layout)
    return ablated.withColumn("prepared", prepared).drop("frames", "mean", "std")


def ablation_variants(
    clips: DataFrame, stats: DataFrame, layout: Layout = FULL_BODY, registry=ABLATIONS
) -> DataFrame:
    """Each clip as one row with ``conditions`` and, in their order, ``prepared`` variants.

    The row form of :func:`ablate_clips`: what belongs to one clip is never taken apart.
    """
    resampled = clips.withColumn("frames", C.interpolate_linear(F.col("frames"), TARGET_LENGTH))
    ready = join_feature_stats(resampled, stats)
    mean = F.col("mean").cast("array<float>")
    chosen = list(registry.values())
    variants = F.array(*[c.apply(F.col("frames"), mean, layout) for c in chosen])
    return (
        ready.withColumn("_variants", variants)
        .withColumn("conditions", F.array(*[F.lit(c.name) for c in chosen]))
        .withColumn("prepared", prepare_variants(F.col("_variants"), F.col("mean"), F.col("std"), layout))
        .drop("frames", "mean", "std", "_variants")
    )


def compared_variants(scored: DataFrame, label: str | None = "label", clean: str = "clean") -> DataFrame:
    """One row per clip and condition with metrics, beside the clean condition of the same row.

    ``scored`` has ``conditions`` and their probabilities ``ps``.  The row form of
    :func:`beside_clean`: nothing is joined, sorted or exchanged.
    """
    at_clean = F.array_position("conditions", clean).cast("int")
    own = with_metrics(scored.withColumn("p", F.get("ps", at_clean - 1)), label)
    passed = [c for c in scored.columns if c not in ("conditions", "ps")]
    cells = F.arrays_zip(F.col("conditions").alias("condition"), F.col("ps").alias("p"))
    rows = own.select(
        *passed,
        F.col("predicted").alias("clean_predicted"),
        F.col("true_probability").alias("clean_true_probability"),
        F.explode(cells).alias("_c"),
    ).select(*passed, "clean_predicted", "clean_true_probability", "_c.condition", "_c.p")
    return _against_clean(with_metrics(rows, label))


def union_conditions(parts: dict[str, DataFrame]) -> DataFrame:
    """Prediction tables stacked with their condition name."""
    named = [df.withColumn("condition", F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


# ---- accuracy --------------------------------------------------------------------


def clip_accuracy(scored: DataFrame, by: str = "method") -> DataFrame:
    return scored.groupBy(by).agg(
        F.count_if("correct").alias("correct"),
        F.count("*").alias("total"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.round(F.avg("max_probability"), 6).alias("mean_max_probability"),
        F.count_if(~F.col("correct")).alias("errors"),
    )


def per_class_accuracy(scored: DataFrame, labels: list[str], by: str = "condition") -> DataFrame:
    """Condition x label counts; every listed label appears, accuracy 0.0 if empty.

    A label that is not listed fails.
    """

    def cell(label):
        mine = listed(F.col("label"), labels) == label
        return F.struct(
            F.count_if(mine & F.col("correct")).alias("correct"), F.count_if(mine).alias("total")
        ).alias(label)

    wide = scored.groupBy(by).agg(*[cell(x) for x in labels])
    long = grid(wide, [by], "label", {x: F.col(f"`{x}`") for x in labels})
    rate = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    return long.withColumn("accuracy", F.round(rate, 6))


def error_rows(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Misclassified clips.

    Unfolded from an array that only a wrong row fills: a filter would be pushed below
    the preparation and scoring of ``scored`` and run both a second time.
    """
    row = F.struct(F.lit(True).alias("_wrong"), *columns)
    wrong = scored.select(F.inline_outer(F.when(~F.col("correct"), F.array(row))))
    return wrong.filter("_wrong").drop("_wrong")


def rank_methods(summary: DataFrame, order=("method",)) -> DataFrame:
    """Rank by accuracy, then mean confidence, then input order; a summary has one
    row per method, so one window partition is enough."""
    by_merit = Window.orderBy(F.desc("accuracy"), F.desc("mean_max_probability"), *order)
    rank = F.row_number().over(by_merit)
    return summary.withColumn("rank", rank).withColumn("best", rank == 1)


# ---- uncertainty -------------------------------------------------------------------


def uncertainty_summary(scored: DataFrame, by: str = "condition") -> DataFrame:
    means = scored.groupBy(by).agg(
        F.count("*").alias("count"),
        *[
            F.round(F.avg(c), 6).alias(f"mean_{c}")
            for c in ("max_probability", "margin", "normalized_entropy")
        ],
    )
    tails = exact_quantiles(scored, [by], _UNCERTAINTY)
    rounded = tails.select(by, *[F.round(c, 6).alias(c) for c in _UNCERTAINTY])
    return with_quantiles(means, rounded, [by])


def id_thresholds(scored: DataFrame, clean: str = "clean_id") -> DataFrame:
    """One row of rejection limits from the clean condition."""
    return exact_quantiles(
        scored.filter(F.col("condition") == clean),
        [],
        {
            "max_probability_lower": ("max_probability", 0.05),
            "margin_lower": ("margin", 0.05),
            "entropy_upper": ("normalized_entropy", 0.95),
        },
    )


def join_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``rejected``; fails unless the threshold table has exactly one row."""
    rejected = (
        (F.col("max_probability") < F.col("max_probability_lower"))
        | (F.col("margin") < F.col("margin_lower"))
        | (F.col("normalized_entropy") > F.col("entropy_upper"))
    )
    limits = F.broadcast(one_row(thresholds, "thresholds"))
    return scored.crossJoin(limits).withColumn("rejected", rejected)


def rejection_rate(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    return (
        join_thresholds(scored, thresholds)
        .groupBy("condition")
        .agg(F.round(F.avg(F.col("rejected").cast("double")), 6).alias("rejection_rate"))
    )


# ---- ablation ----------------------------------------------------------------------


def _against_clean(joined: DataFrame) -> DataFrame:
    return joined.withColumn(
        "prediction_retained", F.col("predicted") == F.col("clean_predicted")
    ).withColumn(
        "true_probability_drop", F.col("clean_true_probability") - F.col("true_probability")
    )


def join_clean_baseline(scored: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """Each prediction beside the clean one of the same clip, from its own table."""
    baseline = clean.select(
        *keys,
        F.col("predicted").alias("clean_predicted"),
        F.col("true_probability").alias("clean_true_probability"),
    )
    return _against_clean(scored.join(baseline, keys))


def beside_clean(scored: DataFrame, keys: list[str], clean: str = "clean") -> DataFrame:
    """Same, when the clean condition is part of ``scored``.

    A window over the few conditions of a clip, so nothing is scored twice.
    """
    is_clean = F.col("condition") == clean
    mates = Window.partitionBy(*keys)
    return _against_clean(
        scored.withColumn(
            "clean_predicted", F.max(F.when(is_clean, F.col("predicted"))).over(mates)
        ).withColumn(
            "clean_true_probability",
            F.max(F.when(is_clean, F.col("true_probability"))).over(mates),
        )
    )


def ablation_summary(compared: DataFrame) -> DataFrame:
    """Per condition: accuracy, retention, mean probabilities, mean and median drop."""

    def share(column):
        return F.round(F.avg(F.col(column).cast("double")), 6)

    summary = compared.groupBy("condition").agg(
        F.count_if("correct").alias("correct"),
        F.count("*").alias("total"),
        share("correct").alias("accuracy"),
        share("prediction_retained").alias("prediction_retention"),
        share("true_probability").alias("mean_true_class_probability"),
        share("max_probability").alias("mean_max_probability"),
        share("true_probability_drop").alias("mean_true_probability_drop"),
    )
    name = "median_true_probability_drop"
    middle = exact_quantiles(compared, ["condition"], {name: ("true_probability_drop", 0.5)})
    return with_quantiles(summary, middle.withColumn(name, F.round(name, 6)), ["condition"])


def id_vs_control(scored: DataFrame, is_control) -> DataFrame:
    """One row: in-distribution means against the control rows, and the gaps."""
    known, control = ~is_control, is_control

    def mean(side, column):
        return F.avg(F.when(side, F.col(column).cast("double")))

    metrics = ("max_probability", "margin", "normalized_entropy")
    return scored.agg(
        F.count_if(known).alias("id_count"),
        F.round(mean(known, "correct"), 6).alias("id_accuracy"),
        *[F.round(mean(known, m), 6).alias(f"mean_id_{m}") for m in metrics],
        *[F.round(mean(control, m), 6).alias(f"control_{m}") for m in metrics],
        F.round(mean(known, "max_probability") - mean(control, "max_probability"), 6).alias(
            "confidence_gap"
        ),
        F.round(mean(known, "margin") - mean(control, "margin"), 6).alias("margin_gap"),
        F.round(mean(control, "normalized_entropy") - mean(known, "normalized_entropy"), 6).alias(
            "entropy_gap"
        ),
    )
