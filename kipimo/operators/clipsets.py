"""Datasets of clips: assembly from frames, statistics, audits."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips as C
from ..functions.columns import safe_rate, usable_fps
from ..functions.layout import FULL_BODY, TARGET_LENGTH, Layout
from .moments import position_moments
from .quantiles import exact_quantiles, with_quantiles
from .tables import listed, one_row


def frames_to_clips(
    frames: DataFrame, keys: list[str], index: str = "frame_index", vector: str = "x"
) -> DataFrame:
    """Frame table -> clip rows (``frames`` ordered by index).

    One key is one clip, which is one row and has to fit into a task.  Recordings of
    any length are better kept as frames: :func:`resample_frames` brings them to clip
    length first, and counts and statistics need no clips at all.
    """
    return (
        frames.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(vector).alias("x")))).alias("f"))
        .withColumn("frames", F.transform("f", lambda s: s["x"]))
        .drop("f")
    )


def resample_frames(
    frames: DataFrame,
    keys: list[str],
    index: str = "frame_index",
    vector: str = "x",
    n: int = TARGET_LENGTH,
) -> DataFrame:
    """Linear resampling straight from a frame table, for recordings of any length.

    Indices run 0..T-1.  Output k needs the frames around k(T-1)/(n-1), so at
    most 2n frames per recording are collected: those below 2n are kept as they
    come, later ones only where a join on (recording, index) asks for them.  One
    recording may hold most of the table without any task seeing all of it.
    """
    window = 2 * n
    gap = F.raise_error(F.lit("frame indices must run from 0 without a gap")).cast("long")
    last = F.max(index).cast("long")
    whole = (F.count(index) == last + 1) & (F.min(index) == 0)
    lengths = frames.groupBy(*keys).agg(F.when(whole, last + 1).otherwise(gap).alias("_t"))
    step = F.col("_k") * (F.col("_t") - 1)
    asked = (
        lengths.filter(F.col("_t") > window)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("_lo", F.floor(step / (n - 1)))
        .withColumn(
            index,
            F.explode(F.array("_lo", F.least(F.col("_lo") + 1, F.col("_t") - 1))),
        )
        .select(*keys, index)
    )
    late = frames.filter(F.col(index) >= window).join(asked, [*keys, index], "left_semi")
    picked = frames.filter(F.col(index) < window).unionByName(late)
    collected = picked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(vector).alias("x")))).alias("f"),
    )
    checked = lengths.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_t")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    whole = collected.join(checked, same).filter("_t > 0").select(*keys, "f")

    def frame(k):
        last = F.element_at("at", -1)
        step = k * last
        lo = F.floor(step / (n - 1))
        weight = (step % (n - 1)) / F.lit(float(n - 1))

        def vector_at(i):
            place = F.array_position("at", i.cast(picked.schema[index].dataType))
            return F.get(F.col("f"), place.cast("int") - 1)["x"]

        return F.zip_with(
            vector_at(lo),
            vector_at(F.least(lo + 1, last)),
            lambda a, b: (a.cast("double") + (b.cast("double") - a.cast("double")) * weight).cast(
                "float"
            ),
        )

    return whole.withColumn("at", F.transform("f", lambda s: s["i"])).select(
        *keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), frame).alias("frames")
    )


def normalize_frames(frames: DataFrame, vector: str = "x", layout: Layout = FULL_BODY) -> DataFrame:
    """Every frame of a frame table centred and scaled by its own shoulders."""
    moved = C.normalize_geometry(F.array(vector), layout)
    return frames.withColumn(vector, F.get(moved, F.lit(0)))


def audit_frames(
    frames: DataFrame, keys: list[str], vector: str = "x", layout: Layout = FULL_BODY
) -> DataFrame:
    """Per recording: ``geometry`` and ``missingness_before``, as of clips, from a frame table.

    Frames are judged one by one and added up in each task, so a recording of any length
    is one row per task.
    """
    frame = F.col(vector)
    missing = {name: C.missing_points(frame, *span) for name, span in layout.blocks().items()}
    judged = frames.select(
        *keys, C.frame_anchor(frame, layout).alias("_a"), *[m.alias(f"_{name}") for name, m in missing.items()]
    )
    total, used = F.count(F.lit(1)), F.count_if(F.col("_a.normalised"))
    return judged.groupBy(*keys).agg(
        F.struct(
            total.cast("int").alias("frames"),
            used.cast("int").alias("geometry_normalised_frames"),
            (total - used).cast("int").alias("geometry_fallback_frames"),
            F.avg("_a.scale").alias("mean_scale"),
        ).alias("geometry"),
        F.struct(
            *[
                (F.sum(f"_{name}") / (total * count)).alias(f"{name}_missing_rate")
                for name, (_, count) in layout.blocks().items()
            ]
        ).alias("missingness_before"),
    )


def detection_rate(
    frames: DataFrame,
    keys: list[str],
    vector: str = "x",
    fps: str = "fps",
    layout: Layout = FULL_BODY,
) -> DataFrame:
    """Per clip: frames read, frames with any non-zero hand value, rate, duration."""
    hands = F.slice(F.col(vector), layout.pose_width + 1, layout.source_width)
    seen = F.exists(hands, lambda x: F.abs(x) > 0)
    read, detected = F.col("frames_read"), F.col("frames_detected")
    return (
        frames.groupBy(*keys)
        .agg(
            F.count("*").alias("frames_read"),
            F.count_if(seen).alias("frames_detected"),
            F.max(usable_fps(F.col(fps))).alias("_fps"),
        )
        .withColumn("duration_seconds", F.round(read / F.col("_fps"), 6))
        .withColumn("detection_rate", F.round(safe_rate(detected, read), 6))
        .drop("_fps")
    )


def fit_feature_stats(clips: DataFrame, frames: str = "frames") -> DataFrame:
    """One row (mean, std): population statistics per feature over all frames.

    Each task sends one row of moments; the result has the feature width, whatever
    the data size.
    """
    row = F.struct("at", "mean", "std")
    return (
        position_moments(clips, frames)
        .agg(F.array_sort(F.collect_list(row)).alias("a"))
        .select(
            F.transform("a", lambda r: r["mean"]).alias("mean"),
            F.transform("a", lambda r: r["std"]).alias("std"),
        )
    )


def join_feature_stats(clips: DataFrame, stats: DataFrame) -> DataFrame:
    """Every clip with the one-row statistics table (feature width only).

    Fails unless ``stats`` has exactly one row.
    """
    return clips.crossJoin(F.broadcast(one_row(stats.select("mean", "std"), "feature statistics")))


def class_counts(clips: DataFrame, by=("split", "label")) -> DataFrame:
    return clips.groupBy(*by).agg(F.count("*").alias("count"))


def shape_histogram(clips: DataFrame, frames: str = "frames", by=("split",)) -> DataFrame:
    """Clip shapes per split, most common first."""
    return (
        clips.groupBy(
            *by,
            F.size(frames).alias("length"),
            F.size(F.get(F.col(frames), F.lit(0))).alias("width"),
        )
        .agg(F.count("*").alias("count"))
        .withColumn(
            "rank",
            F.row_number().over(
                Window.partitionBy(*by).orderBy(F.desc("count"), "length", "width")
            ),
        )
    )


def length_summary(lengths: DataFrame, by=("split",)) -> DataFrame:
    """Frame-length statistics per split from rows with a ``length``."""
    summary = lengths.groupBy(*by).agg(
        F.count("*").alias("clips"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.avg("length"), 3).alias("mean_length"),
    )
    middle = exact_quantiles(lengths, list(by), {"median_length": ("length", 0.5)})
    return with_quantiles(summary, middle, list(by))


def array_profile(
    vectors: DataFrame, column: str, ranges: dict[str, tuple[int, int]]
) -> DataFrame:
    """Profile of feature vectors per index range [first, end).

    Count, min, max, mean, population std, largest and mean absolute value,
    whether all are finite, and how many are zero within 1e-8.
    """
    names = F.array(*[F.lit(name) for name in ranges])
    found = position_moments(vectors, column, list(ranges.values()))
    return found.select(
        F.get(names, F.col("at")).alias("range"),
        F.col("n").alias("count"),
        *["min", "max", "mean", "std", "max_abs", "mean_abs", "all_finite", "near_zero"],
    )


def valid_clips(clips: DataFrame, width: int, length: int | None = None) -> DataFrame:
    """Adds ``reason`` (null when usable) and ``valid``."""
    return clips.withColumn("reason", C.clip_reason(F.col("frames"), width, length)).withColumn(
        "valid", F.col("reason").isNull()
    )


def first_per_class(clips: DataFrame, labels: list[str]) -> DataFrame:
    """First file by name of every listed label, in one aggregate row unfolded.

    A label without files fails, and so does a label that is not listed.
    """
    label = listed(F.col("label"), labels)
    firsts = clips.agg(*[F.min(F.when(label == x, F.col("file"))).alias(x) for x in labels])
    cells = F.array(
        *[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("file")) for x in labels]
    )
    missing = F.raise_error(F.concat(F.lit("no files for class "), F.col("label")))
    return firsts.select(F.inline(cells)).withColumn(
        "file", F.coalesce("file", missing.cast("string"))
    )
