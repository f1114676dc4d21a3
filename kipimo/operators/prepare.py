"""Composed clip preparation, two interchangeable ways.

``*_columns`` composes the Column functions.  The Arrow versions do the same on a
whole batch of clips at once: the nested column is viewed as one frame matrix,
resampling is two gathers, and no Python loop touches a frame.  Both give the
same clips (see the tests); the Arrow path is the default because nested
higher-order functions are interpreted per element.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clips as C
from ..functions.layout import COORDINATES, FULL_BODY, MIN_SCALE, MISSING_ATOL, TARGET_LENGTH, Layout
from ..schemas import CLIP
from .clipsets import audit_frames, normalize_frames, resample_frames
from .selection import same_keys

_SLICE = 256


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all frames of the batch stacked, frame count per clip)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    frames = column.flatten()
    widths = np.asarray(frames.value_lengths())
    if widths.size and (widths != widths[0]).any():
        raise ValueError("frames of different widths in one batch")
    width = int(widths[0]) if widths.size else 0
    values = np.asarray(frames.flatten(), dtype=np.float64)
    return values.reshape(len(widths), width), lengths


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _resample(frames: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """(clips, n, width) by linear interpolation; all clips in two gathers."""
    starts = np.cumsum(lengths) - lengths
    step = np.arange(n) * (lengths[:, None] - 1)
    lo = step // (n - 1)
    hi = np.minimum(lo + 1, lengths[:, None] - 1)
    weight = ((step % (n - 1)) / float(n - 1))[..., None]
    a, b = frames[starts[:, None] + lo], frames[starts[:, None] + hi]
    return (a + (b - a) * weight).astype(np.float32)


def _standardise(clips: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    safe = np.where(np.abs(std) < MISSING_ATOL, 1.0, std)
    return ((clips.astype(np.float64) - mean[:, None, :]) / safe[:, None, :]).astype(np.float32)


def _column(clips: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Clips back as a nested list column; clips without frames become null."""
    kept, n, width = clips.shape
    inner = pa.ListArray.from_arrays(
        np.arange(0, kept * n * width + 1, max(width, 1), dtype=np.int32), pa.array(clips.ravel())
    )
    ends = np.concatenate([[0], np.cumsum(np.where(lengths > 0, n, 0))]).astype(np.int32)
    mask = pa.array(lengths == 0)
    return pa.ListArray.from_arrays(pa.array(ends), inner, mask=mask)


def _ready(select, layout: Layout, n: int):
    """Function of (frames, mean, std) arrays: resampled, padded, standardised clips."""

    def ready(frames: pa.Array, mean: pa.Array, std: pa.Array) -> pa.Array:
        stacked, lengths = _matrix(frames)
        usable = lengths > 0
        if not usable.any():
            return pa.nulls(len(frames), pa.list_(pa.list_(pa.float32())))
        short = _resample(select(stacked), lengths[usable], n)
        padded = np.zeros((*short.shape[:2], layout.width), np.float32)
        padded[:, :, : layout.source_width] = short
        standard = _standardise(padded, _vectors(mean)[usable], _vectors(std)[usable])
        return _column(standard, lengths)

    return ready


def _prepare(select, layout: Layout, n: int):
    """Arrow UDF (frames, mean, std) -> resampled, padded, standardised clip.

    Batches are worked off in slices, which bounds what a worker holds whatever
    the session's Arrow batch size.
    """
    ready = _ready(select, layout, n)

    @F.arrow_udf(CLIP)
    def prepare(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]],
    ) -> Iterator[pa.Array]:
        for columns in batches:
            for start in range(0, len(columns[0]), _SLICE):
                yield ready(*[c.slice(start, _SLICE) for c in columns])

    return prepare


def prepare_source(
    frames: Column, mean: Column, std: Column, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH
) -> Column:
    """Source clip -> resample -> pad -> z-score."""
    return _prepare(lambda stacked: stacked, layout, n)(frames, mean, std)


def prepare_native(
    frames: Column, mean: Column, std: Column, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH
) -> Column:
    """Native clip -> hand blocks -> pad -> resample -> z-score."""
    first = layout.pose_width

    def hands(stacked):
        return stacked[:, first : first + layout.source_width]

    return _prepare(hands, layout, n)(frames, mean, std)


def prepare_variants(
    variants: Column, mean: Column, std: Column, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH
) -> Column:
    """:func:`prepare_source` of every clip in an array of clips of one row."""
    ready = _ready(lambda stacked: stacked, layout, n)

    @F.arrow_udf(T.ArrayType(CLIP))
    def prepare(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for start in range(0, len(columns[0]), _SLICE // 8):
                clips, mu, sigma = (c.slice(start, _SLICE // 8) for c in columns)
                counts = np.asarray(clips.value_lengths().fill_null(0))
                row = pa.array(np.repeat(np.arange(len(clips)), counts))
                yield as_lists(ready(clips.flatten(), mu.take(row), sigma.take(row)), counts)

    return prepare(variants, mean, std)


def as_lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Values dealt out into lists of the given lengths."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def prepare_source_columns(frames, mean, std, layout=FULL_BODY, n=TARGET_LENGTH) -> Column:
    return C.zscore(C.pad_features(C.interpolate_linear(frames, n), layout), mean, std)


def prepare_native_columns(frames, mean, std, layout=FULL_BODY, n=TARGET_LENGTH) -> Column:
    padded = C.pad_features(C.select_hand_blocks(frames, layout), layout)
    return C.zscore(C.interpolate_linear(padded, n), mean, std)


def _present(points: np.ndarray) -> np.ndarray:
    return (np.abs(points) > MISSING_ATOL).any(2)


def _anchors(points: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, whether it is normalised) of every frame, from its shoulders."""
    left, right = points[:, layout.left_shoulder], points[:, layout.right_shoulder]
    seen = _present(np.stack([left, right], 1)).all(1)
    width = np.sqrt(((left - right)[:, :2] ** 2).sum(1))
    usable = seen & (width >= MIN_SCALE)
    centre = np.where(seen[:, None], (left + right) / 2.0, 0.0)
    return centre, np.where(usable, width, 1.0), usable


def _moved(points: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames centred and scaled, and their anchors' scale and use."""
    centre, scale, usable = _anchors(points, layout)
    moved = ((points - centre[:, None]) / scale[:, None, None]).astype(np.float32)
    moved[~_present(points)] = 0.0
    return moved, scale, usable


def _missing_rates(points: np.ndarray, lengths: np.ndarray, layout: Layout) -> list[np.ndarray]:
    """Per block the share of missing points of each clip; NaN without frames."""
    clip = np.repeat(np.arange(len(lengths)), lengths)
    absent, rates = ~_present(points), []
    with np.errstate(invalid="ignore", divide="ignore"):
        for first, count in layout.blocks().values():
            missing = np.bincount(clip, absent[:, first : first + count].sum(1), len(lengths))
            rates.append(missing / (lengths * count))
    return rates


def _preprocessed(column: pa.Array, layout: Layout, n: int) -> pa.StructArray:
    stacked, lengths = _matrix(column)
    used = lengths > 0
    if not used.any():
        stacked = np.zeros((0, layout.width))  # clips without frames only
    elif stacked.shape[1] != layout.width:
        raise ValueError(f"frames of {stacked.shape[1]} values, not {layout.width}")
    points = stacked.reshape(len(stacked), layout.points, COORDINATES)
    moved, scale, usable = _moved(points, layout)
    clip = np.repeat(np.arange(len(lengths)), lengths)
    normalised = np.bincount(clip, usable, len(lengths)).astype(np.int32)
    with np.errstate(invalid="ignore"):
        mean_scale = np.bincount(clip, scale, len(lengths)) / lengths
    short = _resample(moved.reshape(len(moved), layout.width).astype(np.float64), lengths[used], n)
    after = [np.full(len(lengths), np.nan) for _ in layout.blocks()]
    at_end = short.reshape(-1, layout.points, COORDINATES)
    for whole, some in zip(after, _missing_rates(at_end, np.full(int(used.sum()), n), layout)):
        whole[used] = some

    def rates(parts):
        names = [f"{name}_missing_rate" for name in layout.blocks()]
        return pa.StructArray.from_arrays([pa.array(p, from_pandas=True) for p in parts], names)

    return pa.StructArray.from_arrays(
        [
            _column(short, lengths),
            rates(_missing_rates(points, lengths, layout)),
            rates(after),
            pa.array(normalised),
            pa.array(mean_scale, from_pandas=True),
        ],
        ["sequence", "missingness_before", "missingness_after", "normalised", "mean_scale"],
    )


def preprocess(frames: Column, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH) -> Column:
    """struct(sequence, missingness_before, missingness_after, normalised, mean_scale) of a clip.

    One pass over the stacked frames of a batch, in slices.
    """
    rates = "struct<" + ",".join(f"{b}_missing_rate:double" for b in layout.blocks()) + ">"
    kind = f"sequence {CLIP.simpleString()}, missingness_before {rates}, missingness_after {rates}, normalised int, mean_scale double"

    @F.arrow_udf(T.StructType.fromDDL(kind))
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for start in range(0, len(column), _SLICE):
                yield _preprocessed(column.slice(start, _SLICE), layout, n)

    return whole(frames)


def preprocess_clips(
    clips: DataFrame, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH
) -> DataFrame:
    """Missingness -> geometry -> resampling -> missingness, one row per clip.

    Adds ``sequence`` (the n-frame clip) and the diagnostics of every step.  All steps
    are one Arrow function; :func:`preprocess_clips_columns` is the same in columns.
    """
    frames, done = F.col("frames"), F.col("_done")
    normalised = F.when(frames.isNotNull(), done["normalised"])
    with_shape = clips.withColumn("_done", preprocess(frames, layout, n))
    return (
        with_shape.withColumn("missingness_before", done["missingness_before"])
        .withColumn(
            "geometry",
            F.struct(
                F.size(frames).alias("frames"),
                normalised.alias("geometry_normalised_frames"),
                (F.size(frames) - normalised).alias("geometry_fallback_frames"),
                done["mean_scale"].alias("mean_scale"),
            ),
        )
        .withColumn("sequence", done["sequence"])
        .withColumn("missingness_after", done["missingness_after"])
        .withColumn("original_shape", F.array(F.size(frames), F.size(F.get(frames, F.lit(0)))))
        .withColumn("output_shape", F.array(F.size("sequence"), F.size(F.get(F.col("sequence"), F.lit(0)))))
        .drop("_done")
    )


def preprocess_clips_columns(
    clips: DataFrame, layout: Layout = FULL_BODY, n: int = TARGET_LENGTH
) -> DataFrame:
    """:func:`preprocess_clips` as Column expressions.

    Columns are added step by step so that no step is computed twice.
    """
    frames = F.col("frames")
    return (
        clips.withColumn("missingness_before", C.missingness(frames, layout))
        .withColumn("geometry", C.geometry_diagnostics(frames, layout))
        .withColumn("sequence", C.interpolate_linear(C.normalize_geometry(frames, layout), n))
        .withColumn("missingness_after", C.missingness(F.col("sequence"), layout))
        .withColumn("original_shape", F.array(F.size(frames), F.size(F.get(frames, F.lit(0)))))
        .withColumn(
            "output_shape",
            F.array(F.size("sequence"), F.size(F.get(F.col("sequence"), F.lit(0)))),
        )
    )


def preprocess_frames(
    frames: DataFrame,
    keys: list[str],
    index: str = "frame_index",
    vector: str = "x",
    layout: Layout = FULL_BODY,
    n: int = TARGET_LENGTH,
) -> DataFrame:
    """:func:`preprocess_clips` from a frame table, for recordings of any length.

    One row per recording: keys, geometry, missingness_before, sequence,
    missingness_after.  Frames are judged and moved where they lie, counts are added up
    in each task, and only the frames that resampling asks for come together.
    """
    audit = audit_frames(frames, keys, vector, layout)
    moved = normalize_frames(frames, vector, layout)
    short = resample_frames(moved, keys, index, vector, n).withColumnRenamed("frames", "sequence")
    named = short.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "sequence")
    done = audit.join(named, same_keys(keys, "_of_")).drop(*[f"_of_{k}" for k in keys])
    return done.withColumn("missingness_after", C.missingness(F.col("sequence"), layout))
