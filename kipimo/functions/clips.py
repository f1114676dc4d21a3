"""Clip-to-clip operators as Column expressions.

A clip is one row holding ``array<array<float>>`` (frames x features), so every
function here is row-local: no shuffle, any partitioning.  Arithmetic is done in
double and stored as float.  An empty or null clip gives null where the operator
needs at least one frame.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .layout import COORDINATES, FULL_BODY, MIN_SCALE, MISSING_ATOL, TARGET_LENGTH, Layout


def _float(value: Column) -> Column:
    return value.cast("float")


def _zeros(n: int) -> Column:
    return F.array_repeat(_float(F.lit(0.0)), n)


def _needs_frames(frames: Column, value: Column) -> Column:
    return F.when(F.size(frames) > 0, value)


# ---- temporal resampling ----------------------------------------------------


def _take(frames: Column, n: int, index) -> Column:
    """n output frames, output k being input frame ``index(k, T)``."""

    def taken(clip):
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda k: F.get(clip, index(k, F.size(clip)).cast("int")),
        )

    return let(frames, lambda clip: _needs_frames(clip, taken(clip)))


def interpolate_linear(frames: Column, n: int = TARGET_LENGTH) -> Column:
    """Linear resampling to n frames, end points kept.

    Output k lies at k(T-1)/(n-1); quotient and remainder of the integer division
    give the left neighbour and the weight without rounding error.
    """

    def resampled(clip):
        def frame(k):
            step = k * (F.size(clip) - 1)
            lo = F.floor(step / (n - 1)).cast("int")
            hi = F.least(lo + 1, F.size(clip) - 1)
            weight = (step % (n - 1)) / F.lit(float(n - 1))
            return let(
                weight,
                lambda w: F.zip_with(
                    F.get(clip, lo),
                    F.get(clip, hi),
                    lambda a, b: _float(
                        a.cast("double") + (b.cast("double") - a.cast("double")) * w
                    ),
                ),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), frame)

    return let(frames, lambda clip: _needs_frames(clip, resampled(clip)))


def resample_nearest(frames: Column, n: int = TARGET_LENGTH) -> Column:
    return _take(frames, n, lambda k, t: F.rint(k * (t - 1) / F.lit(float(n - 1))))


def resample_floor(frames: Column, n: int = TARGET_LENGTH) -> Column:
    return _take(frames, n, lambda k, t: F.floor(k * (t - 1) / F.lit(float(n - 1))))


def pad_repeat_last(frames: Column, n: int = TARGET_LENGTH) -> Column:
    return _take(frames, n, lambda k, t: F.least(k, t - 1))


def pad_zero(frames: Column, n: int = TARGET_LENGTH) -> Column:
    def padded(clip):
        blank = F.transform(F.get(clip, F.lit(0)), lambda _: _float(F.lit(0.0)))
        return F.slice(F.concat(clip, F.array_repeat(blank, n)), 1, n)

    return let(frames, lambda clip: _needs_frames(clip, padded(clip)))


# Method names, in report order.
METHODS = {
    "linear_interpolation": interpolate_linear,
    "nearest_resample": resample_nearest,
    "floor_resample": resample_floor,
    "repeat_last_padding": pad_repeat_last,
    "zero_padding": pad_zero,
}


# ---- features -----------------------------------------------------------------


def pad_point_vector(vector: Column, points: int) -> Column:
    """Missing set -> zeros; short vector zero-padded, long one cut."""
    width = points * COORDINATES
    return F.slice(F.concat(F.coalesce(vector, F.array().cast("array<float>")), _zeros(width)), 1, width)


def select_hand_blocks(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """Native frames -> left and right hand side by side."""
    left = layout.pose_width + 1
    right = left + layout.hand_width
    return F.transform(
        frames,
        lambda f: F.concat(
            F.slice(f, left, layout.hand_width), F.slice(f, right, layout.hand_width)
        ),
    )


def pad_features(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """Source frames -> model width with trailing zeros."""
    return F.transform(frames, lambda f: F.concat(f, _zeros(layout.padding)))


def nonzero_tail_count(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """Non-zero values in the padded tail; 0 for a well-formed model clip."""
    return F.aggregate(
        frames,
        F.lit(0),
        lambda acc, f: acc
        + F.size(
            F.filter(F.slice(f, layout.source_width + 1, layout.padding), lambda x: x != 0)
        ),
    )


def zscore(frames: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std per feature; a std below 1e-8 counts as 1.

    Statistics of another width than a frame fail.
    """
    wrong = F.raise_error(F.lit("statistics of another width")).cast("array<float>")
    stats = F.zip_with(
        mean.cast("array<double>"),
        std.cast("array<double>"),
        lambda m, s: F.struct(
            m.alias("m"), F.when(F.abs(s) < MISSING_ATOL, F.lit(1.0)).otherwise(s).alias("s")
        ),
    )
    return let(
        stats,
        lambda st: F.transform(
            frames,
            lambda f: F.when(
                F.size(f) == F.size(st),
                F.zip_with(f, st, lambda x, q: _float((x.cast("double") - q["m"]) / q["s"])),
            ).when(f.isNotNull() & st.isNotNull(), wrong),
        ),
    )


# ---- geometry -----------------------------------------------------------------


def _point(frame: Column, index) -> Column:
    return F.slice(frame, index * COORDINATES + 1, F.lit(COORDINATES))


def point_present(point: Column) -> Column:
    return F.exists(point, lambda x: F.abs(x) > MISSING_ATOL)


def frame_anchor(frame: Column, layout: Layout = FULL_BODY) -> Column:
    """struct(centre, scale, normalised) of one frame from its shoulders."""

    def anchor(p):
        left, right = p["l"].cast("array<double>"), p["r"].cast("array<double>")
        both = point_present(p["l"]) & point_present(p["r"])
        dx = F.get(left, F.lit(0)) - F.get(right, F.lit(0))
        dy = F.get(left, F.lit(1)) - F.get(right, F.lit(1))
        width = F.sqrt(dx * dx + dy * dy)
        usable = both & (width >= MIN_SCALE)
        return F.struct(
            F.when(both, F.zip_with(left, right, lambda a, b: (a + b) / 2.0))
            .otherwise(F.array_repeat(F.lit(0.0), COORDINATES))
            .alias("centre"),
            F.when(usable, width).otherwise(F.lit(1.0)).alias("scale"),
            usable.alias("normalised"),
        )

    shoulders = F.struct(
        _point(frame, F.lit(layout.left_shoulder)).alias("l"),
        _point(frame, F.lit(layout.right_shoulder)).alias("r"),
    )
    return let(shoulders, anchor)


def normalize_geometry(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """Centre each frame on the shoulder midpoint and scale by shoulder width.

    Frames without two valid shoulders stay as they are; coincident shoulders
    are centred but not scaled; missing points stay zero.
    """

    corners = F.sequence(F.lit(0), F.lit(layout.points - 1))

    def move(frame):
        points = F.transform(corners, lambda i: _point(frame, i))
        return let(
            frame_anchor(frame, layout),
            lambda a: F.flatten(
                F.transform(
                    points,
                    lambda p: F.when(
                        point_present(p),
                        F.zip_with(
                            p,
                            a["centre"],
                            lambda x, c: _float((x.cast("double") - c) / a["scale"]),
                        ),
                    ).otherwise(_zeros(COORDINATES)),
                )
            ),
        )

    return F.transform(frames, move)


def geometry_diagnostics(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """struct(frames, geometry_normalised_frames, geometry_fallback_frames, mean_scale)."""
    anchors = F.transform(frames, lambda f: frame_anchor(f, layout))

    def summary(a):
        normalised = F.size(F.filter(a, lambda x: x["normalised"]))
        total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["scale"])
        return F.struct(
            F.size(a).alias("frames"),
            normalised.alias("geometry_normalised_frames"),
            (F.size(a) - normalised).alias("geometry_fallback_frames"),
            F.when(F.size(a) > 0, total / F.size(a)).alias("mean_scale"),
        )

    return let(anchors, summary)


def missing_points(frame: Column, first: int, count: int) -> Column:
    """How many of ``count`` points from ``first`` on are missing in one frame."""
    indices = F.sequence(F.lit(first), F.lit(first + count - 1))
    return F.size(F.filter(indices, lambda i: ~point_present(_point(frame, i))))


def missingness(frames: Column, layout: Layout = FULL_BODY) -> Column:
    """Share of missing points per block; null for a clip without frames."""

    def rate(clip, first, count):
        missing = F.aggregate(clip, F.lit(0), lambda acc, f: acc + missing_points(f, first, count))
        return F.when(F.size(clip) > 0, missing / (F.size(clip) * count))

    return let(
        frames,
        lambda clip: F.struct(
            *[
                rate(clip, *span).alias(f"{name}_missing_rate")
                for name, span in layout.blocks().items()
            ]
        ),
    )


# ---- checks ---------------------------------------------------------------------


def clip_reason(frames: Column, width: int, length: int | None = None) -> Column:
    """Why a clip cannot be used; null for a valid one."""
    finite = F.forall(
        frames,
        lambda f: F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
    )
    reason = (
        F.when(frames.isNull() | (F.size(frames) == 0), "empty")
        .when(~F.forall(frames, lambda f: F.size(f) == width), "width")
        .when(~finite, "not_finite")
    )
    return reason if length is None else reason.when(F.size(frames) != length, "length")
