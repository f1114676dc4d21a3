"""Registered queries: clip operators.

Clip-valued results are reported per output frame as two checksums: the sum of
the features and the sum weighted by feature position.
"""

from pyspark.sql import functions as F

from ..functions import clips as C
from ..functions import conditions as D
from ..functions.columns import array_sum
from ..operators import clipsets as L
from ..operators import prepare as A
from . import views
from .oracle import padded, resampled, standardised, with_ctes
from .registry import query

LAYOUT = views.LAYOUT


def frame_sums(clips, column="frames", keys=("clip_id",)):
    """One row per output frame with both checksums."""
    frame = F.col("f")
    weighted = F.transform(frame, lambda x, i: x.cast("double") * (i + 1))
    frames = clips.select(*keys, F.posexplode_outer(column).alias("k", "f"))
    return frames.filter("f is not null").select(
        *keys,
        F.col("k").cast("long").alias("k"),
        F.round(array_sum(F.transform(frame, lambda x: x.cast("double"))), 5).alias("total"),
        F.round(array_sum(weighted), 4).alias("weighted"),
    )


def _sums_sql(table, keys="clip_id, k"):
    return (
        f"SELECT {keys}, round(sum(v), 5) AS total, round(sum(v * (d + 1)), 4) AS weighted"
        f" FROM {table} GROUP BY {keys}"
    )


def _sums(sql, *ctes, **extra):
    return with_ctes(_sums_sql("result"), *ctes, **extra, result=sql)


def native(spark, sf_dir):
    return views.native_clips(spark, sf_dir)


def source(spark, sf_dir):
    return views.source_clips(spark, sf_dir)


# ---- assembly, padding, selection ------------------------------------------------------


@query("frames_to_clip", _sums("SELECT clip_id, i AS k, d, v FROM native", "native"))
def frames_to_clip(spark, sf_dir):
    return frame_sums(native(spark, sf_dir))


@query(
    "pad_point_vector",
    with_ctes(
        """SELECT clip_id, i AS k, 21::BIGINT AS size,
          round(CASE WHEN i % 3 = 0 THEN 0.0 WHEN i % 3 = 1 THEN list_sum(x[1:10]) ELSE list_sum(x[1:21]) END, 5) AS total
        FROM frames""",
        "frames",
    ),
)
def pad_point_vector(spark, sf_dir):
    """Missing, short and long landmark sets brought to seven points."""
    i = F.col("frame_index") % 3
    vector = F.when(i == 1, F.slice("x", 1, 10)).when(i == 2, F.col("x"))
    fixed = C.pad_point_vector(vector, LAYOUT.hand_points)
    return views.frame_table(spark, sf_dir).select(
        "clip_id",
        F.col("frame_index").alias("k"),
        F.size(fixed).cast("long").alias("size"),
        F.round(array_sum(F.transform(fixed, lambda x: x.cast("double"))), 5).alias("total"),
    )


@query("select_hand_blocks", _sums("SELECT clip_id, i AS k, d, v FROM source", "source"))
def select_hand_blocks(spark, sf_dir):
    return frame_sums(source(spark, sf_dir))


@query(
    "pad_features",
    with_ctes(
        """SELECT clip_id, count(DISTINCT i) AS frames, 63::BIGINT AS width, 0::BIGINT AS nonzero_tail,
          round(sum(v), 5) AS total FROM source GROUP BY clip_id""",
        "source",
    ),
)
def pad_features(spark, sf_dir):
    wide = source(spark, sf_dir).withColumn("frames", C.pad_features(F.col("frames"), LAYOUT))
    flat = F.flatten("frames")
    return wide.select(
        "clip_id",
        F.size("frames").cast("long").alias("frames"),
        F.array_max(F.transform("frames", lambda f: F.size(f))).cast("long").alias("width"),
        C.nonzero_tail_count(F.col("frames"), LAYOUT).cast("long").alias("nonzero_tail"),
        F.round(array_sum(F.transform(flat, lambda x: x.cast("double"))), 5).alias("total"),
    )


# ---- resampling ---------------------------------------------------------------------------


def _resampled_query(name, method, sql):
    @query(name, _sums(sql, "steps", "source"))
    def run(spark, sf_dir):
        clips = source(spark, sf_dir)
        return frame_sums(clips.withColumn("frames", C.METHODS[method](F.col("frames"))))

    return run


def _picked(index):
    return f"""SELECT s.clip_id, s.k, p.d, p.v FROM steps s JOIN source p
      ON p.clip_id = s.clip_id AND p.i = {index}"""


_resampled_query("interpolate_linear", "linear_interpolation", resampled("source"))
_resampled_query(
    "resample_nearest", "nearest_resample", _picked("round_even(s.k * (s.t - 1) / 63.0::DOUBLE, 0)")
)
_resampled_query(
    "resample_floor", "floor_resample", _picked("floor(s.k * (s.t - 1) / 63.0::DOUBLE)")
)
_resampled_query("pad_repeat_last", "repeat_last_padding", _picked("least(s.k, s.t - 1)"))
_resampled_query(
    "pad_zero",
    "zero_padding",
    """SELECT s.clip_id, s.k, x.d, coalesce(p.v, 0.0) AS v FROM steps s CROSS JOIN
      (SELECT unnest(range(0, 42)) AS d) x LEFT JOIN source p
      ON p.clip_id = s.clip_id AND p.i = s.k AND p.d = x.d""",
)


@query("resample_frames", _sums(resampled("native"), "steps", "native"))
def resample_frames(spark, sf_dir):
    """Straight from the frame table, never holding a whole recording."""
    frames = views.frame_table(spark, sf_dir)
    return frame_sums(L.resample_frames(frames, ["clip_id"]))


# ---- statistics and standardisation -------------------------------------------------------


@query(
    "fit_feature_stats",
    with_ctes("SELECT d AS feature, round(mean, 9) AS mean, round(std, 9) AS std FROM stats", "stats"),
)
def fit_feature_stats(spark, sf_dir):
    stats = views.feature_stats(spark, sf_dir)
    pairs = F.arrays_zip("mean", "std")
    return stats.select(F.posexplode(pairs).alias("feature", "s")).select(
        F.col("feature").cast("long").alias("feature"),
        F.round("s.mean", 9).alias("mean"),
        F.round("s.std", 9).alias("std"),
    )


@query(
    "join_feature_stats",
    with_ctes(
        """SELECT clip_id, (SELECT round(sum(mean), 6) FROM stats) AS mean_sum,
          (SELECT round(sum(std), 6) FROM stats) AS std_sum FROM lengths""",
        "lengths",
        "stats",
    ),
)
def join_feature_stats(spark, sf_dir):
    joined = L.join_feature_stats(
        native(spark, sf_dir).select("clip_id"), views.feature_stats(spark, sf_dir)
    )
    return joined.select(
        "clip_id",
        F.round(array_sum(F.col("mean")), 6).alias("mean_sum"),
        F.round(array_sum(F.col("std")), 6).alias("std_sum"),
    )


@query(
    "zscore",
    _sums(
        standardised("wide"),
        "stats",
        "source",
        wide=padded("(SELECT clip_id, i AS k, d, v FROM source)"),
    ),
)
def zscore(spark, sf_dir):
    wide = source(spark, sf_dir).withColumn("frames", C.pad_features(F.col("frames"), LAYOUT))
    ready = L.join_feature_stats(wide, views.feature_stats(spark, sf_dir))
    return frame_sums(
        ready.withColumn("frames", C.zscore(F.col("frames"), F.col("mean"), F.col("std")))
    )


_PREPARED = {"short": resampled("source"), "wide": padded("short")}


@query("prepare_source", _sums(standardised("wide"), "steps", "stats", "source", **_PREPARED))
def prepare_source(spark, sf_dir):
    ready = L.join_feature_stats(source(spark, sf_dir), views.feature_stats(spark, sf_dir))
    prepared = A.prepare_source(F.col("frames"), F.col("mean"), F.col("std"), LAYOUT)
    return frame_sums(ready.select("clip_id", prepared.alias("frames")))


@query("prepare_native", _sums(standardised("wide"), "steps", "stats", "source", **_PREPARED))
def prepare_native(spark, sf_dir):
    ready = L.join_feature_stats(native(spark, sf_dir), views.feature_stats(spark, sf_dir))
    prepared = A.prepare_native(F.col("frames"), F.col("mean"), F.col("std"), LAYOUT)
    return frame_sums(ready.select("clip_id", prepared.alias("frames")))


# ---- geometry ------------------------------------------------------------------------------

# Per frame: shoulder midpoint and width; per point: whether any coordinate is set.
_POINTS = """SELECT clip_id, i, d, v, max(abs(v)) OVER (PARTITION BY clip_id, i, d // 3) > 1e-8 AS present FROM native"""
_ANCHORS = """SELECT clip_id, i, paired, CASE WHEN paired AND width >= 1e-6 THEN width ELSE 1.0 END AS scale,
    paired AND width >= 1e-6 AS normalised, cx, cy, cz FROM (
  SELECT clip_id, i, list_max(list_transform(x[1:3], lambda v: abs(v))) > 1e-8
      AND list_max(list_transform(x[4:6], lambda v: abs(v))) > 1e-8 AS paired,
    sqrt((x[1] - x[4]) * (x[1] - x[4]) + (x[2] - x[5]) * (x[2] - x[5])) AS width,
    (x[1] + x[4]) / 2 AS cx, (x[2] + x[5]) / 2 AS cy, (x[3] + x[6]) / 2 AS cz FROM frames)"""
_MOVED = """SELECT clip_id, i, d, CASE WHEN NOT present THEN 0.0
    ELSE ((v - CASE WHEN paired THEN CASE d % 3 WHEN 0 THEN cx WHEN 1 THEN cy ELSE cz END ELSE 0.0 END) / scale)::FLOAT::DOUBLE
    END AS v FROM points JOIN anchors USING (clip_id, i)"""


@query(
    "normalize_geometry",
    _sums("SELECT clip_id, i AS k, d, v FROM moved", "native", points=_POINTS, anchors=_ANCHORS, moved=_MOVED),
)
def normalize_geometry(spark, sf_dir):
    clips = native(spark, sf_dir)
    return frame_sums(
        clips.withColumn("frames", C.normalize_geometry(F.col("frames"), LAYOUT))
    )


_GEOMETRY = """SELECT clip_id, count(*) AS frames, count(*) FILTER (WHERE normalised) AS geometry_normalised_frames,
  count(*) FILTER (WHERE NOT normalised) AS geometry_fallback_frames, round(avg(scale), 6) AS mean_scale
FROM anchors GROUP BY clip_id"""


@query("geometry_diagnostics", with_ctes(_GEOMETRY, "frames", anchors=_ANCHORS))
def geometry_diagnostics(spark, sf_dir):
    found = native(spark, sf_dir).select(
        "clip_id", C.geometry_diagnostics(F.col("frames"), LAYOUT).alias("g")
    )
    counts = ("frames", "geometry_normalised_frames", "geometry_fallback_frames")
    return found.select(
        "clip_id",
        *[F.col("g")[c].cast("long").alias(c) for c in counts],
        F.round("g.mean_scale", 6).alias("mean_scale"),
    )


def _missing_sql(table, time="i"):
    return f"""SELECT clip_id, {", ".join(
        f"round(avg((m <= 1e-8)::INT) FILTER (WHERE p >= {a} AND p < {a + n}), 6) AS {name}_missing_rate"
        for name, (a, n) in LAYOUT.blocks().items()
    )} FROM (SELECT clip_id, {time}, d // 3 AS p, max(abs(v)) AS m FROM {table} GROUP BY 1, 2, 3) GROUP BY clip_id"""


def _missing(column, suffix=""):
    return [
        F.round(F.col(column)[f"{b}_missing_rate"], 6).alias(f"{b}_missing_rate{suffix}")
        for b in LAYOUT.blocks()
    ]


@query("missingness", with_ctes(_missing_sql("native"), "native"))
def missingness(spark, sf_dir):
    clips = native(spark, sf_dir)
    rates = clips.select("clip_id", C.missingness(F.col("frames"), LAYOUT).alias("m"))
    return rates.select("clip_id", *_missing("m"))


_PREPROCESSED = with_ctes(
    """SELECT clip_id, frames, geometry_fallback_frames, mean_scale, 64::BIGINT AS output_frames, total,
      b.pose_missing_rate AS pose_missing_rate_before, b.left_hand_missing_rate AS left_hand_missing_rate_before,
      b.right_hand_missing_rate AS right_hand_missing_rate_before,
      a.pose_missing_rate AS pose_missing_rate_after, a.left_hand_missing_rate AS left_hand_missing_rate_after,
      a.right_hand_missing_rate AS right_hand_missing_rate_after
    FROM geometry JOIN missing_before b USING (clip_id) JOIN missing_after a USING (clip_id)
      JOIN (SELECT clip_id, round(sum(v), 4) AS total FROM result GROUP BY clip_id) USING (clip_id)""",
    "native",
    "steps",
    points=_POINTS,
    anchors=_ANCHORS,
    moved=_MOVED,
    result=resampled("moved"),
    geometry=_GEOMETRY,
    missing_before=_missing_sql("native"),
    missing_after=_missing_sql("result", "k"),
)


def _diagnostics(done):
    values = F.transform(F.flatten("sequence"), lambda x: x.cast("double"))
    return done.select(
        "clip_id",
        F.col("geometry.frames").cast("long").alias("frames"),
        F.col("geometry.geometry_fallback_frames").cast("long").alias("geometry_fallback_frames"),
        F.round("geometry.mean_scale", 6).alias("mean_scale"),
        F.size("sequence").cast("long").alias("output_frames"),
        F.round(array_sum(values), 4).alias("total"),
        *_missing("missingness_before", "_before"),
        *_missing("missingness_after", "_after"),
    )


@query("preprocess_clip", _PREPROCESSED)
def preprocess_clip(spark, sf_dir):
    return _diagnostics(A.preprocess_clips(native(spark, sf_dir), LAYOUT))


@query("preprocess_frames", _PREPROCESSED)
def preprocess_frames(spark, sf_dir):
    """The same from the frame table: no recording becomes a row before it is short."""
    return _diagnostics(A.preprocess_frames(views.frame_table(spark, sf_dir), ["clip_id"], layout=LAYOUT))


# ---- checks, audits, profiles ---------------------------------------------------------------


@query(
    "clip_checks",
    with_ctes(
        """SELECT clip_id, CASE WHEN clip_id % 3 = 1 THEN 'width' WHEN clip_id % 7 = 2 THEN 'not_finite' WHEN t <> 20 THEN 'length' END AS reason,
          clip_id % 3 <> 1 AND clip_id % 7 <> 2 AND t = 20 AS valid FROM lengths""",
        "lengths",
    ),
)
def clip_checks(spark, sf_dir):
    """Clips of which some are spoiled on purpose, against shape (20, 63)."""
    spoiled = F.when(
        F.col("clip_id") % 3 == 1, F.transform("frames", lambda f: F.slice(f, 1, 60))
    ).when(
        F.col("clip_id") % 7 == 2,
        F.transform("frames", lambda f: F.transform(f, lambda _: F.lit(float("nan")).cast("float"))),
    )
    clips = native(spark, sf_dir).withColumn("frames", F.coalesce(spoiled, F.col("frames")))
    return L.valid_clips(clips, LAYOUT.width, 20).select("clip_id", "reason", "valid")


@query(
    "dataset_audit",
    with_ctes(
        """SELECT split, count(*) AS clips, min(t) AS min_length, max(t) AS max_length, round(avg(t), 3) AS mean_length,
          quantile_cont(t, 0.5)::DOUBLE AS median_length
        FROM (SELECT *, CASE WHEN clip_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM lengths) GROUP BY split""",
        "lengths",
    ),
)
def dataset_audit(spark, sf_dir):
    lengths = native(spark, sf_dir).select("split", F.size("frames").alias("length"))
    audit = L.length_summary(lengths)
    ends = [F.col(c).cast("long").alias(c) for c in ("min_length", "max_length")]
    return audit.select("split", "clips", *ends, "mean_length", "median_length")


@query(
    "dataset_audit_classes",
    with_ctes(
        """SELECT CASE WHEN clip_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'c' || clip_id % 4 AS label,
          count(*) AS count FROM lengths GROUP BY 1, 2""",
        "lengths",
    ),
)
def dataset_audit_classes(spark, sf_dir):
    return L.class_counts(native(spark, sf_dir))


@query(
    "dataset_audit_shapes",
    with_ctes(
        """SELECT split, t AS length, 63::BIGINT AS width, count(*) AS count,
          row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, t) AS rank
        FROM (SELECT *, CASE WHEN clip_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM lengths) GROUP BY split, t""",
        "lengths",
    ),
)
def dataset_audit_shapes(spark, sf_dir):
    shapes = L.shape_histogram(native(spark, sf_dir))
    longs = [F.col(c).cast("long").alias(c) for c in ("length", "width", "count", "rank")]
    return shapes.select("split", *longs)


_RANGES = {"pose": (0, 21), "left_hand": (21, 42), "right_hand": (42, 63)}


@query(
    "array_profile",
    with_ctes(
        """SELECT CASE WHEN d < 21 THEN 'pose' WHEN d < 42 THEN 'left_hand' ELSE 'right_hand' END AS range,
          count(*) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
          round(stddev_pop(v), 6) AS std, round(max(abs(v)), 6) AS max_abs, round(avg(abs(v)), 6) AS mean_abs,
          true AS all_finite, count(*) FILTER (WHERE abs(v) <= 1e-8) AS near_zero FROM native GROUP BY 1""",
        "native",
    ),
)
def array_profile(spark, sf_dir):
    profile = L.array_profile(views.frame_table(spark, sf_dir), "x", _RANGES)
    doubles = ("min", "max", "mean", "std", "max_abs", "mean_abs")
    return profile.select(
        "range", "count", "all_finite", "near_zero", *[F.round(c, 6).alias(c) for c in doubles]
    )


@query(
    "detection_rate",
    with_ctes(
        """SELECT clip_id, count(*) AS frames_read, count(*) FILTER (WHERE hit) AS frames_detected,
          round(count(*) / max(fps)::DOUBLE, 6) AS duration_seconds,
          round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 6) AS detection_rate
        FROM (SELECT *, clip_id % 2 = 0 OR i % 4 <> 1 AS hit FROM frames) GROUP BY clip_id""",
        "frames",
    ),
)
def detection_rate(spark, sf_dir):
    """Odd clips lose both hands in every fourth frame."""
    lost = (F.col("clip_id") % 2 == 1) & (F.col("frame_index") % 4 == 1)
    blank = F.transform(
        "x", lambda v, i: F.when(i >= LAYOUT.pose_width, F.lit(0.0).cast("float")).otherwise(v)
    )
    frames = views.frame_table(spark, sf_dir).withColumn(
        "x", F.when(lost, blank).otherwise(F.col("x"))
    )
    return L.detection_rate(frames, ["clip_id"], layout=LAYOUT)


@query(
    "first_per_class",
    with_ctes(
        """SELECT 'c' || clip_id % 4 AS label, 'clip_' || lpad(min(clip_id)::VARCHAR, 12, '0') || '.npy' AS file
        FROM lengths GROUP BY 1""",
        "lengths",
    ),
)
def first_per_class(spark, sf_dir):
    return L.first_per_class(native(spark, sf_dir), views.CLIP_LABELS)


# ---- probes and ablations ---------------------------------------------------------------------

# Long (clip_id, k, d, v) results of the probes on source clips.
PROBE_SQL = {
    "reverse": "SELECT clip_id, t - 1 - i AS k, d, v FROM source JOIN lengths USING (clip_id)",
    "shuffle": """SELECT clip_id, o.k, d, v FROM source JOIN (SELECT clip_id, i, row_number() OVER (PARTITION BY clip_id
        ORDER BY md5(clip_id || ':' || i || ':1000')) - 1 AS k FROM frames) o USING (clip_id, i)""",
    "freeze": """SELECT f.clip_id, f.i AS k, m.d, m.v FROM frames f JOIN lengths l ON l.clip_id = f.clip_id
        JOIN source m ON m.clip_id = f.clip_id AND m.i = l.t // 2""",
    "noise": """SELECT clip_id, k, d, (v + 0.05 * (sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE))
          * cos(2 * pi() * ((('0x' || substr(h, 9, 8))::BIGINT + 1) / 4294967297.0::DOUBLE))))::FLOAT::DOUBLE AS v
        FROM (SELECT clip_id, i AS k, d, v, md5(clip_id || ':' || i || ':' || d || ':2000') AS h FROM source)""",
}


def _probe_query(name, probe):
    @query(f"probe_{name}", _sums(PROBE_SQL[name], "source", "lengths"))
    def run(spark, sf_dir):
        clips = source(spark, sf_dir)
        return frame_sums(clips.withColumn("frames", probe(F.col("frames"), F.col("clip_id"))))

    return run


_probe_query("reverse", D.probe_reverse)
_probe_query("shuffle", D.probe_shuffle)
_probe_query("freeze", D.probe_freeze)
_probe_query("noise", D.probe_noise)

# Long results of the ablations on resampled source clips (table ``short``).
_MEAN = "(mean::FLOAT::DOUBLE)"
ABLATION_SQL = {
    "clean": "SELECT clip_id, k, d, v FROM short",
    "block1": f"SELECT clip_id, k, d, CASE WHEN d < 21 THEN {_MEAN} ELSE v END AS v FROM short JOIN stats USING (d)",
    "block2": f"SELECT clip_id, k, d, CASE WHEN d >= 21 THEN {_MEAN} ELSE v END AS v FROM short JOIN stats USING (d)",
    "mean_freeze": "SELECT clip_id, k, d, (avg(v) OVER (PARTITION BY clip_id, d))::FLOAT::DOUBLE AS v FROM short",
    "first_half": f"SELECT clip_id, k, d, CASE WHEN k < 32 THEN v ELSE {_MEAN} END AS v FROM short JOIN stats USING (d)",
    "second_half": f"SELECT clip_id, k, d, CASE WHEN k < 32 THEN {_MEAN} ELSE v END AS v FROM short JOIN stats USING (d)",
}


def _ablation_query(name, ablation):
    @query(
        f"ablate_{name}",
        _sums(ABLATION_SQL[name], "steps", "stats", "source", short=resampled("source")),
    )
    def run(spark, sf_dir):
        clips = source(spark, sf_dir).withColumn("frames", C.interpolate_linear(F.col("frames")))
        ready = L.join_feature_stats(clips, views.feature_stats(spark, sf_dir))
        mean = F.col("mean").cast("array<float>")
        return frame_sums(ready.withColumn("frames", ablation(F.col("frames"), mean, LAYOUT)))

    return run


_ablation_query("clean", D.ablate_clean)
_ablation_query("block1", D.ablate_block1)
_ablation_query("block2", D.ablate_block2)
_ablation_query("mean_freeze", D.ablate_mean_freeze)
_ablation_query("first_half", D.ablate_first_half)
_ablation_query("second_half", D.ablate_second_half)


@query(
    "register_condition",
    _sums(
        "SELECT clip_id, t - 1 - i AS k, d, -v AS v FROM source JOIN lengths USING (clip_id)",
        "source",
        "lengths",
    ),
)
def register_condition(spark, sf_dir):
    """A user's own transform: mirrored and reversed."""
    registry = {}
    D.register_condition(
        registry,
        "mirror",
        lambda frames, key: F.transform(F.reverse(frames), lambda f: F.transform(f, lambda x: -x)),
    )
    clips = source(spark, sf_dir)
    mirrored = registry["mirror"].apply(F.col("frames"), F.col("clip_id"))
    return frame_sums(clips.withColumn("frames", mirrored))
