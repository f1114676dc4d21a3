"""Clip operators against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.functions import clips as C
from kipimo.functions import conditions as D
from kipimo.functions.layout import FULL_BODY, Layout
from kipimo.operators import clipsets, prepare

SMALL = Layout(pose_points=3, hand_points=2, left_shoulder=0, right_shoulder=1)
LENGTHS = [1, 2, 7, 16, 64, 90]


def _clip(length, width, seed):
    clip = np.random.default_rng(seed).normal(size=(length, width)).astype(np.float32)
    clip[::3, :6] = 0.0
    clip[1::4, -6:] = 0.0
    return clip


@pytest.fixture(scope="module")
def sources():
    return {k: _clip(t, SMALL.source_width, t) for k, t in enumerate(LENGTHS)}


@pytest.fixture(scope="module")
def natives():
    return {k: _clip(t, SMALL.width, 100 + t) for k, t in enumerate(LENGTHS)}


def _frame(spark, clips):
    rows = [(k, [[float(x) for x in f] for f in c]) for k, c in clips.items()]
    return spark.createDataFrame(rows, "clip_id long, frames array<array<float>>")


def _collect(df, column="frames"):
    return {r["clip_id"]: np.array(r[column], dtype=np.float32) for r in df.collect()}


def _linear(clip, n=64):
    if len(clip) == 1:
        return np.repeat(clip, n, axis=0)
    old, new = np.linspace(0, 1, len(clip)), np.linspace(0, 1, n)
    return np.stack([np.interp(new, old, clip[:, d]) for d in range(clip.shape[1])], axis=1)


def _picked(clip, index):
    return clip[np.asarray(index, dtype=int)]


EXPECTED = {
    "linear_interpolation": _linear,
    "nearest_resample": lambda c: _picked(c, np.rint(np.linspace(0, len(c) - 1, 64))),
    "floor_resample": lambda c: _picked(c, [k * (len(c) - 1) // 63 for k in range(64)]),
    "repeat_last_padding": lambda c: _picked(c, np.minimum(np.arange(64), len(c) - 1)),
    "zero_padding": lambda c: np.concatenate([c, np.zeros((64, c.shape[1]))])[:64],
}


@pytest.mark.parametrize("name", list(C.METHODS))
def test_resampling(spark, sources, name):
    out = _collect(_frame(spark, sources).withColumn("frames", C.METHODS[name](F.col("frames"))))
    for k, clip in sources.items():
        np.testing.assert_allclose(out[k], EXPECTED[name](clip), atol=1e-6)


def test_resampling_to_the_same_length_is_identity(spark, sources):
    same = _frame(spark, {0: sources[4]}).withColumn("frames", C.interpolate_linear(F.col("frames")))
    np.testing.assert_array_equal(_collect(same)[0], sources[4])


def test_empty_clip_gives_null(spark):
    df = spark.createDataFrame([(0, []), (1, None)], "clip_id long, frames array<array<float>>")
    methods = [m(F.col("frames")).isNull().alias(n) for n, m in C.METHODS.items()]
    assert all(all(r.asDict().values()) for r in df.select(*methods).collect())


@pytest.mark.parametrize("n", [5, 64])
def test_resampling_long_recordings_from_frames(spark, sources, n):
    """Recordings longer than 2n frames are never assembled whole."""
    long = dict(sources) | {9: _clip(700, SMALL.source_width, 9)}
    rows = [(k, i, [float(x) for x in f]) for k, c in long.items() for i, f in enumerate(c)]
    frames = spark.createDataFrame(rows, "clip_id long, frame_index long, x array<float>")
    out = _collect(clipsets.resample_frames(frames, ["clip_id"], n=n))
    for k, clip in long.items():
        np.testing.assert_allclose(out[k], _linear(clip, n), atol=1e-6)


def test_frames_to_clips_splits_long_recordings(spark):
    rows = [(0, i, [float(i)]) for i in range(10)]
    frames = spark.createDataFrame(rows, "clip_id long, frame_index long, x array<float>")
    clip = clipsets.frames_to_clips(frames, ["clip_id"]).collect()
    assert [[f[0] for f in c["frames"]] for c in clip] == [list(range(10))]


def _stats(spark, layout, seed=1):
    rng = np.random.default_rng(seed)
    mean, std = rng.normal(size=layout.width), rng.uniform(0.5, 2, size=layout.width)
    std[layout.source_width :] = 0.0
    std[0] = 1e-9
    table = spark.createDataFrame(
        [(mean.tolist(), std.tolist())], "mean array<double>, std array<double>"
    )
    return mean, np.where(np.abs(std) < 1e-8, 1.0, std), table


@pytest.mark.parametrize("form", ["arrow", "columns"])
def test_prepare(spark, sources, natives, form):
    mean, std, table = _stats(spark, SMALL)
    for clips, arrow, columns in (
        (sources, prepare.prepare_source, prepare.prepare_source_columns),
        (natives, prepare.prepare_native, prepare.prepare_native_columns),
    ):
        fn = arrow if form == "arrow" else columns
        df = clipsets.join_feature_stats(_frame(spark, clips), table)
        ready = fn(F.col("frames"), F.col("mean"), F.col("std"), SMALL)
        out = _collect(df.select("clip_id", ready.alias("frames")))
        for k, clip in clips.items():
            hands = clip[:, -SMALL.source_width :]
            padded = np.zeros((64, SMALL.width))
            padded[:, : SMALL.source_width] = _linear(hands)
            np.testing.assert_allclose(out[k], (padded - mean) / std, rtol=1e-4, atol=1e-5)


def test_prepare_in_slices_with_nulls(spark, sources, monkeypatch):
    monkeypatch.setattr(prepare, "_SLICE", 2)
    _, _, table = _stats(spark, SMALL)
    rows = [(k, None if k % 3 == 1 else sources[k % 6].tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "clip_id long, frames array<array<float>>").coalesce(1)
    df = clipsets.join_feature_stats(df, table)
    ready = prepare.prepare_source(F.col("frames"), F.col("mean"), F.col("std"), SMALL)
    for r in df.select("clip_id", ready.alias("p")).collect():
        assert (r["p"] is None) == (r["clip_id"] % 3 == 1)


def _geometry(clip, layout):
    points = clip.reshape(len(clip), layout.points, 3).astype(np.float64)
    out, fallback, scales = np.zeros_like(points), 0, []
    for t, frame in enumerate(points):
        a, b = frame[layout.left_shoulder], frame[layout.right_shoulder]
        there = (np.abs(frame) > 1e-8).any(axis=1)
        centre, scale = np.zeros(3), 1.0
        if there[layout.left_shoulder] and there[layout.right_shoulder]:
            centre, scale = (a + b) / 2, np.hypot(*(a - b)[:2])
        else:
            fallback += 1
        scales.append(scale)
        out[t][there] = (frame[there] - centre) / scale
    return out.reshape(len(clip), -1), fallback, np.mean(scales)


def test_geometry_and_missingness(spark, natives):
    done = prepare.preprocess_clips(_frame(spark, natives), SMALL, 8)
    for r in done.collect():
        clip = natives[r["clip_id"]]
        moved, fallback, scale = _geometry(clip, SMALL)
        np.testing.assert_allclose(np.array(r["sequence"]), _linear(moved, 8), rtol=1e-4, atol=1e-5)
        assert r["geometry"]["geometry_fallback_frames"] == fallback
        assert r["geometry"]["mean_scale"] == pytest.approx(scale, rel=1e-6)
        missing = ~(np.abs(clip.reshape(len(clip), -1, 3)) > 1e-8).any(axis=2)
        assert r["missingness_before"]["pose_missing_rate"] == pytest.approx(missing[:, :3].mean())
        assert r["missingness_before"]["right_hand_missing_rate"] == pytest.approx(missing[:, 5:].mean())
        assert (r["original_shape"], r["output_shape"]) == (list(clip.shape), [8, SMALL.width])


def test_coincident_shoulders_are_centred_only(spark):
    clip = np.ones((1, SMALL.width), np.float32)
    clip[0, 6:9] = 3.0
    df = _frame(spark, {0: clip}).withColumn("g", C.geometry_diagnostics(F.col("frames"), SMALL))
    row = df.withColumn("m", C.normalize_geometry(F.col("frames"), SMALL)).first()
    assert row["g"]["geometry_fallback_frames"] == 1
    assert row["m"][0][:9] == [0.0] * 6 + [2.0] * 3


def test_full_body_layout():
    assert (FULL_BODY.width, FULL_BODY.source_width, FULL_BODY.padding) == (225, 126, 99)
    assert FULL_BODY.blocks() == {"pose": (0, 33), "left_hand": (33, 21), "right_hand": (54, 21)}


def test_stats_and_zscore_of_the_mean_is_zero(spark, sources):
    stats = clipsets.fit_feature_stats(_frame(spark, sources))
    row = stats.first()
    frames = np.concatenate(list(sources.values())).astype(np.float64)
    np.testing.assert_allclose(row["mean"], frames.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(row["std"], frames.std(axis=0), atol=1e-9)
    df = clipsets.join_feature_stats(_frame(spark, {0: frames.mean(axis=0)[None]}), stats)
    z = _collect(df.withColumn("frames", C.zscore(F.col("frames"), F.col("mean"), F.col("std"))))
    np.testing.assert_allclose(z[0], 0, atol=1e-5)


def test_probes(spark, sources):
    df = _frame(spark, sources)
    out = {n: _collect(df.withColumn("frames", p.apply(F.col("frames"), F.col("clip_id")))) for n, p in D.PROBES.items()}
    other = _collect(df.repartition(3).withColumn("frames", D.probe_noise(F.col("frames"), F.col("clip_id"))))
    for k, clip in sources.items():
        np.testing.assert_array_equal(out["temporal_reverse"][k], clip[::-1])
        np.testing.assert_array_equal(out["static_freeze"][k], np.repeat(clip[len(clip) // 2][None], len(clip), 0))
        shuffled = out["temporal_shuffle"][k]
        assert sorted(map(tuple, shuffled)) == sorted(map(tuple, clip))
        np.testing.assert_array_equal(out["coordinate_noise"][k], other[k])
    noise = np.concatenate([(out["coordinate_noise"][k] - c).ravel() for k, c in sources.items()])
    assert abs(noise.mean()) < 0.005 and noise.std() == pytest.approx(0.05, rel=0.1)


def test_ablations(spark, sources):
    mean = np.arange(SMALL.width, dtype=np.float32)
    df = _frame(spark, {k: EXPECTED["linear_interpolation"](c).astype(np.float32) for k, c in sources.items()})
    mu = F.array(*[F.lit(float(x)) for x in mean]).cast("array<float>")
    out = {n: _collect(df.withColumn("frames", a.apply(F.col("frames"), mu, SMALL))) for n, a in D.ABLATIONS.items()}
    w = SMALL.hand_width
    for k in sources:
        clean = out["clean"][k]
        np.testing.assert_array_equal(out["block_1_only"][k], out["block_2_removed"][k])
        np.testing.assert_array_equal(out["block_2_only"][k], out["block_1_removed"][k])
        np.testing.assert_array_equal(out["block_1_removed"][k][:, :w], np.tile(mean[:w], (64, 1)))
        np.testing.assert_array_equal(out["block_1_removed"][k][:, w:], clean[:, w:])
        np.testing.assert_allclose(out["temporal_mean_freeze"][k], np.tile(clean.mean(axis=0), (64, 1)), atol=1e-6)
        np.testing.assert_array_equal(out["first_half_only"][k][:32], clean[:32])
        np.testing.assert_array_equal(out["second_half_only"][k][:32], np.tile(mean[: 2 * w], (32, 1)))


def test_checks(spark):
    nan = float("nan")
    rows = [(0, [[1.0, 2.0]]), (1, []), (2, None), (3, [[1.0]]), (4, [[nan, 1.0]]), (5, [[1.0, 2.0]] * 2)]
    df = spark.createDataFrame(rows, "clip_id long, frames array<array<float>>")
    reasons = {r["clip_id"]: r["reason"] for r in clipsets.valid_clips(df, 2, 1).collect()}
    assert reasons == {0: None, 1: "empty", 2: "empty", 3: "width", 4: "not_finite", 5: "length"}


def test_detection_rate(spark):
    hit, miss = [0.0] * 14 + [0.5] + [0.0] * 6, [1.0] * 9 + [0.0] * 12
    rows = [(0, 0.0, hit), (0, 0.0, miss), (0, 0.0, miss), (1, 25.0, miss)]
    df = spark.createDataFrame(rows, "clip_id long, fps double, x array<float>")
    out = {r["clip_id"]: r for r in clipsets.detection_rate(df, ["clip_id"], layout=SMALL).collect()}
    assert (out[0]["frames_read"], out[0]["frames_detected"], out[0]["detection_rate"]) == (3, 1, 0.333333)
    assert (out[0]["duration_seconds"], out[1]["duration_seconds"], out[1]["detection_rate"]) == (0.1, 0.04, 0.0)


def test_first_per_class_needs_every_label(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "label string, file string")
    assert {tuple(r) for r in clipsets.first_per_class(df, ["x", "y"]).collect()} == {("x", "a"), ("y", "c")}
    with pytest.raises(Exception, match="no files for class z"):
        clipsets.first_per_class(df, ["x", "y", "z"]).collect()


def test_registry_refuses_a_second_registration():
    registry = {}
    D.register_condition(registry, "same", lambda f, k: f)
    with pytest.raises(ValueError, match="already registered"):
        D.register_condition(registry, "same", lambda f, k: f)


def test_a_long_recording_is_one_clip(spark):
    frames = spark.range(5000).selectExpr("1 AS clip_id", "id AS frame_index", "array(CAST(id AS FLOAT)) AS x")
    clips = clipsets.frames_to_clips(frames, ["clip_id"])
    assert [len(r.frames) for r in clips.collect()] == [5000]
    assert clips.select(C.interpolate_linear(F.col("frames"), 3)).first()[0] == [[0.0], [2499.5], [4999.0]]
    resampled = clipsets.resample_frames(frames, ["clip_id"], n=3).first()
    assert resampled.frames == [[0.0], [2499.5], [4999.0]]


def test_gaps_widths_and_row_counts_fail(spark):
    frames = spark.createDataFrame([(1, i, [float(i)]) for i in range(10) if i != 4], "k int, frame_index long, x array<float>")
    with pytest.raises(Exception, match="without a gap"):
        clipsets.resample_frames(frames, ["k"], n=4).collect()
    clip = spark.createDataFrame([([[1.0, 2.0]],)], "frames array<array<float>>")
    one = spark.createDataFrame([([0.0], [1.0])], "mean array<double>, std array<double>")
    with pytest.raises(Exception, match="another width"):
        ready = clipsets.join_feature_stats(clip, one)
        ready.select(C.zscore(F.col("frames"), F.col("mean"), F.col("std"))).collect()
    for wrong in (one.union(one), one.limit(0)):
        with pytest.raises(Exception, match="exactly one row"):
            clipsets.join_feature_stats(clip, wrong).collect()


def test_unlisted_names_fail(spark):
    from kipimo.operators.tables import pivot_models

    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "k int, model string, v double")
    assert pivot_models(long, ["k"], ["v"], ["a", "b"]).first().v_b == 2.0
    with pytest.raises(Exception, match="not a listed name"):
        pivot_models(long, ["k"], ["v"], ["a"]).collect()
    files = spark.createDataFrame([("x", "f"), ("y", "g")], "label string, file string")
    with pytest.raises(Exception, match="not a listed name"):
        clipsets.first_per_class(files, ["x"]).collect()


def _done(df):
    return {r["clip_id"]: r.asDict(recursive=True) for r in df.collect()}


def _close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)
    if a is None or b is None or (isinstance(a, list) and None in a):
        return a == b
    return np.allclose(a, b, rtol=1e-5, atol=1e-6)


def test_kernel_equals_columns(spark, natives, monkeypatch):
    """Every step of the Arrow form, with empty and null clips, bad shoulders and absent points."""
    monkeypatch.setattr(prepare, "_SLICE", 3)
    rng = np.random.default_rng(7)
    clips = dict(natives)
    for k in range(100, 112):
        clip = rng.normal(size=(1 + k % 4, SMALL.width)).astype(np.float32)
        clip.reshape(len(clip), -1, 3)[rng.random((len(clip), SMALL.points)) < 0.4] = 0
        clips[k] = clip
    clips[200] = np.zeros((3, SMALL.width), np.float32)
    clips[201] = np.ones((1, SMALL.width), np.float32)
    rows = [(k, c.tolist()) for k, c in clips.items()] + [(300, []), (301, None)]
    df = spark.createDataFrame(rows, "clip_id long, frames array<array<float>>").coalesce(2)
    kernel = prepare.preprocess_clips(df, SMALL, 8)
    columns = prepare.preprocess_clips_columns(df, SMALL, 8)
    assert kernel.columns == columns.columns and kernel.schema.simpleString() == columns.schema.simpleString()
    plan = kernel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    a, b = _done(kernel), _done(columns)
    for k in a:
        assert all(_close(a[k][c], b[k][c]) for c in kernel.columns), k


def test_frame_table_form_equals_clips(spark, natives):
    rows = [(k, i, f.tolist()) for k, clip in natives.items() for i, f in enumerate(clip)]
    rows += [(None, i, r[2]) for i, r in enumerate(rows[:5])]
    table = spark.createDataFrame(rows, "clip_id long, frame_index long, x array<float>").repartition(5)
    found = _done(prepare.preprocess_frames(table, ["clip_id"], layout=SMALL, n=8))
    clips = clipsets.frames_to_clips(table, ["clip_id"])
    expected = _done(prepare.preprocess_clips(clips, SMALL, 8))
    assert found.keys() == expected.keys()
    for k, row in found.items():
        assert all(_close(row[c], expected[k][c]) for c in ("geometry", "missingness_before", "sequence", "missingness_after"))


def test_a_recording_of_many_frames(spark):
    """One recording of 100,000 frames: audited, moved and resampled without a row that holds it."""
    n = 100_000
    values = [(F.col("id") % 7 + 1 + d).cast("float") for d in range(SMALL.width)]
    table = spark.range(0, n, 1, 6).select(F.lit(1).alias("clip_id"), F.col("id").alias("frame_index"), F.array(*values).alias("x"))
    (row,) = prepare.preprocess_frames(table, ["clip_id"], layout=SMALL).collect()
    assert row["geometry"]["frames"] == n and len(row["sequence"]) == 64
    plan = prepare.preprocess_frames(table, ["clip_id"], layout=SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") <= 2  # of the few picked frames only


def test_moments_of_ragged_odd_vectors(spark):
    from kipimo.operators import moments

    rng = np.random.default_rng(2)
    rows = [([float(x) for x in 1e6 + rng.normal(size=1 + i % 4)],) for i in range(200)]
    rows += [(None,), ([],), ([None, 5.0],), ([0.0, -0.0, 1e-9],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(7)
    exploded = df.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.max(F.abs("x")).alias("max_abs"), F.avg(F.abs("x")).alias("mean_abs"),
        F.count_if(F.abs("x") <= 1e-8).alias("near_zero"),
    )
    found = {r.at: r for r in moments.position_moments(df, "v").collect()}
    for r in exploded.collect():
        for c in exploded.columns:
            assert found[r.at][c] == pytest.approx(r[c], rel=1e-9), (r.at, c)
    odd = spark.createDataFrame([([1.0, float("nan")],), ([2.0, float("inf")],), ([3.0, -4.0],)], "v array<double>")
    first, second = moments.position_moments(odd, "v").orderBy("at").collect()
    assert first.all_finite and (first.min, first.max, first.std) == (1.0, 3.0, pytest.approx((2 / 3) ** 0.5))
    assert not second.all_finite and second.min == -4.0 and np.isnan(second.max) and np.isnan(second.max_abs)
    assert moments.position_moments(odd.limit(0), "v").collect() == []
    plan = clipsets.fit_feature_stats(spark.createDataFrame([([[1.0, 2.0]],)], "frames array<array<double>>"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Generate") == 1  # of task rows


def test_sums_by_group(spark, monkeypatch):
    from kipimo.operators import moments

    rows = [(None if i % 5 == 0 else i % 3, f"k{i % 2}", [float(i), 1.0], None if i == 7 else i % 4) for i in range(90)] + [(1, "k1", None, 3)]
    df = spark.createDataFrame(rows, "g int, k string, v array<double>, w int").repartition(4)
    for limit in (2, 50_000):
        monkeypatch.setattr(moments, "_HELD_GROUPS", limit)
        found = {(r.g, r.k): (r.sums, r.weight) for r in moments.weighted_sums(df, ["g", "k"], "v", F.col("w")).collect()}
        for key in {(r[0], r[1]) for r in rows}:
            mine = [r for r in rows if (r[0], r[1]) == key and r[2]]
            w = [r[3] or 0 for r in mine]
            assert found[key] == ([sum(x * r[2][d] for x, r in zip(w, mine)) for d in range(2)], sum(w))
