"""Probabilities, uncertainty, rejection, ablation and ranking."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.functions import vectors as V
from kipimo.functions.layout import Layout
from kipimo.operators import clipsets, reliability, scoring

# One stored prediction with its margin and normalised entropy.
STORED = [0.04866557940840721, 0.6589154601097107, 0.23465345799922943, 0.05776546895503998]
STORED_MARGIN, STORED_ENTROPY = 0.42426200211048126, 0.6685834109069089
LABELS = ["father", "hello", "is", "my"]


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def _array(values):
    return F.array(*[F.lit(float(x)) for x in values])


def test_stored_prediction(spark):
    p = _array(STORED)
    names = F.array(*[F.lit(x) for x in LABELS])
    row = _one(
        spark,
        margin=V.prediction_margin(p),
        entropy=V.normalized_entropy(p),
        ranked=V.rank_classes(p, names),
        best=V.argmax_label(p, names),
        mine=V.probability_of(V.rank_classes(p, names), F.lit("is")),
    )
    assert row["margin"] == pytest.approx(STORED_MARGIN)
    assert row["entropy"] == pytest.approx(STORED_ENTROPY)
    assert [(r["index"], r["label"]) for r in row["ranked"]] == [(1, "hello"), (2, "is"), (3, "my"), (0, "father")]
    assert tuple(row["best"]) == ("hello", 1, 0.6589)
    assert row["mine"] == STORED[2]


def test_probability_edges(spark):
    one, sure, even = _array([1.0]), _array([1, 0, 0]), _array([0.25] * 4)
    row = _one(
        spark,
        m=V.prediction_margin(one),
        h1=V.normalized_entropy(one),
        h0=V.normalized_entropy(sure),
        h=V.normalized_entropy(even),
        e=V.entropy(even),
        s=V.softmax(_array([1000.0, 1001.0])),
        unknown=V.argmax_label(_array([0.1, 0.9]), F.array(F.lit("a"))),
    )
    assert (row["m"], row["h1"], row["h0"], row["h"]) == (1.0, 0.0, 0.0, pytest.approx(1.0))
    assert row["e"] == pytest.approx(math.log(4))
    assert row["s"] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert row["unknown"]["label"] == "1"


def test_absent_label_fails(spark):
    names = F.array(F.lit("a"), F.lit("b"))
    value = V.probability_of(V.rank_classes(_array([0.4, 0.6]), names), F.lit("z"))
    with pytest.raises(Exception, match="label not among the predictions"):
        _one(spark, x=value)


def test_pooling_and_cosine(spark):
    vectors = F.array(_array([1, 2]), _array([3, 4]), _array([100, 100]))
    mask = F.array(F.lit(1), F.lit(1), F.lit(0))
    row = _one(
        spark,
        pooled=V.masked_mean_pool(vectors, mask),
        none=V.masked_mean_pool(vectors, F.array(F.lit(0), F.lit(0), F.lit(0))),
        same=V.cosine(_array([1, 2]), _array([2, 4])),
        zero=V.cosine(_array([0, 0]), _array([2, 4])),
    )
    assert (row["pooled"], row["none"], row["same"], row["zero"]) == ([2.0, 3.0], [0.0, 0.0], 1.0, 0.0)


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for condition, sharp in (("clean_id", 3.0), ("noise", 0.5)):
        for k in range(60):
            z = np.exp(sharp * rng.normal(size=4))
            label = LABELS[k % 3]
            rows.append((condition, label, f"f{k}", (z / z.sum()).tolist()))
    df = spark.createDataFrame(rows, "condition string, label string, file string, p array<double>")
    return scoring.with_metrics(df.withColumn("labels", scoring.labels_column(LABELS)))


def test_summary_thresholds_and_rejection(predictions):
    rows = predictions.collect()
    clean = [r for r in rows if r["condition"] == "clean_id"]
    limits = reliability.id_thresholds(predictions)
    found = limits.first()
    assert found["max_probability_lower"] == pytest.approx(np.percentile([r["max_probability"] for r in clean], 5))
    assert found["entropy_upper"] == pytest.approx(np.percentile([r["normalized_entropy"] for r in clean], 95))
    rates = {r["condition"]: r["rejection_rate"] for r in reliability.rejection_rate(predictions, limits).collect()}
    for condition, rate in rates.items():
        mine = [r for r in rows if r["condition"] == condition]
        rejected = [
            r["max_probability"] < found["max_probability_lower"]
            or r["margin"] < found["margin_lower"]
            or r["normalized_entropy"] > found["entropy_upper"]
            for r in mine
        ]
        assert rate == pytest.approx(np.mean(rejected), abs=1e-6)
    summary = {r["condition"]: r for r in reliability.uncertainty_summary(predictions).collect()}
    assert summary["noise"]["count"] == 60
    assert summary["clean_id"]["median_max_probability"] == pytest.approx(
        np.median([r["max_probability"] for r in clean]), abs=1e-6
    )


def test_per_class_lists_every_label(predictions):
    rows = {(r["condition"], r["label"]): r for r in reliability.per_class_accuracy(predictions, LABELS).collect()}
    assert len(rows) == 8
    assert tuple(rows["clean_id", "my"])[2:] == (0, 0, 0.0)
    assert rows["clean_id", "is"]["total"] == 20


def test_both_baseline_forms_agree(predictions):
    clean = predictions.filter("condition = 'clean_id'")
    keys = ["label", "file"]
    columns = ["condition", "file", "clean_predicted", "prediction_retained", "true_probability_drop"]
    joined = reliability.join_clean_baseline(predictions, clean, keys).select(*columns)
    windowed = reliability.beside_clean(predictions, keys, "clean_id").select(*columns)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, windowed.collect()))
    summary = {r["condition"]: r for r in reliability.ablation_summary(reliability.beside_clean(predictions, keys, "clean_id")).collect()}
    assert summary["clean_id"]["prediction_retention"] == 1.0
    assert summary["clean_id"]["median_true_probability_drop"] == 0.0


def test_id_vs_control(predictions):
    row = reliability.id_vs_control(predictions, F.col("condition") == "noise").first()
    assert row["id_count"] == 60
    assert row["confidence_gap"] == pytest.approx(row["mean_id_max_probability"] - row["control_max_probability"], abs=2e-6)
    assert row["entropy_gap"] > 0


def test_ranking_is_stable(spark):
    rows = [("m1", 0.9, 0.5), ("m2", 0.95, 0.4), ("m3", 0.95, 0.4), ("m4", 0.95, 0.6)]
    df = spark.createDataFrame(rows, "method string, accuracy double, mean_max_probability double")
    ranked = reliability.rank_methods(df).orderBy("rank").collect()
    assert [r["method"] for r in ranked] == ["m4", "m2", "m3", "m1"]
    assert [r["best"] for r in ranked] == [True, False, False, False]


def test_scoring_with_a_column_prepared_clip(spark):
    """A scorer argument that holds a lambda must still be planned."""
    layout = Layout(pose_points=1, hand_points=1, left_shoulder=0, right_shoulder=0)
    rows = [(k, "a", [[float(k), 1.0, 2.0, 3.0, 4.0, 5.0]] * 3) for k in range(5)]
    df = spark.createDataFrame(rows, "clip_id long, label string, frames array<array<float>>")
    stats = clipsets.fit_feature_stats(df)
    from kipimo.operators.prepare import prepare_source_columns

    ready = clipsets.join_feature_stats(df, stats)
    zeros = F.array_repeat(F.lit(0.0), layout.width)
    prepared = prepare_source_columns(F.col("frames"), zeros, zeros, layout, 4)
    make = scoring.late_weighted_scorer(4, layout.width, [[0], [1]])
    scored = scoring.with_metrics(
        scoring.score_clips(ready.withColumn("prepared", prepared), make, ["a", "b"], 4, layout.width)
    )
    out = {r["clip_id"]: r for r in scored.select("clip_id", "p", "predicted", "correct").collect()}
    assert out[0]["predicted"] == "b" and out[4]["predicted"] == "a" and out[4]["correct"]
    assert out[1]["p"] == pytest.approx([0.5, 0.5])


def test_unusable_clips_are_not_scored(spark):
    from kipimo.operators.scoring import late_weighted_scorer, score_clips, with_metrics

    rows = [(1, [[1.0, 0.0]] * 2, "a"), (2, None, "a"), (3, [], "b"), (4, [[0.0, 1.0]] * 2, "b")]
    clips = spark.createDataFrame(rows, "id int, prepared array<array<float>>, label string")
    make = late_weighted_scorer(2, 2, [[0], [1]])
    found = {r.id: r for r in with_metrics(score_clips(clips, make, ["a", "b"], 2, 2)).collect()}
    assert found[1].predicted == "a" and found[4].predicted == "b"
    for k in (2, 3):
        assert found[k].p is None and found[k].max_probability is None and found[k].margin is None


def test_quantiles_of_piled_up_values(spark):
    from kipimo.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(2)
    values = 1 - rng.random(3000) * 1e-9
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "g long, v double")
    found = {r.g: r for r in exact_quantiles(df, ["g"], {"low": ("v", 0.05), "mid": ("v", 0.5)}).collect()}
    for g in range(3):
        assert found[g].low == np.quantile(values[g::3], 0.05) or abs(found[g].low - np.quantile(values[g::3], 0.05)) < 1e-15
        assert abs(found[g].mid - np.quantile(values[g::3], 0.5)) < 1e-15


def test_variants_in_one_row_equal_the_long_form(spark, data):
    """Scores, metrics and clean baseline of all conditions, without window or exchange."""
    from kipimo.plans import reliability_queries as queries
    from kipimo.plans import views

    clips, stats = queries.clips_and_stats(spark, data)
    empty = clips.limit(1).withColumn("clip_id", F.lit(-1).cast("long")).withColumn("file", F.lit("none.npy"))
    empty = empty.withColumn("frames", F.slice("frames", 1, 0))
    clips = clips.unionByName(empty.select(*clips.columns))
    variants = reliability.ablation_variants(clips, stats, queries.LAYOUT)
    row_form = reliability.compared_variants(views.scored_variants(variants))
    long_form = reliability.beside_clean(views.scored(reliability.ablate_clips(clips, stats, queries.LAYOUT)), queries.KEYS)
    columns = ["clip_id", "condition", "predicted", "clean_predicted", "correct", "prediction_retained"]
    doubles = ["max_probability", "margin", "normalized_entropy", "true_probability", "true_probability_drop"]
    chosen = [*columns, *[F.round(c, 7).alias(c) for c in doubles]]
    a, b = (sorted(map(str, df.select(*chosen).collect())) for df in (row_form, long_form))
    assert a == b and len(a) == 8 * clips.count()
    plan = variants.sparkSession.createDataFrame(variants.limit(3).toArrow())
    one = reliability.compared_variants(views.scored_variants(plan))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in one and "Exchange" not in one
