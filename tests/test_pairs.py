"""Sentence-pair evaluation against known scores, and exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.operators import charts, pairs
from kipimo.operators.quantiles import exact_quantiles
from kipimo.operators.tables import melt_models, pivot_models

# Shift of two encoders per stressed pair.
# (id, phenomenon, effect, shift of encoder a, shift of encoder b)
STRESS = [
    ("neg_01", "negation", "meaning_change", 0.054156, 0.107163),
    ("neg_02", "negation", "meaning_change", 0.083117, 0.023118),
    ("neg_03", "negation", "meaning_change", 0.169428, 0.429954),
    ("tense_01", "tense", "temporal_change", 0.136412, 0.023337),
    ("tense_02", "tense", "temporal_change", 0.057005, 0.029495),
    ("tense_03", "tense", "temporal_change", 0.053726, 0.058102),
    ("subject_01", "subject_agreement", "participant_change", 0.182213, 0.147565),
    ("subject_02", "subject_agreement", "participant_change", 0.118467, 0.179335),
    ("argument_01", "argument_structure", "meaning_change", 0.03496, 0.009347),
    ("argument_02", "argument_structure", "meaning_change", 0.017766, 0.216286),
    ("quantity_01", "quantification", "meaning_change", 0.117653, 0.259116),
    ("quantity_02", "quantification", "meaning_change", 0.181328, 0.183567),
    ("code_01", "code_switching", "meaning_preserving", 0.148741, 0.230131),
    ("code_02", "code_switching", "meaning_preserving", 0.11689, 0.658721),
    ("informal_01", "informal_language", "approximately_meaning_preserving", 0.233992, 0.231712),
    ("informal_02", "informal_language", "approximately_meaning_preserving", 0.120374, 0.124702),
]


@pytest.fixture(scope="module")
def stress(spark):
    rows = [
        (k, i, p, e, {"a": (1 - a, a, 1.0), "b": (1 - b, b, 1.0)})
        for k, (i, p, e, a, b) in enumerate(STRESS)
    ]
    score = "struct<similarity:double,representational_shift:double,inference_time_ms:double>"
    return spark.createDataFrame(
        rows,
        "input_pos long, id string, phenomenon string, semantic_effect string,"
        f" models map<string,{score}>",
    )


@pytest.fixture(scope="module")
def scored(spark):
    """Two pairs per category with easy numbers."""
    rows, pos = [], 0
    values = {
        "paraphrase": (0.9, 0.8),
        "informal": (0.7, 0.6),
        "code_switching": (0.8, 0.7),
        "topical_similarity": (0.5, 0.5),
        "contrast": (0.85, 0.95),
        "unrelated": (0.2, 0.4),
    }
    for category, (a, b) in values.items():
        for step in (0.0, 0.02):
            rows.append((pos, f"p{pos}", category, {"a": (a + step, 10.0 + pos), "b": (b, 12.0)}))
            pos += 1
    score = "struct<similarity:double,inference_time_ms:double>"
    return spark.createDataFrame(
        rows, f"input_pos long, id string, category string, models map<string,{score}>"
    )


def test_phenomenon_shift(stress):
    rows = {(r["phenomenon"], r["model"]): r for r in pairs.phenomenon_shift(stress).collect()}
    r = rows["negation", "a"]
    assert (r["count"], r["min_shift"], r["max_shift"]) == (3, 0.054156, 0.169428)
    assert r["mean_shift"] == pytest.approx(0.102234, abs=1e-6)
    assert rows["code_switching", "b"]["mean_shift"] == pytest.approx(0.444426, abs=1e-6)


def test_sensitivity(stress):
    table = pairs.sensitivity_score(stress)
    rows = {r["model"]: r for r in table.collect()}
    assert (rows["a"]["changing_count"], rows["a"]["preserving_count"]) == (12, 4)
    assert rows["a"]["sensitivity_score"] == pytest.approx(-0.05448, abs=1.1e-6)
    assert rows["b"]["sensitivity_score"] == pytest.approx(-0.172451, abs=1.1e-6)
    gap = pairs.score_gap(table, ["sensitivity_score"], "a", "b").first()
    assert gap["sensitivity_score_gap"] == pytest.approx(0.117971, abs=2e-6)


def test_failures(stress):
    low = pairs.sensitivity_failures(stress).filter("model = 'a'").orderBy("rank").collect()
    assert [r["id"] for r in low] == ["argument_02", "argument_01", "tense_03", "neg_01", "tense_02"]
    high = pairs.invariance_failures(stress).filter("model = 'b'").orderBy("rank").collect()
    assert [r["id"] for r in high] == ["code_02", "informal_01", "code_01", "informal_02"]


def test_shift_feed(stress):
    feed = charts.feed_shift_difference(stress, "a", "b", ["input_pos"]).collect()
    sizes = [abs(r["difference"]) for r in feed]
    assert sizes == sorted(sizes) and len(feed) == 16


def test_separation(scored):
    rows = {r["model"]: r for r in pairs.semantic_separation(scored).collect()}
    assert rows["a"]["similar_count"] == 6 and rows["a"]["unrelated_count"] == 2
    assert rows["a"]["semantic_separation"] == pytest.approx(0.81 - 0.21)
    assert rows["b"]["contrast_separation"] == pytest.approx(0.7 - 0.95)


def test_separation_is_null_without_a_side(scored):
    row = pairs.semantic_separation(scored.filter("category != 'unrelated'")).first()
    assert row["semantic_separation"] is None and row["contrast_separation"] is not None


def test_category_and_global(scored):
    gaps = pairs.model_gap(scored, "a", "b")
    rows = {r["category"]: r for r in pairs.similarity_by_category(gaps).collect()}
    assert rows["contrast"]["mean_gap"] == pytest.approx(-0.09)
    assert rows["contrast"]["mean_abs_gap"] == pytest.approx(0.09)
    one = pairs.similarity_global(gaps).first()
    sims = [r["similarity_a"] for r in gaps.collect()]
    assert one["count"] == 12
    assert one["median_similarity_a"] == pytest.approx(np.median(sims))
    assert one["median_latency_b"] == 12.0


def test_top_disagreements_keep_input_order_on_ties(scored):
    gaps = pairs.model_gap(scored, "a", "b").withColumn("abs_gap", F.lit(1.0))
    assert [r["input_pos"] for r in pairs.top_disagreements(gaps, 4).collect()] == [0, 1, 2, 3]


def test_fastest_model_ties_go_to_the_first(scored):
    tied = pairs.fastest_model(scored.filter("input_pos = 2"), ["a", "b"]).first()
    assert (tied["fastest_model"], tied["highest_similarity_model"]) == ("a", "a")
    later = pairs.fastest_model(scored.filter("input_pos = 8"), ["a", "b"]).first()
    assert (later["fastest_model"], later["highest_similarity_model"]) == ("b", "b")


def test_melt_and_pivot_are_inverse(scored):
    wide = pivot_models(melt_models(scored), ["id"], ["similarity"], ["a", "b"])
    expected = {r["id"]: r["models"]["b"]["similarity"] for r in scored.collect()}
    assert {r["id"]: r["similarity_b"] for r in wide.collect()} == expected


def test_axis_floor(scored):
    flat = pairs.model_gap(scored, "a", "b").withColumns(
        {"similarity_a": F.lit(0.5), "similarity_b": F.lit(0.5)}
    )
    row = charts.feed_similarity_space(flat).first()
    assert (row["axis_low"], row["axis_high"]) == (0.48, 0.52)


# ---- exact quantiles -----------------------------------------------------------------


def _groups():
    rng = random.Random(11)
    yield "continuous", [rng.gauss(0, 1) for _ in range(501)]
    yield "latency", [rng.expovariate(1 / 5000) for _ in range(200)]
    yield "one value holds most rows", [0.25] * 700 + [rng.random() for _ in range(101)]
    yield "single", [3.5]
    yield "negative", [-rng.random() * 1e6 for _ in range(77)]


def test_quantiles_match_linear_interpolation(spark):
    rows = [(g, v, -v) for g, values in _groups() for v in values]
    rows += [(None, 1.0, None), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"p05": ("v", 0.05), "mid": ("v", 0.5), "p95": ("v", 0.95), "wmid": ("w", 0.5), "top": ("v", 1.0)}
    found = {r["g"]: r for r in exact_quantiles(df, ["g"], wanted).collect()}
    for g, values in _groups():
        r = found[g]
        assert r["p05"] == pytest.approx(np.percentile(values, 5), rel=1e-12)
        assert r["mid"] == pytest.approx(np.median(values), rel=1e-12)
        assert r["p95"] == pytest.approx(np.percentile(values, 95), rel=1e-12)
        assert r["wmid"] == pytest.approx(-np.median(values), rel=1e-12)
        assert r["top"] == max(values)
    assert found[None]["mid"] == 1.5 and found[None]["wmid"] is None


def test_quantile_of_everything(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)], "v double")
    row = exact_quantiles(df, [], {"low": ("v", 0.05), "high": ("v", 0.95)}).first()
    assert (row["low"], row["high"]) == pytest.approx((1.2, 14.4))
