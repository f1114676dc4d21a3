"""Word alignment, error rates and their summaries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kipimo.functions import text as X
from kipimo.operators import align, distance, sequences, speech
from kipimo.operators.tables import cross_models
from kipimo.plans import registry, views

# Ten transcripts with their known edit counts and rates.
# (id, category, reference, model, hypothesis, substitutions, deletions, insertions,
#  wer, cer, audio seconds, inference ms)
KNOWN = [
    ("standard_01", "standard", "ninafurahia kujifunza akili bandia na teknolojia ya lugha", "small",
     "ninofura hiya kujifunza akili bandia na teknologia ya luga", 3, 0, 1, 0.5, 0.087719, 5.119, 858.437),
    ("standard_01", "standard", "ninafurahia kujifunza akili bandia na teknolojia ya lugha", "tuned",
     "ninafurahi kujifunza akilibandia na teknolojia ya lugha", 2, 1, 0, 0.375, 0.035088, 5.119, 2305.586),
    ("standard_02", "standard", "wanafunzi wanasoma vitabu katika maktaba ya chuo", "small",
     "wana funze wa na sama vitabo katika makta bayachua", 5, 1, 3, 1.285714, 0.208333, 5.012, 966.004),
    ("standard_02", "standard", "wanafunzi wanasoma vitabu katika maktaba ya chuo", "tuned",
     "wanafunzi wanasoma vitabu katika maktaba ya chuo", 0, 0, 0, 0.0, 0.0, 5.012, 1286.969),
    ("informal_01", "informal", "niko poa leo lakini nimechoka kidogo", "small",
     "kupo aleo lakini ni mechuka kido go", 6, 0, 1, 1.166667, 0.25, 2.793, 468.93),
    ("informal_01", "informal", "niko poa leo lakini nimechoka kidogo", "tuned",
     "nokopoa leo lakini nimechoka kidogo", 1, 1, 0, 0.333333, 0.055556, 2.793, 1206.306),
    ("codeswitch_01", "code_switching", "niko meeting lakini nitakupigia baadaye", "small",
     "komiting lakini entaku pigia badae", 5, 0, 0, 1.0, 0.25641, 3.433, 462.323),
    ("codeswitch_01", "code_switching", "niko meeting lakini nitakupigia baadaye", "tuned",
     "niko miting lakini nitakupigia baadae", 2, 0, 0, 0.4, 0.076923, 3.433, 1237.727),
    ("numbers_01", "numbers", "nina vitabu ishirini na tatu na kalamu tano", "small",
     "nina vitabu ishirini na tatu na kalamutano", 1, 1, 0, 0.25, 0.023256, 4.479, 476.722),
    ("numbers_01", "numbers", "nina vitabu ishirini na tatu na kalamu tano", "tuned",
     "nina vitabu ishirini na tatu na kalamu tano", 0, 0, 0, 0.0, 0.0, 4.479, 1263.503),
]


@pytest.fixture(scope="module")
def utterances(spark):
    rows = [
        (pos // 2, i, c, r, m, h, duration, ms)
        for pos, (i, c, r, m, h, _, _, _, _, _, duration, ms) in enumerate(KNOWN)
    ]
    return spark.createDataFrame(
        rows,
        "input_pos long, id string, category string, reference string, model string, hypothesis string,"
        " duration_seconds double, inference_time_ms double",
    )


@pytest.fixture(scope="module")
def scored(utterances):
    return align.with_alignment(speech.score_utterances(utterances))


def test_known_rates_and_counts(scored):
    rows = {(r["id"], r["model"]): r for r in scored.collect()}
    for i, _, ref, model, _, s, d, ins, wer, cer, _, _ in KNOWN:
        row = rows[i, model]
        a = row["alignment"]
        assert (a["substitutions_count"], a["deletions_count"], a["insertions_count"]) == (s, d, ins)
        assert a["reference_word_count"] == len(ref.split()) == a["hits"] + s + d
        assert row["wer"] == pytest.approx(wer, abs=1e-6)
        assert row["cer"] == pytest.approx(cer, abs=1e-6)


def test_merged_runs(scored):
    a = scored.filter("id = 'standard_02' and model = 'small'").first()["alignment"]
    assert [tuple(x) for x in a["substitutions"]] == [
        ("wanafunzi wanasoma vitabu", "na sama vitabo"),
        ("maktaba ya", "makta bayachua"),
    ]
    assert [x["reference"] for x in a["deletions"]] == ["chuo"]
    assert [x["hypothesis"] for x in a["insertions"]] == ["wana funze wa"]


def test_native_rates_agree_with_batch(utterances):
    both = speech.score_utterances(utterances).select(
        "wer",
        "cer",
        X.word_error_rate(F.col("reference"), F.col("hypothesis")).alias("w"),
        X.char_error_rate(F.col("reference"), F.col("hypothesis")).alias("c"),
    )
    for r in both.collect():
        assert (r["wer"], r["cer"]) == pytest.approx((r["w"], r["c"]))


def test_error_totals(scored):
    rows = {r["model"]: r for r in speech.error_totals(scored).collect()}
    small, tuned = rows["small"], rows["tuned"]
    counts = ("substitutions", "deletions", "insertions", "reference_words")
    assert [small[c] for c in counts] == [20, 2, 5, 34]
    assert [tuned[c] for c in counts] == [5, 2, 0, 34]
    assert small["corpus_wer"] == pytest.approx(0.794118, abs=1e-6)
    assert tuned["corpus_wer"] == pytest.approx(0.205882, abs=1e-6)
    assert small["mean_utterance_wer"] == pytest.approx(0.840476, abs=1e-6)
    assert tuned["mean_utterance_cer"] == pytest.approx(0.033513, abs=1e-6)


def test_by_model(scored):
    rows = {r["model"]: r for r in speech.asr_by_model(scored).collect()}
    assert rows["small"]["mean_wer"] == pytest.approx(0.840476, abs=1e-6)
    assert rows["small"]["mean_latency_ms"] == pytest.approx(646.4832, abs=1e-3)
    assert rows["small"]["realtime_factor"] == pytest.approx(0.155136, abs=1e-6)
    assert rows["tuned"]["realtime_factor"] == pytest.approx(0.35036, abs=1e-6)


def test_by_category(scored):
    rows = {
        (r["category"], r["model"]): (r["mean_wer"], r["mean_cer"])
        for r in speech.asr_by_category_model(scored).collect()
    }
    assert rows["standard", "small"] == pytest.approx((0.892857, 0.148026), abs=1e-6)
    assert rows["standard", "tuned"] == pytest.approx((0.1875, 0.017544), abs=1e-6)


def test_every_model_in_every_category(scored):
    only = scored.filter("not (category = 'numbers' and model = 'tuned')")
    rows = {
        (r["category"], r["model"]): r for r in speech.error_by_category(only, ["small", "tuned"]).collect()
    }
    assert len(rows) == 8
    empty = rows["numbers", "tuned"]
    assert (empty["substitutions"], empty["reference_words"], empty["corpus_wer"]) == (0, 0, 0.0)
    assert rows["numbers", "small"]["corpus_wer"] == pytest.approx(0.25)


def test_gains_are_ranked(scored):
    gains = speech.adaptation_gain(scored, ["id", "input_pos"], "small", "tuned")
    ranked = speech.rank_improvements(gains).collect()
    assert [r["id"] for r in ranked] == [
        "standard_02",
        "informal_01",
        "codeswitch_01",
        "numbers_01",
        "standard_01",
    ]
    assert ranked[1]["wer_improvement"] == pytest.approx(0.833334, abs=1e-6)


def test_gains_of_records_need_no_exchange(spark, scored):
    long = scored.groupBy("id", "input_pos", "reference").agg(F.collect_list(F.struct("model", "hypothesis")).alias("models"))
    records = spark.createDataFrame(long.collect(), long.schema)
    gains = speech.record_gain(records, ["id", "input_pos"], "small", "tuned")
    assert "Exchange" not in gains._jdf.queryExecution().executedPlan().toString()
    expected = speech.adaptation_gain(scored, ["id", "input_pos"], "small", "tuned")
    assert gains.columns == expected.columns
    assert sorted(map(tuple, gains.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_gains_of_odd_records(spark):
    kind = "id long, reference string, models array<struct<model: string, hypothesis: string>>"
    rows = [
        (1, "a b", [("x", "a b"), ("y", "a c")]),
        (2, "a b", [("x", None)]),
        (3, "", [("x", "a"), ("y", "")]),
        (4, "a", None),
        (None, None, []),
        (1, "a b", [("y", "a c"), ("x", "a b")]),
    ]
    found = speech.record_gain(spark.createDataFrame(rows, kind), ["id"], "x", "y").collect()
    assert [r["wer_improvement"] for r in found] == [-0.5, None, None, None, None, -0.5]
    assert [r["wer_y"] for r in found] == [0.5, None, None, None, None, 0.5]
    assert speech.record_gain(spark.createDataFrame([], kind), ["id"], "x", "y").collect() == []
    for models in ([("z", "a")], [("x", "a"), ("x", "a")]):
        with pytest.raises(Exception):
            speech.record_gain(spark.createDataFrame([(1, "a", models)], kind), ["id"], "x", "y").collect()


def test_most_common_ties_by_first_occurrence(scored):
    small = F.col("model") == "small"
    top = speech.top_substitutions(scored, ["input_pos"]).filter(small).orderBy("rank").collect()
    assert [r["count"] for r in top] == [1] * len(top)
    assert (top[0]["reference"], top[0]["hypothesis"]) == ("ninafurahia", "hiya")
    dropped = speech.top_deletions(scored, ["input_pos"]).filter(small).orderBy("rank").collect()
    assert [r["word"] for r in dropped] == ["chuo", "tano"]
    added = speech.top_insertions(scored, ["input_pos"]).filter(small).orderBy("rank").collect()
    assert [r["word"] for r in added] == ["ninofura", "wana", "funze", "wa", "kupo"]


def test_top_k_is_exact_under_a_dominant_word(spark):
    rows = [(i, "m", "a b" if i % 3 else "c d", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, model string, reference string, hypothesis string")
    top = speech.top_deletions(align.with_alignment(df), ["pos"]).collect()
    assert {(r["word"], r["count"]) for r in top} == {("a", 200), ("d", 100)}


def test_empty_and_missing_texts(spark):
    df = spark.createDataFrame(
        [("", "x y"), ("x y", ""), (None, "x"), ("x", None), ("", "")],
        "reference string, hypothesis string",
    )
    rows = align.with_alignment(speech.score_utterances(df)).collect()
    assert [(r["wer"], r["cer"]) for r in rows[:2]] == [(None, None), (1.0, 1.0)]
    assert rows[0]["alignment"]["insertions_count"] == 2
    assert rows[1]["alignment"]["deletions_count"] == 2
    assert rows[2]["alignment"] is None and rows[3]["wer"] is None
    assert rows[4]["alignment"]["hits"] == 0


def _brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _pairs(count, longest, alphabet="abcde", seed=3):
    rng = random.Random(seed)
    word = lambda: [rng.choice(alphabet) for _ in range(rng.randint(0, longest))]
    return [word() for _ in range(count)], [word() for _ in range(count)]


@pytest.mark.parametrize("budget", [200_000, 60, 5])
def test_distances_against_brute_force(monkeypatch, budget):
    monkeypatch.setattr(distance, "_ROW_BUDGET", budget)
    monkeypatch.setattr(sequences, "_AREA", budget)
    refs, hyps = _pairs(300, 15)
    expected = [_brute_distance(a, b) for a, b in zip(refs, hyps, strict=True)]
    assert distance.edit_distances(*sequences.encode_words([refs, hyps])).tolist() == expected
    texts = [sequences.Batch.of_texts(["".join(x) for x in side]) for side in (refs, hyps)]
    assert distance.edit_distances(*texts).tolist() == expected


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_are_the_same_characters(kind):
    column = pa.array(["x", "", "aß𝒳b", "", "end"] * 3, kind)
    for texts in (column, column.slice(2, 5), column.slice(0, 0)):
        one, other = sequences.Batch.of_column(texts), sequences.Batch.of_texts(texts.to_pylist())
        for name in ("codes", "starts", "lengths"):
            assert getattr(one, name).tolist() == getattr(other, name).tolist()


@pytest.mark.parametrize("step", [1, 3, 32])
def test_common_ends(monkeypatch, step):
    """However many elements are compared at a time, the beginning is taken off first."""
    monkeypatch.setattr(sequences, "_STEP", step)
    pairs = [("", ""), ("", "a"), ("aa", "aaa"), ("abc", "abc"), ("abxc", "abyyc"), ("x" * 90 + "a", "x" * 80 + "ba")]
    texts = [sequences.Batch.of_texts(list(side)) for side in zip(*pairs, strict=True)]
    left, right, head, tail = sequences.trim(*texts)
    assert head.tolist() == [0, 0, 2, 3, 2, 80] and tail.tolist() == [0, 0, 0, 0, 1, 1]
    assert left.lengths.tolist() == [0, 0, 0, 0, 1, 10] and right.lengths.tolist() == [0, 1, 1, 0, 2, 1]


@pytest.mark.parametrize("budget", [4_000_000, 400, 30])
def test_alignment_is_minimal_and_independent_of_batching(monkeypatch, budget):
    refs, hyps = _pairs(300, 15)
    whole = align.alignments(refs, hyps).to_pylist()
    monkeypatch.setattr(align, "_CELL_BUDGET", budget)
    assert align.alignments(refs, hyps).to_pylist() == whole
    for ref, hyp, a in zip(refs, hyps, whole, strict=True):
        s, d, i = a["substitutions_count"], a["deletions_count"], a["insertions_count"]
        assert s + d + i == _brute_distance(ref, hyp)
        assert a["hits"] + s + d == len(ref) and a["hits"] + s + i == len(hyp)


def test_long_texts_are_aligned_whole():
    rng = np.random.default_rng(5)
    ref = [str(x) for x in rng.integers(0, 50, 3000)]
    hyp = [w for k, w in enumerate(ref) if k % 10 != 4] + ["tail"]
    a = align.alignments([ref], [hyp]).to_pylist()[0]
    assert a["deletions_count"] + a["substitutions_count"] + a["hits"] == 3000
    distances = distance.edit_distances(*sequences.encode_words([[ref], [hyp]]))
    errors = a["substitutions_count"] + a["deletions_count"] + a["insertions_count"]
    assert errors == distances[0] <= 301


def test_cross_models(utterances):
    crossed = cross_models(utterances.select("id").distinct(), ["x", "y", "z"])
    assert crossed.count() == 15


def test_error_csv_rows(scored):
    row = speech.utterance_errors(scored, ["id", "category"]).filter("id = 'informal_01' and model = 'small'").first()
    assert (row["substitutions"], row["deletions"], row["insertions"], row["reference_words"]) == (6, 0, 1, 6)


def test_transcripts_are_made_once(spark, data):
    """Unfolding the models must not add a filter that makes every transcript again."""
    plan = views.utterances(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == len(views.SPEECH_MODELS)


def test_long_and_odd_texts_equal_word_lists(spark):
    """Around the limits of byte-wide tables, and with every kind of white space."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(n)) for n in (253, 254, 255, 256, 300, 0, 1)]
    texts += ["  a\x1cb\x85c　d ", "\t", "​ a", "\U0001f600 漢", None]
    pairs = [(a, b) for a in texts for b in texts]
    known = [(a or "", b or "") for a, b in pairs]
    expected = align.alignments([a.split() for a, _ in known], [b.split() for _, b in known]).to_pylist()
    found = align._align.func(*[pa.array(side, pa.string()) for side in zip(*pairs)]).to_pylist()
    assert found == [None if None in pair else row for pair, row in zip(pairs, expected)]
    rates = distance._error_rates.func(*[pa.array(side, pa.string()) for side in zip(*pairs)]).to_pylist()
    for (a, b), row, rate in zip(pairs, expected, rates):
        edits = row["substitutions_count"] + row["deletions_count"] + row["insertions_count"]
        if a and b and a.split():
            assert rate["wer"] == edits / len(a.split())
    cells = [(a, b) for a, b in pairs if a and b and len(a) < 260 and len(b) < 260][:12] + [(texts[2][:n], texts[3][:m]) for n, m in ((253, 254), (254, 255), (255, 256), (256, 253))]
    native = spark.createDataFrame(cells, "a string, b string").selectExpr("levenshtein(a, b) / char_length(a) AS d").collect()
    rates = distance._error_rates.func(*[pa.array(side, pa.string()) for side in zip(*cells)]).to_pylist()
    assert [r["cer"] for r in rates] == [r.d for r in native]


@pytest.mark.parametrize("name", ["native_error_rates", "sql_functions"])
def test_rates_of_whole_tables_use_the_kernels(spark, data, name):
    """Spark's levenshtein takes too long over whole tables; each kernel is called once a row."""
    registry.load()
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("ArrowEvalPython") == 1
