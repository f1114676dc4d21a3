"""Normalisation, validation, tokens and SQL names."""

import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from kipimo.functions import columns as N
from kipimo.functions import text as X
from kipimo.functions.sql import register_sql_functions
from kipimo.operators import tokens


def _expected(text):
    kept = re.sub(r"[^\w\s'-]", " ", text.lower().strip())
    return re.sub(r"\s+", " ", kept).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZé ß'-_.,!?¿\t\n 9²№ñ–…“", max_size=40), min_size=1, max_size=30))
def test_normalisation(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(X.normalise_text(F.col("t"))).collect()]
    assert found == [_expected(t) for t in texts]


def test_reject_reasons(spark):
    rows = [(None,), ("",), (" \n\t",), ("ok",), ("x" * 2000,), ("x" * 2001,), (" " * 2001,)]
    df = tokens.validate_text(spark.createDataFrame(rows, "text string"))
    reasons = [r["reject_reason"] for r in df.collect()]
    assert reasons == ["missing", "empty", "blank", None, None, "too_long", "too_long"]


def test_split_words(spark):
    df = spark.createDataFrame([("  a  b\tc ",), ("",), ("  ",)], "t string")
    assert [r[0] for r in df.select(X.split_words(F.col("t"))).collect()] == [["a", "b", "c"], [], []]


def test_first_subword_both_forms(spark):
    rows = [
        (1, 0, None, "O"),
        (1, 1, 0, "B-X"),
        (1, 2, 0, "I-X"),
        (1, 3, 1, "I-Y"),
        (1, 4, None, "O"),
        (2, 0, 0, "Q"),
    ]
    long = spark.createDataFrame(rows, "s long, token_index long, word_id long, tag string")
    first = tokens.first_subword_rows(long, ["s"])
    expected = {(1, 0, "B-X"), (1, 1, "I-Y"), (2, 0, "Q")}
    assert {(r["s"], r["word_id"], r["tag"]) for r in first.collect()} == expected
    packed = F.array_sort(F.collect_list(F.struct("token_index", "word_id", "tag"))).alias("t")
    arrays = long.groupBy("s").agg(packed).select("s", tokens.first_subwords(F.col("t")).alias("t"))
    assert {(r["s"], x["word_id"], x["tag"]) for r in arrays.collect() for x in r["t"]} == expected


@pytest.mark.parametrize("run_rows", [tokens.RUN_ROWS, 3])
def test_first_subword_rows_shuffle_only_split_sentences(spark, monkeypatch, run_rows):
    """Sentences in one piece go through no shuffle; scattered ones give the same rows."""
    monkeypatch.setattr(tokens, "RUN_ROWS", run_rows)
    rng = random.Random(5)
    rows = [(s, t, t // 2 if t % 5 else None, f"p{t}") for s in ["a", "b", None, "c"] for t in range(25)]
    kind = "s string, token_index long, word_id long, tag string"

    def best(rows):
        out = {}
        for s, t, w, tag in rows:
            if w is not None and t < out.get((s, w), (99,))[0]:
                out[s, w] = (t, tag)
        return {(*k, *v) for k, v in out.items()}

    def found(df):
        return [(r.s, r.word_id, r.token_index, r.tag) for r in df.collect()]

    one = tokens.first_subword_rows(spark.createDataFrame(rows, kind).coalesce(1), ["s"])
    assert sorted(map(str, found(one))) == sorted(map(str, best(rows)))
    if run_rows > 25:
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    rng.shuffle(rows)
    rows += [("b", 60 + t, 40, "late") for t in range(3)] + rows[:7]
    many = tokens.first_subword_rows(spark.createDataFrame(rows, kind).repartition(3), ["s"])
    assert sorted(map(str, found(many))) == sorted(map(str, best(rows)))
    empty = tokens.first_subword_rows(spark.createDataFrame([("a", None, 1, "x")], kind), ["s"])
    assert found(empty) == [("a", 1, None, None)]


ODD_TEXTS = ["", "   ", "?!... ,,, ;;", None, "\n\t", "one", "!two words!", "- '", "a"]


@pytest.mark.parametrize("name", ["argmax_label", "first_subword", "first_subword_rows", "softmax", "strip_tag_prefix"])
def test_texts_without_words(spark, tmp_path, name):
    """Texts that normalise to nothing have no words, as in the SQL, and fail nothing."""
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = entry_module.queries()[name](spark, str(tmp_path))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = database.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    assert expected and sorted(map(tuple, found.select(*columns).collect())) == sorted(expected)


def test_tags_and_confidence(spark):
    df = spark.createDataFrame([(0, [0.1, 0.87654]), (1, [0.6, 0.4])], "w long, p array<double>")
    rows = tokens.tag_words(df, ["B-LOC", "I-PER"]).orderBy("w").collect()
    assert [(r["tag"], r["confidence"]) for r in rows] == [("PER", 0.8765), ("LOC", 0.6)]


def test_pooled_tokens(spark):
    rows = [("s", 1, [1.0, 2.0]), ("s", 0, [9.0, 9.0]), ("s", 1, [3.0, 6.0]), ("none", 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "s string, mask int, vector array<float>")
    out = {r["s"]: r["pooled"] for r in tokens.pool_tokens(df, ["s"]).collect()}
    assert out == {"s": [2.0, 4.0], "none": [0.0, 0.0]}


def test_rates_and_rounding(spark):
    row = spark.range(1).select(
        N.safe_rate(F.lit(3), F.lit(0)).alias("zero"),
        N.realtime_factor(F.lit(2.0), F.lit(0.0)).alias("silent"),
        N.frame_timestamp(F.lit(1), F.lit(0.0)).alias("t"),
        F.struct(F.lit(1 / 3).alias("a"), F.array(F.lit(1 / 3)).alias("list")).alias("s"),
        F.create_map(F.lit("k"), F.lit(2 / 3)).alias("m"),
    )
    out = N.round_report(row).first()
    assert (out["zero"], out["silent"], out["t"]) == (0.0, None, 0.033333)
    assert (out["s"]["a"], out["s"]["list"], out["m"]) == (0.333333, [1 / 3], {"k": 0.666667})


def test_sql_names(spark):
    assert set(register_sql_functions(spark)) == {
        "norm_text", "cer", "wer", "norm_entropy", "margin", "zscore", "resample",
    }
    row = spark.sql(
        "SELECT norm_text('  Ça, VA?') n, wer('a b c d', 'a x d') w, wer('', 'a') e, cer('abc', 'abd') c,"
        " norm_entropy(array(0.5D, 0.5D)) h, margin(array(0.2D, 0.7D, 0.1D)) m,"
        " zscore(array(3F, 1F), array(1D, 1D), array(2D, 0D)) z,"
        " resample(array(array(0F), array(2F)), 5) r"
    ).first()
    assert (row["n"], row["w"], row["e"], row["c"]) == ("ça va", 0.5, None, pytest.approx(1 / 3))
    assert (row["h"], row["m"]) == (pytest.approx(1.0), pytest.approx(0.5))
    assert row["z"] == [1.0, 0.0] and row["r"] == [[0.0], [0.5], [1.0], [1.5], [2.0]]


def test_white_space_beyond_ascii(spark):
    rows = [("a\u00a0b\u2003c",), ("\u00a0\u0085",), ("a\tb c",), ("\x1fa\u3000",)]
    df = spark.createDataFrame(rows, "t string")
    found = df.select(X.split_words(F.col("t")), X.reject_reason(F.col("t"))).collect()
    assert [r[0] for r in found] == [["a", "b", "c"], [], ["a", "b", "c"], ["a"]]
    assert [r[1] for r in found] == [None, "blank", None, None]


def test_sql_names_equal_columns(spark):
    from kipimo.functions import clips, vectors
    from kipimo.functions.sql import register_sql_functions

    register_sql_functions(spark)
    rows = [("a\tb c", "a b c"), ("x\u00a0y", "x z"), ("", "a"), ("a a b", ""), (None, "a")]
    df = spark.createDataFrame(rows, "r string, h string")
    pairs = {
        "norm_text(r)": X.normalise_text(F.col("r")),
        "wer(r, h)": X.word_error_rate(F.col("r"), F.col("h")),
        "cer(r, h)": X.char_error_rate(F.col("r"), F.col("h")),
    }
    for sql, column in pairs.items():
        for row in df.select(F.expr(sql).alias("a"), column.alias("b")).collect():
            assert row.a == row.b, sql
    p = spark.createDataFrame([([0.5, 0.25, 0.25],), ([1.0, 0.0],), ([0.1, 0.9],)], "p array<double>")
    for sql, column in {"margin(p)": vectors.prediction_margin, "norm_entropy(p)": vectors.normalized_entropy}.items():
        for row in p.select(F.expr(sql).alias("a"), column(F.col("p")).alias("b")).collect():
            assert abs(row.a - row.b) < 1e-12, sql
    f = spark.createDataFrame([([[1.0, 2.0], [3.0, 5.0]], [0.5, 1.0], [2.0, 0.0])], "f array<array<float>>, m array<double>, s array<double>")
    row = f.select(
        F.expr("zscore(f[1], m, s)").alias("a"),
        F.get(clips.zscore(F.col("f"), F.col("m"), F.col("s")), F.lit(1)).alias("b"),
        F.expr("resample(f, 5)").alias("c"),
        clips.interpolate_linear(F.col("f"), 5).alias("d"),
    ).first()
    assert row.a == row.b and row.c == row.d
