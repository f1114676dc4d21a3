import random

import numpy as np
from pyspark.sql import functions as F

from kipimo.llm import language

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["schl", "ber", "ung", "keit"], "zz": ["éau", "ille", "oir", "ç"]}


def _text(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


def _greedy(own, read):
    """Phrases of a text by plain search in the reference."""
    phrases, at = 1, 0
    for i in range(len(own)):
        if own[at : i + 1] not in read:
            phrases, at = phrases + 1, i
    return phrases


def test_phrases_equal_greedy_parse():
    """Texts of many blocks too, among them stretches of the reference that cross several."""
    rng = random.Random(2)
    ref = "".join(rng.choice("abc ") for _ in range(3000))
    model = language.Model.fitted({"l": [ref]})
    symbols, parsers = opened = model.open()
    read = "".join(chr(97 + s) for s in symbols.of(ref + " "))
    texts = ["abcabcab", "a", "zzz", "ab zc", "", " ", ref, ref[1:] * 2, ref[700:2900] + "z" + ref[:900], "z" * 1000]
    for n in (240, 255, 256, 257, 511, 512, 513, 5000):
        texts.append("".join(rng.choice("abcz ") for _ in range(n)))
        texts.append("ab" * n)
        texts.append("".join(ref[k : k + rng.randint(1, 700)] for k in (rng.randrange(2500) for _ in range(n // 100))))
    bits, letters = language.entropies(texts, opened)
    for text, got, letter in zip(texts, bits[:, 0], letters):
        own = "".join(chr(97 + s) for s in symbols.of(text))
        expected = _greedy(own, read) * parsers["l"][1] / len(own) if own else 0
        assert abs(got - expected) < 1e-9
        assert letter == any(c.isalpha() for c in text)


def test_alphabets_of_any_size():
    """No letter is lost and no language's reference shrinks as languages or letters grow."""
    rng = random.Random(3)
    samples = {f"l{k:02}": ["".join(chr(0x4E00 + 300 * k + rng.randrange(400)) for _ in range(2000))] for k in range(30)}
    model = language.Model.fitted(samples, 1500)
    assert {n for _, n in model.languages.values()} == {1500}
    symbols, parsers = opened = model.open()
    texts = [samples["l07"][0][100:400], samples["l29"][0][:900], samples["l00"][0][700:1500]]
    bits, _ = language.entropies(texts, opened)
    assert [sorted(samples)[b] for b in bits.argmin(1)] == ["l07", "l29", "l00"]
    for k, name in enumerate(sorted(samples)):
        read = symbols.of(samples[name][0] + " ")[:1500].tolist()
        read = "".join(map(chr, read))
        own = "".join(map(chr, symbols.of(texts[1]).tolist()))
        assert abs(bits[1, k] - _greedy(own, read) * parsers[name][1] / len(own)) < 1e-9


def test_equal_stretches():
    rows = [np.arange(n) for n in (50, 3, 900, 0, 70)]
    cut = language.equal_stretches(rows, 100)
    assert sum(map(len, cut)) == 100 and len(cut[1]) == 3 and max(map(len, cut)) - min(len(cut[k]) for k in (0, 2, 4)) <= 1
    assert [len(r) for r in language.equal_stretches(rows, 5000)] == [50, 3, 900, 0, 70]
    assert language.equal_stretches([], 5) == []


def test_copies_count_once_and_long_texts_share(spark, table_of):
    rows = [(i, "copy of one text", "xx") for i in range(50)] + [(100 + i, f"text {chr(97 + i)} own", "xx") for i in range(9)]
    docs = table_of(rows + [(200, "long " * 4000, "xx"), (201, None, "xx"), (202, "other", None)])
    texts = language.sampled(docs.repartition(4), F.lit(True), sample_docs=20, ref_symbols=300)["xx"]
    assert len(texts) == len(set(texts)) == 11 and max(map(len, texts)) == 300
    few = language.sampled(docs, F.lit(True), sample_docs=5, ref_symbols=300)["xx"]
    assert few == texts[:5]
    named = docs.select(F.col("text").alias("body"), F.col("lang").alias("label"), F.col("doc_id").alias("k"), F.lit(1).alias("rank"))
    assert language.sampled(named, F.lit(True), 20, 300, "body", "label")["xx"] == texts
    found = language.identify_languages(named, F.lit(True), id_col="k", text_col="body", lang_col="label")
    assert found.count() == docs.count()


def test_ties_go_to_the_first_name(spark, table_of):
    docs = table_of([(1, "same words here", "yy"), (2, "same words here", "xx"), (3, "words", None)])
    assert {r.lang_pred for r in language.identify_languages(docs, F.lit(True)).collect()} == {"xx"}


def test_held_out(spark, table_of):
    rng = random.Random(1)
    rows = [(i, _text(lang, rng), lang) for i, lang in enumerate(sorted(SYLLABLES) * 40)]
    rows += [(500, None, "xx"), (501, "12 !", "yy"), (502, "", None), (503, _text("zz", rng, 5000), None), (503, "ka", "xx")]
    docs = table_of(rows, ["lang_pred", "score"])
    found = language.identify_languages(docs, F.col("doc_id") % 2 == 0).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows if i < 500}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in found if r.doc_id < 500)
    by_id = {r.doc_id: r for r in found if r.doc_id in (500, 501, 502)}
    assert {r.lang_pred for r in by_id.values()} == {"und"} and {r.score for r in by_id.values()} == {0.0}
    assert "zz" in {r.lang_pred for r in found if r.doc_id == 503}


def test_nothing_to_learn(spark, table_of):
    found = language.identify_languages(table_of([(1, "abc", None)]), F.lit(True)).collect()
    assert [r.lang_pred for r in found] == ["und"]
    assert language.identify_languages(table_of([]), F.lit(True)).collect() == []


def test_accuracy_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.identify_languages(docs, ~held).join(docs.filter(held), "doc_id")
    right = found.filter(F.col("lang_pred") == F.col("lang")).count()
    assert right >= 0.95 * found.count()
