import os
import re
from collections import Counter

import duckdb
import pytest

from kipimo.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_counts(spark, table_of):
    texts = [None, "", "  \n", "a b c a b c", "é日 x\né日 x\n\n\n x", "one\r\none\r\none", "# $% a<b> #", "w " * 400, "\x1ca \x85b"]
    docs = table_of([(i, t, None, "h") for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x")], ["n_words", "kept", "host"])
    found = quality.quality_rules(docs).collect()
    given = sorted((str(r.doc_id), *_expected(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == given
    assert all(r.base_failed and not r.kept for r in found)


def test_bad_host_takes_good_documents_along(spark, table_of):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", None, "spam") for i in range(400)] + [(400, good, None, "spam")]
    rows += [(1000 + i, good + f" {i}", None, f"h{i % 9}") for i in range(900)] + [(9000, good, None, None)]
    found = {r.doc_id: r for r in quality.quality_rules(table_of(rows)).collect()}
    assert found[400].host_rejected and not found[400].base_failed and not found[400].kept
    assert found[9000].kept and found[1000].kept and not found[1000].host_rejected


def test_one_failing_document_does_not_sink_its_host(spark, table_of):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "bad", None, "small")] + [(1 + i, good, None, f"h{i % 20}") for i in range(400)]
    assert not any(r.host_rejected for r in quality.quality_rules(table_of(rows)).collect())


def test_empty_table(spark, table_of):
    assert quality.quality_rules(table_of([])).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    result = con.execute(quality.SQL.format(documents="documents"))
    names = [c[0] for c in result.description]
    df = quality.quality_rules(spark.read.parquet(path))
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(result.fetchall())
    assert os.path.exists(path)
