import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from kipimo.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _expected(rows, min_words):
    occurrences = []
    for i, text in rows:
        for n, raw in enumerate(text.split("\n") if text else []):
            words = WORD.findall(raw)
            if len(words) >= min_words:
                occurrences.append(((-1 if i is None else i, n), words))
    out = []
    for i, text in rows:
        all_lines = text.split("\n") if text else []
        stay = []
        for n, raw in enumerate(all_lines):
            words = WORD.findall(raw)
            place = (-1 if i is None else i, n)
            gone = len(words) >= min_words and any(p < place and _distance(words, w) <= 1 for p, w in occurrences)
            if not gone:
                stay.append(raw)
        out.append((str(i), len(all_lines), len(all_lines) - len(stay), "\n".join(stay) if text else text))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,min_words", [(1, 1), (2, 3), (3, 6)])
def test_equals_brute_force(spark, table_of, seed, min_words):
    rng = random.Random(seed)
    base = [[rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(25)]
    rows = []
    for _ in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
            text.append(rng.choice([" ", "  ", "\t"]).join(own))
        rows.append((rng.randint(0, 45), "\n".join(text)))
    rows += [(None, rows[0][1]), (None, None), (99, ""), (100, "\n\n"), rows[3], rows[3]]
    docs = table_of(rows, ["line", "key", "doc"]).repartition(3)
    found = lines.dedup_lines(docs, min_words=min_words, exact_words=min_words).collect()
    assert sorted(((str(r.doc.doc_id), r.n_lines, r.n_removed, r.kept) for r in found), key=str) == _expected(rows, min_words)
    assert all(r.doc.line == "x" and r.doc.doc == "x" for r in found)


@pytest.mark.parametrize("exact_words", [1, 3, 6])
def test_short_lines_go_if_equal(spark, table_of, exact_words):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        text = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(text + rng.choice([[], [" 我们没有空格 "], ["one  two"], ["one\ttwo"]]))))
    docs = table_of(rows).repartition(3)
    found = lines.dedup_lines(docs, exact_words=exact_words).collect()
    seen, expected = set(), []
    long = {i: t.split("\n") for i, _, _, t in _expected(rows, 6)}
    for i, text in rows:
        stay, rest = [], list(long[str(i)])
        for raw in text.split("\n"):
            words = tuple(WORD.findall(raw))
            if len(words) >= 6:
                if rest and rest[0] == raw:
                    stay.append(rest.pop(0))
            else:
                assert not text or rest.pop(0) == raw
                if not (words in seen and len(words) >= exact_words):
                    stay.append(raw)
                if words:
                    seen.add(words)
        expected.append((i, "\n".join(stay)))
    assert sorted((r.doc.doc_id, r.kept) for r in found) == expected


def test_pipeline_stage_drops_equal_short_lines(spark, table_of):
    rows = [(i, f"Read more\nown {i}\n这是一行") for i in range(30)] + [(40, "Read  more"), (41, "Read more now")]
    found = corpus_pipeline.without_repeated_lines(spark, table_of(rows).repartition(3), "")
    expected = [(0, rows[0][1])] + [(i, f"own {i}") for i in range(1, 30)] + [(41, "Read more now")]
    assert sorted((r.doc_id, r.text) for r in found.collect()) == expected


def test_many_lines_of_one_template(spark, table_of):
    rows = [(i, f"user number {i} logged in at noon today\nown line {i} {i} {i * 7} {i} {i} {i}") for i in range(400)]
    found = lines.dedup_lines(table_of(rows)).collect()
    assert sorted((r.doc.doc_id, r.n_removed) for r in found) == [(i, int(i > 0)) for i in range(400)]


def test_empty_table(spark, table_of):
    assert lines.dedup_lines(table_of([])).collect() == []


def test_equal_lines_have_equal_keys():
    text = "a b c d e f\n" * 3 + "  a  b c\td e f"
    found = lines.Lines(pa.array([text, "x y\n" * 500 + "a b c d e f"]), 6)
    assert len(np.unique(found.key)) == 1 and len(found.key) == 5
    assert found.number.tolist() == [0, 1, 2, 3, 500]


def test_within_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert lines.within_one_edit(a, b) == (_distance(a, b) <= 1)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    import duckdb

    from kipimo.llm.queries import QUERIES

    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    result = con.execute(lines.SQL.format(documents="documents"))
    names = [c[0] for c in result.description]
    found = QUERIES["op6_line_dedup"](spark, path).collect()
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(result.fetchall())
    assert sum(r.n_removed for r in found) > 0
