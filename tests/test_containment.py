"""Containment of listed texts against a plain search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.operators import containment

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, item_id string, key string"


def _spaced(text):
    return " " + " ".join(WORD.findall(text or "")) + " "


def _brute(docs, items):
    listed = {}
    for i, t in items:
        if _spaced(t).strip():
            known = [x for x in (listed.get(_spaced(t), (None, 0))[0], i) if x is not None]
            listed[_spaced(t)] = (min(known, default=None), listed.get(_spaced(t), (None, 0))[1] + 1)
    return {(d, t or "", *listed[s]) for d, t in docs for s in listed if s in _spaced(t)}


def _found(spark, docs, items, k):
    left = spark.createDataFrame([(d, t, "x", None) for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = containment.contained_texts(left, right, k=k)
    texts = left.select(F.col("doc_id").alias("d"), "text", F.xxhash64("text").alias("h")).distinct()
    rows = found.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("h"))).collect()
    assert len(rows) == len(found.collect())
    return {(r.doc_id, r.text or "", r.item_id, r.copies) for r in rows}


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equal_to_plain_search(spark, k):
    rng = random.Random(k)
    words = ["a", "b", "c", "dé", "e."]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(40)]
    items += [(100, "  c \n\tdé "), (101, "c dé"), (102, None), (103, " "), (None, "a b c"), (104, docs[5][1])]
    docs += [(3, docs[3][1]), (3, "a b c dé"), (None, "x c dé x"), (None, "x c dé y"), (900, None), (901, "C DÉ")]
    docs += [(902, "a " * 3000 + "b"), (903, "\u00a0c\u00a0dé c\u3000dé")]
    assert _found(spark, docs, items, k) == _brute(docs, items)


def test_anchor_is_the_rarest_run(spark):
    """A text that shares a common passage is looked up by what is its own."""
    common = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{common} {i}") for i in range(300)] + [(900, f"{common} the own words of it")]
    assert _found(spark, docs, [(1, f"{common} the own words of it"), (2, f"{common} nowhere")], 5) == {
        (900, docs[-1][1], 1, 1)
    }


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(containment, "SMALL_ROWS", -1)
    docs = [(i, f"one two three four five six {i % 7}") for i in range(50)]
    items = [(0, "two three"), (1, "five six 3"), (2, "six seven")]
    assert _found(spark, docs, items, 2) == _brute(docs, items)


def _bit_table(keys):
    table = np.zeros(1 << 15, bool)
    for key in keys:
        table[[key % (1 << 15), (key >> 32) % (1 << 15)]] = True
    return np.packbits(table, bitorder="little")


def test_shared_beginnings_make_no_pairs(spark):
    """Texts and documents that begin alike meet only where one holds the other."""
    common = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"x {common} d{i} " + "e " * (i % 3)) for i in range(60)] + [(900, f"{common} i7 and on")]
    items = [(i, f"{common} i{i}") for i in range(60)] + [(100, f"{common} d5"), (101, common)]
    assert _found(spark, docs, items, 5) == _brute(docs, items)
    texts = [t.encode() for _, t in docs]
    block = containment._Texts(texts)
    whole = {int(k) for t in items for k in containment._Texts([t[1].encode()]).keys(np.array([0]), np.array([len(t[1].split())]))}
    assert len(whole) == 62
    held = containment._hits(block, {20: np.array([30, 31])}, np.full(4096, 255, np.uint8), _bit_table(whole))
    assert {(d, n) for d, _, n in held} == {(i, 30) for i in range(61)} | {(5, 31), (60, 31)}


def test_exclusion_keeps_columns_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x"), (None, "q a b"), (None, "fine"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b")], "item_id int, text string")
    kept = containment.exclude_containing(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(2, "x"), (None, "fine"), (3, None)]))
    assert containment.exclude_containing(docs, items.limit(0)).count() == 5
    assert containment.contained_texts(docs.limit(0), items).collect() == []
