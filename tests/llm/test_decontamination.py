import random

import pyarrow as pa
import pytest

from kipimo.llm import decontamination as d


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    common = words[:20]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(13, 60))).capitalize() + ".") for i in range(40)]
    rows, planted = [], set()
    for i in range(300):
        text = say(rng.randint(5, 400))
        if i % 5 == 0:
            item, leaked = items[i // 5 % 40][1].split(), items[i // 5 % 40][0]
            if i % 10 == 0:  # a paraphrase: some words replaced
                item = [w if rng.random() > 0.12 else "zzz" for w in item]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in item] if i % 3 else item
            planted.add((i, leaked))
        rows.append((i, " ".join(text)))
    return rows, items, planted


def test_planted_items_and_nothing_else(spark, table_of):
    rows, items, planted = _corpus()
    docs = table_of(rows + [(900, None), (901, ""), (5, "clean row of the same id")], ["matched", "item_id"]).repartition(3)
    found = d.contaminated(docs, _items(spark, items + [(77, None), (78, "")]))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(planted & got) >= 0.95 * len(planted)
    verbatim = {p for p in planted if p[0] % 10}
    assert verbatim <= got
    assert not got - planted


def test_recall_against_brute_force(spark, table_of):
    """All passages checked against all items, without the latent search."""
    rows, items, _ = _corpus(2)
    words = d.Words(pa.array([t for _, t in rows]))
    own = d.Words(pa.array([t for _, t in items]))
    parsed = [d.Item(i, [own.word(k) for k in range(own.first[j], own.first[j + 1])]) for j, (i, _) in enumerate(items)]
    expected = set()
    begin, _ = words.passages()
    for b in begin.tolist():
        doc = int(words.doc[b])
        for item in parsed:
            lo, hi = max(b - item.size, words.first[doc]), min(b + d.PASSAGE + item.size, words.first[doc + 1])
            if item.check([words.word(i) for i in range(lo, hi)]):
                expected.add((rows[doc][0], item.item_id))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table_of(rows), _items(spark, items), block=15).collect()}
    assert got <= expected
    assert len(got) >= 0.9 * len(expected)


def test_short_items_equal_brute_force(spark, table_of):
    """Items of 1 to 12 words in running text, some with a word more or less."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words[: 40 if i % 3 else 3000]) for _ in range(i % 12 + 1))) for i in range(60)]
    rows, planted = [], set()
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        item = items[i % 60][1].split()
        if i % 4 == 0 and len(item) > 7:
            item[rng.randrange(len(item))] = "zzz"
        elif i % 4 == 1:
            item.insert(rng.randint(0, len(item)), "zzz")
        at = rng.randint(0, len(text))
        rows.append((i, " ".join(text[:at] + item + text[at:])))
        planted.add((i, i % 60))
    docs, own = d.Words(pa.array([t for _, t in rows])), [d.Words(pa.array([t])) for _, t in items]
    parsed = [d.Item(i, [w.word(k) for k in range(len(w.key))]) for (i, _), w in zip(items, own)]
    expected = {}
    for b in docs.passages()[0].tolist():
        doc = int(docs.doc[b])
        for item in parsed:
            lo, hi = max(b - item.size, docs.first[doc]), min(b + d.PASSAGE + item.size, docs.first[doc + 1])
            result = item.check([docs.word(i) for i in range(lo, hi)])
            if result:
                expected[doc, item.item_id] = max(expected.get((doc, item.item_id), (0, 0)), result)
    found = d.contaminated(table_of(rows).repartition(3), _items(spark, items + [(77, ""), (78, None)])).collect()
    got = {(r.doc_id, r.item_id): (r.matched, r.answer) for r in found}
    assert got == {k: (round(m, 6), round(a, 6)) for k, (m, a) in expected.items()}
    assert len(planted & got.keys()) >= 0.95 * len(planted)


def test_copies_are_sampled_one_by_one(spark, table_of, monkeypatch):
    """Of 2,000 copies of one passage, about 500 are wanted."""
    taken = []
    whole = d.singular_vectors

    def counted(passages, idf):
        taken.append(passages.filter("weight = 1").count())
        return whole(passages, idf)

    monkeypatch.setattr(d, "singular_vectors", counted)
    for text in ("the same words in all of them", "another passage that all of these hold"):
        docs = table_of([(i, text) for i in range(2000)]).select("doc_id", "text")
        d._fitted(docs, _items(spark, [(1, "words that these hold")]), 500)
    assert all(400 < n < 600 for n in taken) and len(taken) == 2


def test_every_passage_is_fitted(spark, table_of, monkeypatch):
    """More passages than any sample: all of them reach the singular vectors."""
    taken, whole = [], d.singular_vectors

    def counted(passages, idf):
        taken.append(passages.filter(f"weight != {d.BENCHMARK_WEIGHT}").count())
        return whole(passages, idf)

    monkeypatch.setattr(d, "singular_vectors", counted)
    docs = table_of([(i, "w " * (d.STRIDE * 500 + d.STRIDE)) for i in range(60)])
    d.contaminated(docs, _items(spark, [(1, "words that w hold")]))
    assert taken == [60 * 500]


@pytest.mark.parametrize("cells", [1 << 24, 40])
def test_singular_vectors_of_all_pairs(spark, monkeypatch, cells):
    """The subspace of the dense matrix, by one table of pairs and by sorted pairs."""
    monkeypatch.setattr(d, "_CELLS", cells)
    rng = random.Random(5)
    rows = [([rng.randrange(min(30, 3 + i % 40)) for _ in range(rng.randint(0, 20))], 1.0 if i % 3 else 8.0) for i in range(400)]
    idf = d.np.linspace(0.2, 3.0, 30)
    dense = d.np.zeros((400, 30))
    for x, (terms, weight) in zip(dense, rows):
        d.np.add.at(x, terms, idf[terms])
        x *= weight / max(float(d.np.sqrt((idf[terms] ** 2).sum())), 1e-9)
    passages = spark.createDataFrame(rows, "terms array<int>, weight double").repartition(5)
    got = d.singular_vectors(passages, idf, 30)
    square = got.T @ dense.T @ dense @ got
    exact = d.np.linalg.eigvalsh(dense.T @ dense)[::-1]
    assert d.np.allclose(d.np.diag(square), exact, rtol=1e-3, atol=1e-2)
    assert abs(square - d.np.diag(d.np.diag(square))).max() < 1e-2 * exact[0]


def test_blocks_change_nothing(spark, table_of):
    rows, items, _ = _corpus(3)
    docs, benchmark = table_of(rows), _items(spark, items)
    one, many = (sorted(map(tuple, d.contaminated(docs, benchmark, block=n).collect())) for n in (1000, 9))
    assert one == many and len(one) > 40


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "binary", "string"])
def test_item_ids_of_any_type(spark, table_of, kind):
    benchmark = _items(spark, [(7, "these are the few words of it")]).selectExpr(f"cast(cast(item_id as string) as {kind}) AS item_id", "text")
    docs = table_of([(1, "x these are the few words of it y"), (2, "nothing")])
    found = d.contaminated(docs, benchmark)
    assert found.schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, benchmark.first().item_id)]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert d.common_subsequence(d._masks(a), len(a), b) == table[-1][-1]


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c")]), ([(1, "a b c")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_tables(spark, table_of, docs, items):
    assert d.contaminated(table_of(docs), _items(spark, items)).collect() == []


def test_words_are_trimmed():
    words = d.Words(pa.array(['"The, (cat)!" ... -- x', "", "!"]))
    assert [words.word(i) for i in range(len(words.key))] == [b"the", b"cat", b"x"]
    assert words.first.tolist() == [0, 3, 3, 3]
