"""Every stage of the pipeline on its own input against a brute-force version."""

import os
import random
import sys

import public_tokenizers as P
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as pipeline  # noqa: E402

from kipimo.llm import byte_bpe, decontamination  # noqa: E402
from kipimo.plans.stage import BATCH_BYTES  # noqa: E402

from test_jaccard import _expected as groups_of  # noqa: E402
from test_lines import _expected as lines_of  # noqa: E402
from test_quality import _expected as counts_of  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, table_of, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14)))
    text = lambda: "\n".join(line() for _ in range(rng.randint(8, 14)))
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for i in range(8)]
    rows = [(i, text(), "en", f"h{i % 5}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "h1") for i in range(6)]  # copies
    rows += [(110 + i, rows[i][1] + "\n" + text(), "en", "h2") for i in range(6)]  # copies and more
    near = " ".join(rng.choice(words) for _ in range(120)).split()
    for i in range(5):  # near copies without line breaks
        own = list(near)
        own[i * 20] = "qq"
        rows.append((120 + i, " ".join(own), "en", "h3"))
    rows += [(130 + i, text() + "\n" + items[i][1] + "\n" + text(), None, "h4") for i in range(8)]  # leaks
    rows += [(140, None), (141, ""), (142, "too short"), (143, "spam " * 200), (None, text())]
    path = str(tmp_path_factory.mktemp("sf"))
    table_of(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    assert [len(pipeline.STAGES)] == [5]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        given = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
            found = sorted(((str(r.doc_id), r.text) for r in docs.collect()), key=str)
        if k == 0:
            counts = {i: counts_of(t) for i, t in given}
            expected = [(i, t) for i, t in given if counts[i][0] >= 50 and 2 * counts[i][4] <= counts[i][0]]
            assert len(expected) < len(given)
        elif k == 1:
            expected = [(i, t) for i, _, n, t in lines_of(given, 6) if n == 0 or t.split()]
            assert len(expected) < len(given)
        elif k == 2:
            kept = {i for i, _, c in groups_of(given) if i == c}
            expected = [(i, t) for i, t in given if str(i) in kept]
            assert len(expected) < len(given)
        elif k == 3:
            expected = [(i, t) for i, t in given if not any(b in " ".join(t.split()) for b in benchmark.values())]
            assert len(expected) == len(given) - 8
        else:
            whole = byte_bpe.encoding(pipeline.RANKS, P.PATTERN)
            assert sorted((str(r.doc_id), r.ids) for r in docs.collect()) == sorted(
                (str(i), whole.encode_ordinary(t)) for i, t in given
            )
            break
        assert found == sorted(((str(i), t) for i, t in expected), key=str)
    last = sorted(map(str, docs.collect()))
    assert sorted(map(str, pipeline.run(spark, folder).collect())) == last


def test_empty_table(spark, folder, table_of):
    docs = table_of([])
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
        docs = table_of([])


def test_documents_without_id_are_told_apart(spark, table_of, folder):
    """A nameless near copy goes; an unrelated nameless document stays."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    first, other = words(200), words(200)
    near = first.rsplit(" ", 1)[0] + " end"
    (item, *_) = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    leak = f"{words(60)} {item} {words(60)}"
    rows = [(5, first), (None, near), (None, other), (None, other), (None, ""), (None, ""), (None, None), (None, leak), (-3, words(80))]
    kept = pipeline.one_of_each_group(spark, table_of(rows), folder)
    expected = [(5, first), (None, other), (None, ""), (None, ""), (None, None), (None, leak), rows[-1]]
    assert kept.columns == pipeline.COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, expected))
    kept = pipeline.without_benchmark(spark, table_of(rows), folder)
    expected = [r for r in rows if r[1] != leak]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, expected))


def test_good_documents_keep_columns_of_any_name(spark, table_of):
    from kipimo.llm import quality

    good = " ".join(f"w{i}" for i in range(60))
    docs = table_of([(i, good + str(i), None, f"h{i % 3}") for i in range(30)] + [(99, "bad")], ["_failed", "base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 30


def test_batches_are_bounded_by_bytes(spark, folder):
    """The tables of a stage reach Python in batches of a megabyte, not of 10,000 rows."""
    own = spark.newSession()
    docs = own.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.good_quality(own, docs, folder)
    wide = own.range(0, 4000, 1, 1).selectExpr("repeat('x', 2000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    assert kept.count() > 0
    found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 8_000_000 and max(found) < 3_000_000
    own.conf.set(BATCH_BYTES, "2m")
    pipeline.good_quality(own, docs, folder)
    assert own.conf.get(BATCH_BYTES) == "2m"


def test_one_worker_a_task(spark, folder, monkeypatch):
    """The two stages with two steps in Python: no task runs both in workers of their own."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def chained(node):
        """Whether a step in Python reads from another without a shuffle between."""
        while node.children().size() == 1:
            node = node.children().head()
            if node.nodeName() == "MapInArrow":
                return True
            if node.nodeName() == "Repartition" or "Aggregate" in node.nodeName():
                return False
        return False

    def steps(node):
        own = [node] if node.nodeName() == "MapInArrow" else []
        return own + [s for k in range(node.children().size()) for s in steps(node.children().apply(k))]

    whole, fitted = decontamination.singular_vectors, []

    def counted(passages, idf):
        fitted.append(passages)
        return whole(passages, idf)

    monkeypatch.setattr(decontamination, "singular_vectors", counted)
    frames = [pipeline.without_benchmark(spark, docs, folder), pipeline.encoded(spark, docs, folder), *fitted]
    assert len(fitted) == 1
    assert not steps(fitted[0]._jdf.queryExecution().optimizedPlan())
    for frame in frames:
        found = steps(frame._jdf.queryExecution().optimizedPlan())
        assert not any(chained(step) for step in found)
