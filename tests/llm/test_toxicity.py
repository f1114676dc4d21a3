import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kipimo.llm import toxicity

BAD = ["grumblefoot", "snorkwit"]


def _rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), BAD[i // 4 % 2])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels, words


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_and_misspelt(spark, table_of):
    rows, labels, words = _rows()
    rows += [(900, "ab grumbelfoot cd"), (901, " ".join(words * 20)), (902, " ".join(words * 20) + " snorkwit"), (903, None), (904, "")]
    docs = table_of(rows, ["score", "toxic"])
    teach = F.col("doc_id") % 5 != 0
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, _labels(spark, labels + [(7, 1, None), (8000, 1, 1)]), teach).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    held = [(i, y) for i, _, y in labels if i % 5 == 0]
    assert sum((found[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert found[902] >= 0.5 > found[901]
    assert found[900] > found[901]
    assert found[903] == found[904] < 0.5


def test_one_class_or_none(spark, table_of):
    docs = table_of([(1, "abc def"), (1, "abc def"), (2, None)])
    for labels, expected in ([], 0), ([(1, 1, 0)], 0), ([(1, 1, 1)], 1):
        found = toxicity.score_toxicity(docs, _labels(spark, labels), F.lit(True)).collect()
        assert [round(r.score, 6) for r in found] == [expected] * 3


def test_empty_table(spark, table_of):
    assert toxicity.score_toxicity(table_of([]), _labels(spark, []), F.lit(True)).collect() == []


def test_same_result_in_any_batch(spark):
    rows, labels, _ = _rows()
    texts = [t for _, t in rows]
    model = toxicity.fitted(texts[:100], np.array([y for _, _, y in labels[:100]]), epochs=8)
    whole = model.scores(pa.array(texts))
    parts = np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert np.allclose(whole, parts)


def _plain_score(text, model):
    """A text's score by loops over words, windows and byte n-grams."""
    words = []
    for word in "".join(c.lower() if c.isascii() else c for c in text).split():
        if not words or word != words[-1]:
            words.append(word)
    bags = [words[i : i + toxicity.WINDOW] for i in range(max(len(words) - toxicity.WINDOW + 1, min(len(words), 1)))]
    best = None
    for bag in bags:
        held = []
        for word in bag:
            data = b" " + word.encode() + b" "
            for n in toxicity.SIZES:
                for i in range(len(data) - n + 1):
                    key = sum(int(toxicity._TABLE[j][c]) for j, c in enumerate(data[i : i + n])) % (1 << 64)
                    held.append(int(toxicity.mixed(np.array([key], np.uint64))[0]) % toxicity.BUCKETS)
        mean = sum(float(model.weights[b]) for b in held) / max(len(held), toxicity.LEAST)
        best = mean if best is None else max(best, mean)
    return 1 / (1 + np.exp(-((best or 0.0) + model.bias)))


def test_scores_equal_plain_loops():
    rng = random.Random(3)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 30, toxicity.BUCKETS).astype(np.float32), -0.3)
    alphabet = ["a", "Bc", "dEf", "é", "日本", "x" * 40, "a", "!", "grumble", " "]
    texts = ["", " ", "a", "a a a a", "b" * 300] + [
        " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(60)
    ]
    assert np.allclose(model.scores(pa.array(texts)), [_plain_score(t, model) for t in texts], atol=1e-6)


def test_slopes_equal_differences():
    rows, labels, _ = _rows()
    texts, y = [t for _, t in rows[:12]] + [""], np.array([y for _, _, y in labels[:12]] + [0])
    bags = toxicity.Bags(pa.array(texts))
    rng = np.random.default_rng(2)
    values = [rng.normal(0, 1, (toxicity.BUCKETS, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)]
    target, weight = np.stack([1 - y, y], 1), rng.uniform(0.5, 1, len(y))

    def loss(whole):
        scores = values[0] @ values[1]
        means = np.stack([bags.means(scores[:, k]) for k in (0, 1)], 1)
        total = 0.0
        for d in range(bags.n):
            windows = np.flatnonzero(bags.doc == d)
            if not whole and len(windows):
                windows = windows[[np.argmax((means[:, 1] - means[:, 0])[windows])]]
            for w in windows:
                log = means[w] + values[2]
                total -= weight[d] / len(windows) * (log[y[d]] - np.log(np.exp(log).sum()))
        return total

    for whole in (True, False):
        slopes = toxicity.slopes(bags, values, target, weight, whole)
        places = [(0, (int(b), k)) for b in bags.buckets[:4] for k in (0, 2)]
        for k, at in places + [(1, (0, 0)), (1, (2, 1)), (2, (0,)), (2, (1,))]:
            values[k][at] += 1e-5
            up = loss(whole)
            values[k][at] -= 2e-5
            down = loss(whole)
            values[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - slopes[k][at]) < 1e-5


def test_held_out_documents(spark):
    """The given documents and labels: trained on four fifths, judged on the rest."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = toxicity.score_toxicity(docs, labels, fold != 0)
    rows = found.filter(fold == 0).join(labels.filter("toxic is not null"), "doc_id").select("score", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    assert toxic.sum() >= 5
    assert np.mean(score[toxic][:, None] > score[~toxic]) >= 0.9
    assert np.mean(score[~toxic] >= 0.5) <= 0.05
