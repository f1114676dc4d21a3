import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kipimo.llm import jaccard
from kipimo.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _expected(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((str(doc_id), len(sets[i]), str(min(ids) if ids else None)))
    return sorted(out)


def _check(spark, table_of, rows):
    docs = table_of(rows, ["n", "cls", "component_id"]).repartition(3)
    found = jaccard.similar_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == _expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, table_of, seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 14)):  # near copies on both sides of the bound
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            rows.append((rng.randint(0, 500), " ".join(own) if rng.random() < 0.5 else "\n".join(own).upper()))
    rows += [(i, t) for i, t in enumerate([None, "", " \n ", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e f"])]
    rows += [(None, "q r s t u v"), (None, "only null"), (7, "q r s t u v"), (7, "Q r s t u v")]
    _check(spark, table_of, rows)


def test_chain_common_passage_and_copies(spark, table_of):
    base = [f"c{i}" for i in range(100)]
    chain = [(1000 - i, " ".join([f"z{j}" for j in range(2 * i)] + base[2 * i :])) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(12))
    rng = random.Random(5)
    shared = [(2000 + i, passage + " " + " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(40)]
    copies = [(3000 + i, "One Two three four five six seven") for i in range(60)]
    _check(spark, table_of, chain + shared + copies)


def test_empty_table(spark, table_of):
    assert jaccard.similar_documents(table_of([])).collect() == []


def test_components(spark):
    rng = random.Random(3)
    names = rng.sample(range(-(10**9), 10**9), 60)
    links = [(names[i], names[i + 1]) for i in range(30)] + [(names[40], names[i]) for i in range(41, 60)] + [(names[31], names[31])]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted([sorted(names[:31]), sorted(names[40:])])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_families_around_the_bound(spark, table_of, monkeypatch, seed):
    """Much of each text is one passage; regions of a few classes are cut by pivots."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", seed - 3)
    rng = random.Random(seed)
    rows = []
    for family in range(3):
        passage = [f"p{family}_{i}" for i in range(rng.randint(40, 90))]
        for _ in range(40):
            own = [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, len(passage) // 3))]
            rows.append((rng.randint(0, 10**6), " ".join(own + passage if rng.random() < 0.5 else passage + own)))
    for _ in range(60):  # common phrases in many orders
        parts = rng.sample(range(8), 5)
        rows.append((rng.randint(0, 10**6), " ".join(f"m{p}_{i}" for p in parts for i in range(12))))
    _check(spark, table_of, rows)


def test_reach_is_tight():
    """A pair at the bound is within reach at its first common shingle, one below is not."""
    n, d = jaccard.NUMERATOR, jaccard.DENOMINATOR
    for size_a in range(1, 60):
        for size_b in range(size_a, 80):
            for own in range(size_a):
                common = size_a - own  # all that follows the first common shingle
                reach = (d * size_a - (d + n) * own) // n
                assert (size_b <= reach) == (d * common >= n * (size_a + size_b - common))


def test_counts_of_many_tasks_do_not_wrap():
    """Cells with more than 255 in all, but few in each task, stay frequent."""
    counts = zlib.compress(np.full(jaccard.SKETCH_PART, 64, np.uint8).tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([counts] * 4, pa.binary())], ["part", "counts"])
    level = [np.frombuffer(b.column(1)[0].as_py(), np.uint8) for b in jaccard._summed([batch])]
    assert level[0].min() == round(4 * np.log2(257))


def test_cells_allow_all_similar_sets():
    """Few and many cells alike let every similar pair through, and large unrelated sets not."""
    rng = np.random.default_rng(2)
    sets = []
    for size in (3, 300, 2500, 9000, 40000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets += [base, base[: -(-size * 4 // 5)], rng.integers(0, 1 << 63, size, dtype=np.uint64)]
    size = np.array([len(s) for s in sets])
    cells = [
        np.minimum(np.bincount((s % np.uint64(w)).astype(int), minlength=w), 255).astype(np.uint8).tobytes()
        for s, w in zip(sets, jaccard._widths(size).tolist())
    ]
    allowed = jaccard._Cells(size, cells).allowed
    for i in range(0, len(sets), 3):
        assert allowed(np.array([i]), np.array([i + 1])).all()
        assert len(sets[i]) == 3 or not allowed(np.array([i]), np.array([i + 2])).any()


def test_pairs_of_a_region_that_nothing_parts(spark, monkeypatch):
    """A region above ``LEAF`` is dealt into blocks: each pair once, no join of its rows with themselves."""
    monkeypatch.setattr(jaccard, "LEAF", 5)
    cells = bytes([1] * jaccard.CELLS)
    rows = spark.createDataFrame([(h, i, 256, 320, i) for h in (1, 2) for i in range(h * 16)], "h long, cls long, n long, reach long, comp long")
    classes = spark.createDataFrame([(i, 256, bytearray(cells)) for i in range(32)], "cls long, n long, cells binary")
    found = jaccard._remaining_pairs(rows, classes).collect()
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in range(32) for b in range(a + 1, 32)]
