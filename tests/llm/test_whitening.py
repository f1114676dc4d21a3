import math

import numpy as np
import pytest

from kipimo.llm import charpoly, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string, component string")

    return make


def _rows(matrix):
    return [(i, [float(x) for x in row], "x", None) for i, row in enumerate(matrix)]


def _brute(matrix):
    x = np.floor(64 * np.asarray(matrix, np.float64)) + 1_000_000
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], vectors[:, ::-1]


def _table(df):
    rows = df.collect()
    k = max((r.component for r in rows), default=0)
    ids = sorted({r.vec_id for r in rows})
    table = np.full((len(ids), k), NAN)
    for r in rows:
        table[ids.index(r.vec_id), r.component - 1] = r.whitened
    return rows, table


@pytest.mark.parametrize("d, primes", [(1, 3), (2, 2), (5, 4), (9, 6)])
def test_polynomial_and_roots_of_integer_matrices(spark, d, primes):
    rng = np.random.default_rng(d)
    half = rng.integers(-50, 50, (d + 3, d)).astype(object)
    matrix = half.T @ half
    found = charpoly.characteristic_polynomial(spark, matrix)
    expected = np.poly(matrix.astype(float))[::-1]
    assert found[-1] == 1 and np.allclose(np.array(found, float), expected, rtol=1e-6)
    values, vectors = charpoly.eigen_decomposition(spark, matrix, d)
    assert np.allclose([float(v) for v in values], np.linalg.eigvalsh(matrix.astype(float))[::-1], rtol=1e-10)
    assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(d), atol=1e-15)


def test_hessenberg_reduction_with_missing_pivots():
    matrix = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], object)
    p = charpoly.primes_above(1)[0]
    assert p == 2**31 - 1
    # (x - 3)^3 (x - 1)
    assert charpoly.charpoly_mod(matrix, p) == [27, p - 54, 36, p - 10, 1]


def test_repeated_and_close_roots(spark):
    f = [1]
    for root, times in [(7, 3), (1, 2), (1000, 1)]:
        for _ in range(times):
            f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    parts = {times: factor for factor, times in charpoly.squarefree_factors(f)}
    assert parts == {3: [-7, 1], 2: [-1, 1], 1: [-1000, 1]}
    close = np.diag(np.array([10**30 + 1, 10**30, 10**30, 5, 0], object))
    values, vectors = charpoly.eigen_decomposition(spark, close, 5)
    assert [int(v.to_integral_value()) for v in values] == [10**30 + 1, 10**30, 10**30, 5]
    assert abs(vectors[0][0]) == 1 and abs(vectors[3][3]) == 1 and abs(vectors[1][0]) < 1e-60
    assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(4), atol=1e-15)


def test_whitened_rows_equal_brute_force(spark, vectors_of):
    rng = np.random.default_rng(1)
    matrix = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    x, centred, values, axes = _brute(matrix)
    rows, table = _table(whitening.whiten(vectors_of(_rows(matrix)), components=5))
    assert table.shape == (300, 5) and {r.n for r in rows} == {300}
    expected = centred @ axes[:, :5] / np.sqrt(values[:5])
    signs = np.sign((expected * table).sum(0))
    assert np.allclose(table, expected * signs, atol=1e-9)
    sums = x.sum(0).astype(int)
    deviation = {i: sum(int(300 * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert all(r.deviation == deviation[r.vec_id] for r in rows)
    assert all(math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) for r in rows)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10


def test_odd_rows(spark, vectors_of):
    rng = np.random.default_rng(2)
    good = _rows(rng.normal(size=(40, 3)))
    odd = [
        (None, None, "x", None), (1, None, None, None), (2, [], None, None), (3, [1.0, None, 2.0], None, None),
        (4, [1.0, NAN, 2.0], None, None), (5, [INF, 0.0, 0.0], None, None), (6, [1.0, 2.0], None, None),
    ]
    found = whitening.whiten(vectors_of(good + [(None, good[0][1], None, None), good[1], *odd])).collect()
    assert {r.n for r in found} == {42} and len(found) == 42 * 3
    assert sum(r.vec_id is None for r in found) == 3 and sum(r.vec_id == 1 for r in found) == 6


def test_components_without_variance_are_left_out(spark, vectors_of):
    rng = np.random.default_rng(3)
    flat = rng.integers(-9, 9, (30, 2))
    plane = [[a, b, a + b, 5] for a, b in flat]
    rows, table = _table(whitening.whiten(vectors_of(_rows(plane))))
    assert table.shape == (30, 2)
    assert np.allclose(table.T @ table / 30, np.eye(2), atol=1e-10)
    assert whitening.whiten(vectors_of(_rows([[1, 2]] * 5))).collect() == []
    assert whitening.whiten(vectors_of([])).collect() == []
    assert whitening.whiten(vectors_of(_rows([[1, 2]]))).collect() == []


def test_equal_variances_and_huge_entries(spark, vectors_of):
    cross = [[3, 0, 0], [-3, 0, 0], [0, 3, 0], [0, -3, 0], [0, 0, 1], [0, 0, -1]]
    rows, table = _table(whitening.whiten(vectors_of(_rows(cross))))
    assert np.allclose(table.T @ table / 6, np.eye(3), atol=1e-12)
    rows, table = _table(whitening.whiten(vectors_of(_rows([[1e30, 0.5], [-1e30, 0.25], [3.0, 7.0]]), "double")))
    assert table.shape == (3, 2) and np.isfinite(table).all()
    assert [r.deviation for r in rows if r.vec_id == 0] == [None, None]


def test_query_on_the_table(spark):
    from kipimo.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    matrix = [r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()]
    _, centred, values, axes = _brute(matrix)
    rows, table = _table(QUERIES["op11_whitening"](spark, path))
    expected = centred @ axes[:, :32] / np.sqrt(values[:32])
    assert np.allclose(table, expected * np.sign((expected * table).sum(0)), atol=1e-8)
    assert rows[0].identity_error < 1e-10
