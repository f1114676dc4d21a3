"""PCA whitening of vectors by the exact spectrum of their integer scatter.

Entries become integers, so counts, sums and products are exact: each task adds up the
products of its rows in integers and sends them as 32-bit limbs, which Spark sums.  The
scatter n*sum(x x') - S S' is n squared times the covariance; its characteristic
polynomial, roots and eigenvectors are computed exactly or in high precision
(``charpoly``), in tasks by prime and by component.  Rows are projected where they
lie: no row is shuffled, and what reaches the driver is one number per pair of
dimensions, whatever the number of rows.

Defined cases: vectors that are null, or hold a null, NaN or infinite entry, are left
out, and so are empty ones and those not of the most common length (ties: the longer);
null and repeated ids, and repeated rows, count and are returned as they come; entries
beyond 2**62 / 64 count as that; a component without variance is not returned, so fewer
rows than dimensions, or only equal vectors, give fewer components or none; equal
eigenvalues share any orthonormal basis of their space; a deviation beyond a long is
null; an empty table gives an empty result; other columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charpoly import eigen_decomposition

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
_LIMBS, _LIMB_BITS = 6, 32
_ROWS = 4096  # rows worked on at once
_SMALL = 1 << 20  # entries up to this size multiply exactly in doubles, a block at a time
_LARGEST = 1 << 62


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): finite vectors of the most common length."""
    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = chosen.filter(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    lengths = finite.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return finite.filter(F.size("v") == (lengths.d if lengths else -1))


def _blocks(batches):
    """(batch slice, its vectors as an integer matrix) in blocks of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                y = np.floor(SCALE * flat).clip(-float(_LARGEST), float(_LARGEST)).astype(np.int64)
            yield part, y.reshape(part.num_rows, -1)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of (1, y) over the rows, as Python integers."""
    z = np.concatenate([np.ones((len(y), 1), np.int64), y], 1)
    small = np.abs(y).max(1) < _SMALL
    a = z[small].astype(float)
    total = (a.T @ a).astype(np.int64).astype(object)  # below 2**52 in all
    if not small.all():
        b = z[~small].astype(object)
        total = total + b.T @ b
    return total


def _limbs(values: np.ndarray) -> list[pa.Array]:
    out, mask = [], (1 << _LIMB_BITS) - 1
    for _ in range(_LIMBS - 1):
        out.append(pa.array((values & mask).astype(np.int64)))
        values = values >> _LIMB_BITS
    return [*out, pa.array(values.astype(np.int64))]


def integer_moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and sums of products of the entries floor(64 * c), exact."""

    def moments(batches):
        total = None
        for _, y in _blocks(batches):
            products = _products(y)
            total = products if total is None else total + products
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *_limbs(total[i, j])],
                ["i", "j", *(f"l{k}" for k in range(_LIMBS))],
            )

    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS))
    rows = (
        vectors.mapInArrow(moments, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)])
        .collect()
    )
    d = max((r.j for r in rows), default=0)
    table = np.zeros((d + 1, d + 1), object)
    for i, j, *limbs in rows:
        table[i, j] = table[j, i] = sum(x << _LIMB_BITS * k for k, x in enumerate(limbs))
    return int(table[0, 0]), table[0, 1:], table[1:, 1:]


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums, exact: as long where that is large enough."""
    largest = n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if largest < 1 << 63:
        return n * y - sums.astype(np.int64)
    return n * y.astype(object) - sums


def _deviations(centred: np.ndarray) -> pa.Array:
    if centred.dtype != object:
        largest = int(np.abs(centred).max(initial=0))
        if largest * largest * centred.shape[1] < 1 << 63:
            return pa.array((centred * centred).sum(1), pa.int64())
        centred = centred.astype(object)
    return pa.array([x if x < 1 << 63 else None for x in (centred * centred).sum(1)], pa.int64())


def whitened_identity_error(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = basis.shape[1]

    def moments(batches):
        total = np.zeros((k + 1, k + 1))
        for _, y in _blocks(batches):
            w = _centred(y, n, sums).astype(float) @ basis
            w = np.concatenate([np.ones((len(w), 1)), w], 1)
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"]
        )

    rows = vectors.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((k + 1, k + 1))
    for i, j, s in rows:
        table[i, j] = table[j, i] = s
    mean = table[0, 1:] / n
    return float(np.abs(table[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component.

    vec_id, component (from 1, by falling variance), n, deviation (sum of (n*x - S)**2),
    whitened, explained (share of the variance), identity_error (one value for all).
    """
    usable = usable_vectors(vectors, id_col, vector_col)
    n, sums, products = integer_moments(usable)
    scatter = n * products - np.outer(sums, sums)
    values, axes = eigen_decomposition(vectors.sparkSession, scatter, components)
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not values:
        return vectors.sparkSession.createDataFrame([], schema)
    trace = int(np.trace(scatter))
    roots = np.array([math.sqrt(v) for v in values])
    explained = np.array([float(v / trace) for v in values])
    basis = np.array(axes).T / roots
    error = whitened_identity_error(usable, n, sums, basis)
    k = len(values)

    def projected(batches):
        for part, y in _blocks(batches):
            centred = _centred(y, n, sums)
            whitened = centred.astype(float) @ basis
            each = np.repeat(np.arange(len(y)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(each), n, np.int64)),
                    _deviations(centred).take(pa.array(each)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, len(y))),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(projected, schema)
