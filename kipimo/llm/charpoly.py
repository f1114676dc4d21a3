"""Exact characteristic polynomials of symmetric integer matrices, their roots and eigenvectors.

The polynomial is found modulo many primes (Hessenberg reduction, one task row per
prime) and put together by Chinese remaindering; the number of primes follows from a
bound on the coefficients.  All roots of a positive semi-definite matrix are real and
none is negative, so the sign changes of the polynomial shifted to a are exactly its
roots above a.  That isolates the roots of each square-free factor; bisection then
takes them as far as their neighbours demand.  Eigenvectors come from inverse iteration in decimals
whose precision follows from the gap to the next root.

The work grows with the dimension alone, never with the number of vectors.
"""

from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_TOP_PRIME = 1 << 31
_BITS = 80  # of a root's first refinement, relative to the largest
_GUARD = 20  # decimal digits by which an iteration suppresses other components


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 2**32."""
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds ``bound``."""
    found, product, p = [], 1, _TOP_PRIME - 1
    while product <= bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo p, lowest power first."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(d - 2):
        rows = np.flatnonzero(a[k + 1 :, k]) + k + 1
        if not len(rows):
            continue
        r = rows[0]
        if r != k + 1:
            a[[r, k + 1]] = a[[k + 1, r]]
            a[:, [r, k + 1]] = a[:, [k + 1, r]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k block
    minors[0, 0] = 1
    for k in range(d):
        step = np.zeros(k + 1, np.int64)
        run = 1
        for i in range(k, -1, -1):
            step[i] = int(a[i, k]) * run % p
            run = run * int(a[i, i - 1]) % p if i else 0
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (step[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d].tolist()


def coefficient_bound(matrix: np.ndarray) -> int:
    """No coefficient of a positive semi-definite matrix's polynomial is larger (Maclaurin)."""
    d = len(matrix)
    mean = int(np.trace(matrix)) // d + 1
    return max(comb(d, k) * mean**k for k in range(d + 1))


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, lowest power first, of a positive semi-definite integer matrix."""
    primes = primes_above(2 * coefficient_bound(matrix))

    def by_prime(batches):
        for batch in batches:
            at = batch.column(0).to_pylist()
            coefficients = [charpoly_mod(matrix, primes[i]) for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(coefficients, pa.list_(pa.int64()))], ["i", "c"]
            )

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(by_prime, "i long, c array<long>").collect()
    product = 1
    for p in primes:
        product *= p
    total = [0] * (len(matrix) + 1)
    for i, c in rows:
        rest = product // primes[i]
        unit = rest * pow(rest, -1, primes[i])
        total = [t + unit * x for t, x in zip(total, c)]
    return [x - product if 2 * x > product else x for x in (t % product for t in total)]


def _primitive(f: list[int]) -> list[int]:
    """Without trailing zeros of high powers and common factors, leading coefficient positive."""
    while f and f[-1] == 0:
        f = f[:-1]
    if not f:
        return f
    g = gcd(*f)
    return [x // (g if f[-1] > 0 else -g) for x in f]


def _slope(f: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(f)][1:]


def _divided(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of f times a power of g's leading coefficient."""
    rest, quotient, lead = list(f), [0] * max(len(f) - len(g) + 1, 0), g[-1]
    for i in range(len(f) - len(g), -1, -1):
        top = rest[i + len(g) - 1]
        rest = [lead * x for x in rest]
        quotient = [lead * x for x in quotient]
        quotient[i] += top
        for j, c in enumerate(g):
            rest[i + j] -= top * c
    return quotient, rest[: len(g) - 1]


def _common(f: list[int], g: list[int]) -> list[int]:
    """Greatest common divisor, primitive at every step."""
    while g := _primitive(g):
        f, g = g, _divided(f, g)[1]
    return _primitive(f)


def _separable_mod(f: list[int], p: int) -> bool:
    """No repeated root modulo p, hence none at all."""
    a, b = [x % p for x in f], [x % p for x in _slope(f)]
    while True:
        while b and b[-1] == 0:
            b.pop()
        if not b:
            return len(a) == 1
        unit = pow(b[-1], -1, p)
        while len(a) >= len(b):
            top = a[-1] * unit % p
            shift = len(a) - len(b)
            for j, c in enumerate(b):
                a[shift + j] = (a[shift + j] - top * c) % p
            a.pop()
        a, b = b, a


def squarefree_factors(f: list[int]) -> list[tuple[list[int], int]]:
    """(factor, multiplicity): factors without repeated roots whose powers make up f."""
    f = _primitive(f)
    if len(f) < 2:
        return []
    if _separable_mod(f, primes_above(1)[0]):
        return [(f, 1)]
    found, times = [], 1
    repeated = _common(f, _slope(f))
    simple = _primitive(_divided(f, repeated)[0])
    while len(simple) > 1:
        still = _common(simple, repeated) if len(repeated) > 1 else [1]
        once = _primitive(_divided(simple, still)[0])
        if len(once) > 1:
            found.append((once, times))
        repeated = _primitive(_divided(repeated, still)[0])
        simple, times = still, times + 1
    return found


def _scaled(f: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of f."""
    d = len(f) - 1
    return [c << bits * (d - i) for i, c in enumerate(f)]


def roots_above(f: list[int], a: int) -> int:
    """How many roots of f, all of them real, lie above a."""
    c = list(f)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(f: list[int], x: int) -> int:
    value = 0
    for c in reversed(f):
        value = value * x + c
    return value


def isolated_roots(f: list[int], top: int) -> list[tuple[int, int]]:
    """(k, bits): each root of f lies alone in (k, k + 1] / 2**bits; descending.

    f has no repeated root, and all its roots are in (0, top].
    """
    d, found = len(f) - 1, []
    open_cells = [(0, -top.bit_length(), 0, d)]  # cell (k, k+1] / 2**bits with roots from..to counted from above
    while open_cells:
        k, bits, above, upto = open_cells.pop()
        if upto - above == 1:
            found.append((k, bits))
            continue
        # one step finer; a cell wider than 1 is cut at an integer
        middle = 2 * k + 1
        if bits < 0:
            n = roots_above(f, middle << (-bits - 1))
        else:
            n = roots_above(_scaled(f, bits + 1), middle)
        if n > above:
            open_cells.append((middle, bits + 1, above, n))
        if upto > n:
            open_cells.append((2 * k, bits + 1, n, upto))
    return sorted(found, key=lambda cell: Decimal(cell[0]) / Decimal(2) ** cell[1], reverse=True)


def refined(f: list[int], k: int, bits: int, to_bits: int) -> tuple[int, int]:
    """The cell of the one root in (k, k + 1] / 2**bits, ``to_bits`` fine."""
    if bits < 0:
        lo, hi, bits = k << -bits, (k + 1) << -bits, 0
    else:
        lo, hi = k, k + 1
    if to_bits > bits:
        lo, hi, bits = lo << (to_bits - bits), hi << (to_bits - bits), to_bits
    g = _scaled(f, bits)
    rising = roots_above(g, hi) % 2 == 0  # f is positive just above its root
    while hi - lo > 1:
        middle = (lo + hi) // 2
        value = _value(g, middle)
        if value == 0 or (value > 0) == rising:
            hi = middle
        else:
            lo = middle
    return lo, bits


def eigenvectors(matrix: np.ndarray, root: Decimal, gap: Decimal, times: int, digits: int) -> list[list[float]]:
    """``times`` orthonormal vectors of the eigenvalue ``root``, known to ``digits`` digits.

    ``gap`` is the distance to the next eigenvalue.  The matrix is shifted by the root
    and a hair, so that it can be solved and the root's own directions grow by 10**20 a step.
    """
    with localcontext() as context:
        context.prec = digits
        d = len(matrix)
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
        shift = root + gap.scaleb(-_GUARD)
        a[np.diag_indices(d)] -= shift
        order = list(range(d))
        for k in range(d):
            r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if r != k:
                a[[r, k]] = a[[k, r]]
                order[r], order[k] = order[k], order[r]
            if k + 1 < d:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[k, k + 1 :]

        def solved(b):
            x = b[order]
            for k in range(1, d):
                x[k] -= (a[k, :k] * x[:k]).sum()
            for k in range(d - 1, -1, -1):
                if k + 1 < d:
                    x[k] -= (a[k, k + 1 :] * x[k + 1 :]).sum()
                x[k] /= a[k, k]
            return x

        start, vectors = np.random.default_rng(d), []
        for _ in range(times):
            v = np.array([Decimal(int(x)) for x in start.integers(1, 1 << 20, d)], object)
            for _ in range(4):
                v = solved(v)
                for u in vectors:
                    v = v - u * (u * v).sum()
                v = v / (v * v).sum().sqrt()
            vectors.append(v)
        signed = [v if max(v, key=abs) > 0 else -v for v in vectors]
        return [[float(x) for x in v] for v in signed]


def eigen_decomposition(
    spark: SparkSession, matrix: np.ndarray, most: int
) -> tuple[list[Decimal], list[list[float]]]:
    """The ``most`` largest positive eigenvalues, falling and repeated by multiplicity, with unit vectors.

    ``matrix`` is a positive semi-definite array of Python integers.
    """
    d, top = len(matrix), int(np.trace(matrix)) if len(matrix) else 0
    if top <= 0 or most < 1:
        return [], []
    polynomial = characteristic_polynomial(spark, matrix)
    zeros = next(i for i, c in enumerate(polynomial) if c)
    cells = []
    for f, times in squarefree_factors(polynomial[zeros:]):
        for k, bits in isolated_roots(f, top):
            cells.append((f, times, *refined(f, k, bits, max(_BITS, bits + _BITS))))
    # cells of different factors: refine until no two touch, then order them
    bits = max(c[3] for c in cells)
    while True:
        cells = [(f, times, *refined(f, k, b, bits)) for f, times, k, b in cells]
        cells.sort(key=lambda c: c[2], reverse=True)
        if all(x[2] - y[2] > 1 << (_BITS // 2) for x, y in zip(cells, cells[1:])):
            break
        bits += _BITS
    low = [c[2] for c in cells] + ([0] if zeros else [])
    wanted, at = [], 0
    for i, (f, times, k, _) in enumerate(cells):
        if at >= most:
            break
        near = [abs(k - low[j]) for j in (i - 1, i + 1) if 0 <= j < len(low)] or [k]
        gap = min([*near, k])
        wanted.append((f, times, k, gap))
        at += times

    def components(batches):
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                f, times, k, gap = wanted[i]
                loss = (top << bits).bit_length() - gap.bit_length()  # bits between the trace and the gap
                extra = 200
                cell, fine = refined(f, k, bits, bits + extra)
                digits = int((loss + extra + bits) * 0.302) + 60
                with localcontext() as context:
                    context.prec = digits
                    root = Decimal(cell) / (Decimal(2) ** fine)
                    space = Decimal(gap) / (Decimal(2) ** bits)
                vectors = eigenvectors(matrix, root, space, times, digits)
                out.append((i, str(root), vectors))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.list_(pa.list_(pa.float64()))),
                ],
                ["i", "root", "vectors"],
            )

    tasks = min(len(wanted), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(wanted), 1, tasks).mapInArrow(
        components, "i long, root string, vectors array<array<double>>"
    ).collect()
    values, vectors = [], []
    for _, root, found in sorted((r.i, r.root, r.vectors) for r in rows):
        for v in found:
            values.append(Decimal(root))
            vectors.append(v)
    return values[:most], vectors[:most]
