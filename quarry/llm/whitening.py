"""Embedding whitening by the exact characteristic polynomial.

Entries become integers, x = floor(64 * c) + 1000000, so the scatter n * sum(x x') - S S', which is n * n times the covariance, is an integer
matrix that Spark sums exactly. Its characteristic polynomial is found modulo many primes, each by Hessenberg reduction, and joined
by the Chinese remainder theorem. The polynomial's roots are all real and not negative, so the sign changes of a shifted polynomial count the
roots above a point: bisection isolates them, and signs at midpoints refine them to ``BITS`` binary places. Components are null
vectors of the scatter less a root, by inverse iteration with ``DIGITS`` decimal digits.

Only what the length of a vector bounds reaches the driver: sums of d * (d + 1) / 2 products, residues for each prime, and the components.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are entries of 2**55 and more, whose x is no long,
and vectors of another length than most have (of ties, the longer). A null id stays; repeated rows count each; ties of eigenvalues
(equal to BITS places) get any orthonormal basis of their space. Eigenvalues of zero have no whitened value, so there are
fewer components where the rank is lower, none for a single row. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import session_parallelism

SCALE, OFFSET = 64, 1_000_000
#: Binary places of the roots, decimal digits of the components' equations.
BITS, DIGITS = 160, 120
#: Limbs of exact products; rows of a product, so that sums of limb products stay below 2**53.
LIMB, TILE = 1 << 20, 4096
_HALVES = 10**30


@dataclass(frozen=True)
class Whitening:
    """n rows of length size with x - OFFSET summing to sums; eigenvalues (of n * n times the covariance) and, in the columns of weights, components over their roots."""

    size: int
    n: int
    sums: tuple[int, ...]
    trace: int
    eigenvalues: tuple[Fraction, ...]
    components: np.ndarray
    weights: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def finite(column: str) -> Column:
    """Whether a vector has entries, and only such as become longs."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**55)), F.lit(False))


def integers(column: pa.Array, size: int) -> np.ndarray:
    """Rows of x - OFFSET."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, size)


def products(y: np.ndarray) -> np.ndarray:
    """y' y as exact integers, from float products of signed limbs."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for lo in range(0, len(y), TILE):
        rest, limbs = y[lo : lo + TILE], []
        while not limbs or rest.any():
            low = (rest + LIMB // 2) % LIMB - LIMB // 2
            limbs.append(low.astype(float))
            rest = (rest - low) // LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * LIMB ** (i + j)
    return total


def scatter(vectors: DataFrame, size: int, column: str) -> tuple[int, list[int], np.ndarray]:
    """The number of vectors, their sums, and the exact integer scatter n * sum(y y') - S S'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            y = integers(batch.column(0), size)
            n += len(y)
            sums += y.astype(object).sum(0) if len(y) and np.abs(y).max() > 1 << 40 else y.sum(0).astype(object)
            total += products(y)
        if n:
            found = [(-1, -1, n), *((-1, j, sums[j]) for j in range(size)), *((i, j, total[i, j]) for i in range(size) for j in range(i, size))]
            parts = [divmod(int(v), _HALVES) for _, _, v in found]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([Decimal(h) for h, _ in parts], kind), pa.array([Decimal(x) for _, x in parts], kind)], ["i", "j", "high", "low"])

    rows = vectors.select(column).mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    got = {(r.i, r.j): int(r.high) * _HALVES + int(r.low) for r in rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n = got.get((-1, -1), 0)
    sums = [got.get((-1, j), 0) for j in range(size)]
    full = np.array([[n * got.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(size)] for i in range(size)], object).reshape(size, size)
    return n, sums, full


# The characteristic polynomial


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below a bound of at most 2**31."""
    out, p = [], below - 1 | 1
    while len(out) < count:
        if all(p % q for q in (3, 5, 7, 11, 13)) and _is_prime(p):
            out.append(p)
        p -= 2
    return out


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test, with bases that decide all numbers below 3.2e9."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def residues(a: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Coefficients, lowest first, of det(z - a) modulo each prime: Hessenberg reduction, then its recurrence."""
    d, p = len(a), np.array(moduli, np.int64)
    h = np.stack([(a % q).astype(np.int64) for q in moduli])
    q, qq, every = p[:, None], p[:, None, None], np.arange(len(p))
    for k in range(d - 2):
        pivot = (h[:, k + 1 :, k] != 0).argmax(1) + k + 1
        h[every, pivot], h[every, k + 1] = h[every, k + 1].copy(), h[every, pivot].copy()
        h[every, :, pivot], h[every, :, k + 1] = h[every, :, k + 1].copy(), h[every, :, pivot].copy()
        inverse = np.array([pow(int(x), -1, m) if x else 0 for x, m in zip(h[:, k + 1, k], moduli, strict=True)], np.int64)
        factor = h[:, k + 2 :, k] * inverse[:, None] % q
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % qq) % qq
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % qq).sum(2)) % q
    series = np.zeros((d + 1, len(p), d + 1), np.int64)
    series[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.roll(series[k - 1], 1, 1)
        new = (new - h[:, k - 1, k - 1, None] * series[k - 1] % q) % q
        below = np.ones(len(p), np.int64)
        for i in range(k - 2, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (h[:, i, k - 1] * below % p)[:, None] * series[i] % q) % q
        series[k] = new
    return series[d]


def remainders(of: list[list[int]], moduli: list[int]) -> list[int]:
    """For each column the integer nearest to zero with these remainders."""
    found, whole = [0] * len(of[0]), 1
    for row, p in zip(of, moduli, strict=True):
        inverse = pow(whole, -1, p)
        found = [x + whole * ((r - x) * inverse % p) for x, r in zip(found, row, strict=True)]
        whole *= p
    return [x - whole if 2 * x > whole else x for x in found]


def polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """The coefficients, lowest first, of det(z - a) of a symmetric integer matrix without negative eigenvalues. Primes are dealt to tasks; there are
    enough for the coefficients' bound (symmetric functions of d numbers with this sum are greatest where all are equal), and one more as a check."""
    d, trace = len(a), int(sum(a[i, i] for i in range(len(a))))
    bound = 2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    moduli = primes(bound.bit_length() // 30 + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine = [moduli[i] for i in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(residues(a, mine).tolist(), pa.list_(pa.int64()))], ["id", "residues"])

    tasks = min(len(moduli), session_parallelism(spark))
    got = {r.id: r.residues for r in spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "id long, residues array<long>").collect()}
    rows = [list(got[i]) for i in range(len(moduli))]
    found = remainders(rows[:-1], moduli[:-1])
    if [x % moduli[-1] for x in found] != [x % moduli[-1] for x in rows[-1]]:
        raise ArithmeticError("the polynomial does not agree with a further prime")
    return found


# Its roots


def above(c: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are greater than a: the sign changes of its coefficients around a."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(c: list[int], x: int) -> int:
    total = 0
    for k in reversed(c):
        total = total * x + k
    return total


def _finer(c: list[int], bits: int) -> list[int]:
    """The polynomial in units of 2**-bits of the present ones."""
    return [x << bits * (len(c) - 1 - k) for k, x in enumerate(c)]


def roots(c: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The greatest positive roots, at least so many if there are, with their multiplicities, falling; to BITS binary places."""
    while len(c) > 1 and c[0] == 0:
        c = c[1:]
    if len(c) < 2:
        return []
    high = 1 << max(1, (-c[-2]).bit_length())  # no root exceeds their sum
    out: list[tuple[Fraction, int]] = []

    def refined(c: list[int], lo: int, hi: int, bits: int) -> Fraction:
        """The only root, a simple one, in (lo, hi]."""
        while True:
            low = _value(c, lo) > 0
            while hi - lo > 1:
                mid = (lo + hi) // 2
                at = _value(c, mid)
                if at == 0:
                    return Fraction(mid, 1 << bits)
                lo, hi = (mid, hi) if (at > 0) == low else (lo, mid)
            if _value(c, hi) == 0 or bits >= BITS:
                return Fraction(hi, 1 << bits)
            c, lo, hi, bits = _finer(c, 32), lo << 32, hi << 32, bits + 32

    def search(c: list[int], lo: int, hi: int, over_lo: int, over_hi: int, bits: int) -> None:
        """Roots in (lo, hi], of which so many are over lo and hi."""
        if over_lo == over_hi or over_hi >= most:
            return
        if over_lo - over_hi == 1 and _value(c, lo):
            out.append((refined(c, lo, hi, bits), 1))
        elif hi - lo > 1:
            mid = (lo + hi) // 2
            over = above(c, mid)
            search(c, mid, hi, over, over_hi, bits)
            search(c, lo, mid, over_lo, over, bits)
        elif bits >= BITS:
            out.append((Fraction(hi, 1 << bits), over_lo - over_hi))
        else:
            search(_finer(c, 32), lo << 32, hi << 32, over_lo, over_hi, bits + 32)

    search(c, 0, high, above(c, 0), 0, 0)
    return out


# Components


def _solved(a: np.ndarray, root: Fraction, b: np.ndarray) -> np.ndarray:
    """(a - root)**-1 b by elimination with pivots; a pivot of zero becomes a tiny one."""
    d = len(a)
    u = np.vectorize(Decimal, otypes=[object])(a)
    u[range(d), range(d)] -= Decimal(root.numerator) / Decimal(root.denominator)
    u = np.concatenate([u, b], 1)
    tiny = max(abs(x) for x in u[:, :d].ravel()) * Decimal(10) ** -(DIGITS * 3 // 4)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(u[i, k]))
        u[[k, pivot]] = u[[pivot, k]]
        if abs(u[k, k]) < tiny:
            u[k, k] = tiny
        factor = u[k + 1 :, k] / u[k, k]
        u[k + 1 :, k:] -= factor[:, None] * u[k, k:]
    x = u[:, d:]
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - u[k, k + 1 : d] @ x[k + 1 :]) / u[k, k] if k + 1 < d else x[k] / u[k, k]
    return x


def _orthonormal(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for k in range(x.shape[1]):
            for j in range(k):
                x[:, k] -= x[:, j] * (x[:, j] @ x[:, k])
            x[:, k] /= (x[:, k] @ x[:, k]).sqrt()
    return x


def null_vectors(a: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """count orthonormal columns of the null space of a - root, each with its largest entry positive, as Decimals."""
    with decimal.localcontext(prec=DIGITS):
        start = np.random.default_rng(5).integers(1, 1 << 30, (len(a), count))
        x = _orthonormal(np.vectorize(Decimal, otypes=[object])(start.astype(object)))
        for _ in range(2):
            x = _orthonormal(_solved(a, root, x))
        for k in range(count):
            top = max(x[:, k], key=abs)
            x[:, k] = x[:, k] if top > 0 else -x[:, k]
        return x


def components(spark: SparkSession, a: np.ndarray, found: list[tuple[Fraction, int]]) -> list[tuple[list[float], list[float]]]:
    """For each root, as often as it counts, its unit component, and that over the square root of the root. Roots are dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                root, count = found[i]
                x = null_vectors(a, root, count)
                with decimal.localcontext(prec=DIGITS):
                    length = (Decimal(root.numerator) / Decimal(root.denominator)).sqrt()
                    out += [(i, k, [float(v) for v in x[:, k]], [float(v / length) for v in x[:, k]]) for k in range(count)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "k", "component", "weight"])

    if not found:
        return []
    rows = spark.range(0, len(found), 1, min(len(found), session_parallelism(spark))).mapInArrow(run, "id long, k int, component array<double>, weight array<double>").collect()
    return [(list(r.component), list(r.weight)) for r in sorted(rows, key=lambda r: (r.id, r.k))]


def fit(vectors: DataFrame, most: int = 32, column: str = "embedding") -> Whitening | None:
    """The whitening by the components of the greatest eigenvalues, at most so many; None where no vector is left."""
    spark, rows = vectors.sparkSession, vectors.where(finite(column))
    common = rows.groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return None
    n, sums, a = scatter(rows.where(F.size(column) == common.size), common.size, column)
    trace = int(sum(a[i, i] for i in range(len(a))))
    found = roots(polynomial(spark, a), most) if trace else []
    made = components(spark, a, found)[:most]
    values = [r for r, m in found for _ in range(m)][:most]
    columns = lambda k: np.array([x[k] for x in made], float).reshape(len(made), common.size).T.copy()
    return Whitening(common.size, n, tuple(sums), trace, tuple(values), columns(0), columns(1))


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly."""
    wide = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.sums)) >= 1 << 62
    return y.astype(object) * model.n - np.array(model.sums, object) if wide else y * model.n - np.array(model.sums, np.int64)


def _squares(z: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    narrow = z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 1 << 62
    return ((z if narrow else z.astype(object)) ** 2).sum(1).tolist()


def whitened(vectors: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each vector that counts: its key, whitened (an array, by component) and deviation, the sum of squares of n * x - S (decimal, null if over 38 digits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _centred(integers(batch.column(1), model.size), model)
            y = z.astype(float) @ model.weights
            deviation = pa.array([Decimal(x) if x < 10**38 else None for x in map(int, _squares(z))], pa.decimal128(38, 0))
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["key", "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where(finite(column) & (F.size(column) == model.size)).select(F.col(key).alias("key"), column)
    return rows.mapInArrow(run, f"key {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of all whitened vectors, whose mean is zero, minus the identity."""
    k = model.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = _centred(integers(batch.column(0), model.size), model).astype(float) @ model.weights
            total += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    if not k:
        return 0.0
    rows = vectors.where(finite(column) & (F.size(column) == model.size)).select(column).mapInArrow(run, "i int, j int, v double")
    one = F.abs(F.sum("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return rows.groupBy("i", "j").agg(one.alias("e")).agg(F.max("e").alias("e")).first().e


def by_component(vectors: DataFrame, most: int = 32, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    model = fit(vectors, most, column)
    if model is None:
        return vectors.where(F.lit(False)).select(key, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    error = identity_error(vectors, model, column)
    rows = whitened(vectors, model, column, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    return rows.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
