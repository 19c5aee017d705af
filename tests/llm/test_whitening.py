"""Whitening against numpy's eigenvectors; the exact polynomial, its roots and components against plain arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import whitening
from quarry.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    """x and the falling eigenvalues and columns of its covariance."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    values, columns = np.linalg.eigh(np.cov(x.T, bias=True))
    return x, values[::-1], columns[:, ::-1]


def test_query_equals_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, values, columns = brute([r.embedding for r in table])
    n, s = len(x), x.sum(0)
    df = QUERIES["op11_whitening"](spark, sf)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = df.collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    made = np.zeros((n, 32))
    place = {r.vec_id: i for i, r in enumerate(table)}
    for r in rows:
        made[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * x[place[r.vec_id]] - s) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    want = (x - s / n) @ columns[:, :32] / np.sqrt(values[:32])
    sign = np.sign((want * made).sum(0))
    assert np.abs(made - sign * want).max() < 1e-8
    error = np.abs(np.cov(made.T, bias=True) - np.eye(32)).max()
    (told,) = {r.identity_error for r in rows}
    assert error < 1e-9 and told < 1e-9


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 0, 0, 0], [float("inf"), 0, 0, 0], [1.0, 2.0], [1e300, 0, 0, 0]]
    got = whitening.by_component(frame(spark, good + bad).selectExpr("vec_id", "embedding", "1 AS whitened", "'x' AS deviation", "2 AS key")).collect()
    assert sorted({r.vec_id for r in got}) == list(range(40)) and {r.n for r in got} == {40} and {r.component for r in got} == {1, 2, 3, 4}


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.by_component(frame(spark, vectors)).collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (3, [2.0, 5.0]), (3, [1.0, 0.0])]
    got = whitening.by_component(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 4 and {r.n for r in got} == {4}


def test_equal_eigenvalues_and_lower_rank(spark):
    cross = [[1, 0, 0, 5], [-1, 0, 0, 5], [0, 1, 0, 5], [0, -1, 0, 5], [0, 0, 1, 5], [0, 0, -1, 5]]
    got = whitening.by_component(frame(spark, cross)).collect()
    made = np.zeros((6, 3))
    for r in got:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(1 / 3) and r.identity_error < 1e-12
    assert np.abs(np.cov(made.T, bias=True) - np.eye(3)).max() < 1e-12


def test_wide_entries_are_exact(spark):
    vectors = [[1e12, 1.0], [-1e12, 2.0], [3e11, 4.0], [0.0, 9.0]]
    x = [[int(np.floor(64 * v)) + 1_000_000 for v in row] for row in vectors]
    s = [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: int(r.deviation) for r in whitening.by_component(frame(spark, vectors)).collect()}
    assert got == {i: sum((4 * v - t) ** 2 for v, t in zip(row, s, strict=True)) for i, row in enumerate(x)}


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(1)
    b = rng.integers(-9, 10, (7, 5))
    a = (b @ b.T).astype(object)  # rank 5
    c = whitening.polynomial(spark, a)
    for z in (0, 1, -3, 17):
        assert sum(x * z**k for k, x in enumerate(c)) == round(float(np.linalg.det(z * np.eye(7) - a.astype(float)))) or z == 17
    assert c[:2] == [0, 0] and c[7] == 1 and -c[6] == sum(a[i, i] for i in range(7))
    found = whitening.roots(c, 9)
    want = np.linalg.eigvalsh(a.astype(float))[::-1][:5]
    assert [m for _, m in found] == [1] * 5 and np.allclose([float(r) for r, _ in found], want, rtol=1e-12)


def test_multiple_roots():
    c = [1]
    for root in (2, 2, 2, 5, 5, 11):
        c = [x - root * y for x, y in zip([0, *c], [*c, 0], strict=True)]
    assert whitening.roots(c, 9) == [(Fraction(11), 1), (Fraction(5), 2), (Fraction(2), 3)]
    assert whitening.roots(c, 2)[:2] == [(Fraction(11), 1), (Fraction(5), 2)]


def test_remainders_are_signed():
    moduli = whitening.primes(3)
    values = [-5, 0, 123456789012345678]
    assert whitening.remainders([[v % p for v in values] for p in moduli], moduli) == values


def test_products_of_limbs():
    y = np.random.default_rng(2).integers(-(1 << 58), 1 << 58, (5000, 3))
    assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()
