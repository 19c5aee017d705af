import numpy as np
import pytest

from quarry.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, copies string"


def brute(rows, limit=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float32).astype(float)
        return x / np.linalg.norm(x)

    u = [unit(r[1]) for r in rows]
    node = [r[0] if r[0] is not None else f"null{i}" for i, r in enumerate(rows)]
    root = {x: x for x in node}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = u[i], u[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ b >= limit:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(node[i]), find(node[j])), key=lambda k: (isinstance(k, str), k))
                root[y] = x
    return sorted(((r[0], n, None if r[0] is None else find(k), r[0] is not None and r[0] == find(k)) for r, n, k in zip(rows, links, node)), key=str)


@pytest.fixture
def rows():
    rng = np.random.default_rng(8)
    out, base = [], rng.normal(size=(20, 64))
    for i in range(240):
        v = base[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.18, 1])
        out.append((3 * i + 1, v.tolist(), int(i % 20 % 3), "x"))
    v = out[0][1]
    nan = float("nan")
    return [
        *out, (2, v, 0, ""), (5, v, 0, ""), (8, v, 1, ""), (11, None, 0, ""), (14, [], 0, ""), (17, [0.0] * 64, 0, ""), (20, [*v[:-1], None], 0, ""), (23, [*v[:-1], nan], 0, ""), (26, [*v[:-1], float("inf")], 0, ""),
        (29, v, None, ""), (32, v[:32], 0, ""), (35, v[:32], 0, ""), (38, [1e-30] * 3, 0, ""), (41, [1e30] * 3, 0, ""), (44, [-2.0], 0, ""), (47, [-1.0], 0, ""), (47, [-1.0], 0, ""),
    ]


def got(spark, rows, **options):
    df = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def test_matches_brute_force(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_blocks_lose_no_link(spark, rows):
    assert got(spark, rows, block=4) == brute(rows)


def test_null_ids_and_empty_table(spark, rows):
    assert got(spark, [(None, rows[0][1], 0, ""), (1, rows[0][1], 0, ""), (None, None, None, None)]) == sorted([(None, 1, None, False), (1, 1, 1, True), (None, 0, None, False)], key=str)
    assert got(spark, []) == []


def test_repeated_ids_join_components_of_labels_but_no_links(spark, rows):
    v, w = rows[0][1], [x + 1e-3 for x in rows[0][1]]
    mixed = [(1, v, 0, ""), (2, w, 0, ""), (2, v, 1, ""), (3, w, 1, ""), (4, v, 2, ""), (1, v[:32], 0, ""), (6, v[:32], 0, "")]
    assert got(spark, mixed) == brute(mixed)
    assert got(spark, mixed + mixed) == brute(mixed + mixed)


def test_one_large_cluster_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    cluster = [(i, (base + rng.normal(size=64) * 0.13).tolist(), 0, "") for i in range(700)]
    want = brute(cluster)
    assert 10 < np.mean([r[1] for r in want]) < 650
    assert got(spark, cluster, block=100) == want and got(spark, cluster) == want


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(9, 32))
    y = ed.rotated(x, ed._signs(32, 2, 3)[1])
    np.testing.assert_allclose(y @ y.T, x @ x.T, atol=1e-9)


def test_recall_near_the_limit():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    x, y = ed.buckets(a, 4, 3, 2), ed.buckets(b, 4, 3, 2)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.99
