from itertools import combinations

import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute(rows, k=4, radius=4):
    fps = {}
    for doc, text, *_ in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    comp = {d: d for d in fps}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {(d, f"{fps[d]:016x}", root(d)) for d in fps}


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    out, base = [], [" ".join(word() for _ in range(400)) for _ in range(12)]
    for i in range(60):
        words = base[i % 12].split()
        for _ in range(i // 12):
            words[rng.integers(len(words))] = word()
        out.append((i * 3, " ".join(words), "en", "x"))
    return [*out, (1, None, None, None), (2, "", "", ""), (4, " \n\t", "", ""), (5, "One two", "", ""), (7, "one TWO", "", ""), (8, "été ÉTÉ a b c", "", ""), (1000, "x " * 50_000, "", "")]


def test_matches_brute_force(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_blocks_lose_no_link(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=3)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([*rows, rows[0], (None, "q", "en", "x")], SCHEMA).withColumnRenamed("lang", "Rank")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted({c for _, _, c in brute(rows)})
    assert got.where("doc_id is null").count() == 1


def brute_alike(rows, k=5, similarity=0.8):
    """The rows (by place) that one_of_alike keeps, from all pairs."""
    words = [(r[1] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min((d is None, d or 0) for d in g) for g in groups.values()), key=str)


@pytest.fixture
def variants():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    out = []
    for i in range(240):
        base = [word() for _ in range(rnd.choice([120, 150, 400]))]
        for _ in range(rnd.randrange(1, 4)):
            copy = list(base)
            # no word, one of the text or one in ten differs: far from the limit on either side
            for _ in range(rnd.choice([0, 1, len(copy) // 10])):
                copy[rnd.randrange(len(copy))] = word()
            out.append((len(out) * 7 % 1009, " ".join(copy), "en", "x"))
    crowd = [word() for _ in range(200)]
    for i in range(90):
        out.append((2000 + i, " ".join([*crowd[: i % 200], word(), *crowd[i % 200 + 1 :]]), "de", "y"))
    return [*out, (5000, None, None, None), (5001, "", "", ""), (5002, " \n", "", ""), (None, "One two", "", ""), (None, "q r s", "", ""), (5003, "one TWO", "", ""), (5004, "x " * 50_000, "", ""), out[0], out[0], (out[0][0], "another text of one doc_id", "", "")]


def test_one_of_alike_matches_all_pairs(spark, variants):
    df = spark.createDataFrame(variants, SCHEMA).withColumnRenamed("lang", "Rank").withColumnRenamed("fp", "key")
    want = brute_alike(variants)
    for options in ({}, {"block": 8}):
        got = simhash.one_of_alike(df, **options)
        assert got.columns == df.columns
        assert sorted(((r.doc_id is None, r.doc_id or 0) for r in got.collect()), key=str) == want


def test_alike_compares_groups_in_blocks(spark, variants):
    rows = [r for r in variants if r[0] is not None and 2000 <= r[0] < 2090]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = simhash.signatures(docs, 5).selectExpr("key", "words", "1L AS group")
    edges = simhash.alike(docs.select(simhash.row_key().alias("key"), "text"), own, 5, 0.8, block=16).collect()
    root = {w: w for e in edges for w in (e.a, e.b)}
    for e in edges:
        a, b = e.a, e.b
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    assert len(root) == len({r[1] for r in rows}) and sum(root[w] == w for w in root) == 1


def test_jaccard_of_many_sets_equals_that_of_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 300)
    sets = [np.unique(np.concatenate((base[rng.random(300) < rng.choice([0.7, 0.95, 1.0])], rng.integers(0, 2**60, rng.integers(0, 40))))) for _ in range(60)]
    a, b = simhash._alike(sets, 0.8, None)
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both))}
    assert all(tuple(sorted(e)) in linked for e in zip(a, b))
    reach = lambda edges: simhash.spanning(60, *map(np.array, zip(*edges)))
    assert len(a) == len(reach(sorted(linked))[0])


def test_candidates_near_the_limit_are_mostly_found(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(400):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in range(3, 300, 50):  # each change takes five shingles of 296
            copy[at] = word()
        rows += [(2 * i, " ".join(base), "", ""), (2 * i + 1, " ".join(copy), "", "")]
    left = simhash.one_of_alike(spark.createDataFrame(rows, SCHEMA)).count()
    assert 400 <= left < 400 + 0.15 * 400


def test_one_of_alike_of_an_empty_table(spark):
    assert simhash.one_of_alike(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    b[::2] = a[::2] ^ (np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64))
    lanes = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)).astype(int) for s in range(32)])
    got = simhash.manhattan(simhash.embedded(a), simhash.embedded(b))
    assert (got == np.abs(lanes(a) - lanes(b)).sum(0)).all()
    assert (got <= np.bitwise_count(a ^ b)).all()
