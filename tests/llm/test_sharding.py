import numpy as np
import pytest

from quarry.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    p = sharding.permuted(x, n, seed=5)
    assert sorted(p) == list(range(n))
    assert (sharding.permuted(p, n, seed=5, back=True) == x).all()
    shard, slot = sharding.place(x, n, 4, seed=5)
    assert (sharding.number_at(shard, slot, n, 4, seed=5) == x).all()
    if n == 1000:
        assert abs(np.corrcoef(x, p)[0, 1]) < 0.15 and (p != sharding.permuted(x, n, seed=6)).any()


def test_table(spark):
    rows = [(i if i % 9 else None, f"t{i}", 5, "x", 1) for i in range(203)] + [(5, "t5", 5, "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, law string, part int")
    got = sharding.assigned(df, ["doc_id", "text"]).toPandas()
    assert list(got.columns) == ["doc_id", "text", "law", "part", "shard", "slot"]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    shard, slot = sharding.place(np.arange(len(rows)), len(rows), 8)
    want = sorted((r[1], s, t) for r, s, t in zip(ordered, shard.tolist(), slot.tolist()))
    assert sorted(zip(got.text, got["shard"].tolist(), got["slot"].tolist())) == want
    sizes = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()


def test_empty_table(spark):
    assert sharding.assigned(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sharding.write_shards(spark.range(100), path, ["id"], shards=3)
    got = spark.read.parquet(path)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [33, 33, 34]
