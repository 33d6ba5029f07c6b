"""The vector index against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.operators import cells, dense
from corpusengine.operators.cells import CellIndex


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((40, 16)) * 3
    x = middle[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16))
    odd = [(5001, None), (5002, []), (5003, [1.0] * 15), (5004, [None] * 16), (5005, [float("nan")] * 16), (None, [1.0] * 16), (5006, [0.0] * 16)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4000 + i, x[0].tolist()) for i in range(20)] + odd, "vec_id long, embedding array<double>").cache()


def asked(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def rows(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_recall_and_exactness(vectors, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(cells, "TILE", 50)
    monkeypatch.setattr(cells, "QUERIES", 7)
    index = CellIndex.build(vectors, str(tmp_path / metric), metric=metric)
    whole = vectors.where("embedding is not null and size(embedding) = 16 and not isnan(embedding[0]) and vec_id is not null" + (" and vec_id <> 5006" if metric == "cosine" else ""))
    want = rows(dense.nearest(asked(vectors), whole, 10, "query_id", "vec_id", metric=metric))
    assert rows(index.nearest_exact(asked(vectors), probes=2)) == want
    probes = index.fitted(10, 0.95)
    assert 1 <= probes < len(index.at)
    got = rows(index.nearest(asked(vectors), probes=probes))
    found = {(q, v) for (q, _), (v, _) in got.items()}
    assert sum((q, v) in found for (q, _), (v, _) in want.items()) >= 0.95 * len(want)


def test_cells_read_only_probed_lists(vectors, tmp_path):
    index = CellIndex.build(vectors, str(tmp_path / "t"), cells=30)
    one = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    probed = index._probed(index._asked(one, "query_id", "embedding"), lambda d, _: d <= np.partition(d, 2, 1)[:, [2]])
    read = index.lists(probed)
    assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().toString()) and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read.select("cell").distinct().count() == 3
    assert index.nearest(one, 1, 1).first()["vec_id"] == 7
    again = CellIndex(index.spark, index.root)  # opened by its folder
    assert again.nearest(one, 1, 1).first()["vec_id"] == 7


def test_cells_without_rows(spark, vectors, tmp_path):
    index = CellIndex.build(vectors.where("false"), str(tmp_path / "t"))
    assert index.nearest(asked(vectors)).count() == 0 and index.nearest_exact(asked(vectors)).count() == 0 and index.fitted() == 1
    few = CellIndex.build(vectors.where("vec_id in (0, 4000, 4001)"), str(tmp_path / "u"), cells=9)
    got = rows(few.nearest_exact(vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")))
    assert [v for _, (v, _) in sorted(got.items())] == [0, 4000, 4001]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_scores_are_held_in_tiles(spark, vectors, tmp_path, metric, monkeypatch):
    """However many rows meet however many queries, no matrix of more than SCORES is made, and results stay those of one matrix."""
    asked_for, index = asked(vectors), CellIndex.build(vectors, str(tmp_path / metric), metric=metric, cells=3)
    want = rows(dense.nearest(asked_for, vectors.where("vec_id < 5000"), 10, "query_id", "vec_id", metric=metric))
    x = np.array([[float(i % 7), float(i % 5)] for i in range(500)])
    whole, parts = dense.Best(3, 10), dense.Best(3, 10)
    whole.add(np.round(x[:3] @ x.T, 0), np.arange(500)[::-1])
    for tile in dense.tiles(500, dense.SCORES // 9):
        parts.add(np.round(x[:3] @ x[tile].T, 0), np.arange(500)[::-1][tile])
    assert (whole.query == parts.query).all() and (whole.key == parts.key).all()
    assert max(len(range(500)[t]) for t in dense.tiles(500, 10)) == 500 and [len(range(500)[t]) for t in dense.tiles(500, dense.SCORES // 200)][:2] == [200, 200]
    monkeypatch.setattr(dense, "SCORES", 700)
    monkeypatch.setattr(cells, "ROWS", 5)
    assert rows(dense.nearest(asked_for, vectors.where("vec_id < 5000"), 10, "query_id", "vec_id", metric=metric)) == want
    assert rows(index.nearest_exact(asked_for, probes=1)) == want
