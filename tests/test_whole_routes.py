"""Queries of routes that take every vector as a query."""

import math

import numpy as np
import pytest

from corpusengine.operators import dense
from corpusengine.plans import registry


def brute(rows, k):
    """The k nearest of each row by plain sums, others of its key left out; ties to the smaller key."""
    good = [(key, v) for key, v in rows if key is not None and v and None not in v]
    found = {}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y):
                n = math.sqrt(sum(t * t for t in x)) or 1, math.sqrt(sum(t * t for t in y)) or 1
                score = sum(s / n[0] * t / n[1] for s, t in zip(x, y, strict=True))
                found.setdefault(a, []).extend([] if math.isnan(score) else [(-round(score, 9), b)])
    return {(a, i + 1, b, -s) for a, near in found.items() for i, (s, b) in enumerate(sorted(near)[:k])}


@pytest.mark.parametrize("values", [24, 1 << 17])
def test_nearest_others_equals_brute_force(spark, monkeypatch, values):
    """Odd rows and copies, whatever the size of blocks and parts."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4 if i % 7 else 3).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(9)] + [(200, [0.0] * 4), (201, None), (202, []), (203, [1.0, None, 2.0, 3.0]), (204, [math.nan] * 4), (205, [5.0])]
    rows += [(None, [1.0, 2.0, 0.0, 1.0]), (5, [1.0, 0.0, 1.0, 1.0]), (-3, [2.0, 4.0, 0.0, 2.0])]
    for name, value in (("VALUES", values), ("BLOCKS", 2), ("PARTS", 2)):
        monkeypatch.setattr(dense, name, value)
    found = dense.nearest_others(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, "query_id", "vec_id").collect()
    got = {(x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9) + 0.0) for x in found}
    assert len(got) == len(found) and got == {(a, i, b, s + 0.0) for a, i, b, s in brute(rows, 5)}


def test_best_keeps_the_k_best_of_tiles():
    """What stays between tiles is what a sort of all scores gives."""
    r = np.random.default_rng(1)
    s, keys = r.integers(-4, 4, (6, 300)) / 4 + r.integers(0, 2, (6, 300)) * 1e-12, r.permutation(300)
    s[2, 5:] = np.nan
    best = dense.Best(6, 7)
    for tile in (slice(0, 3), slice(3, 100), slice(100, 300)):
        best.add(s[:, tile].copy(), keys[tile])
    for i in range(6):
        want = sorted((-round(x, 9), key) for x, key in zip(s[i], keys, strict=True) if x == x)[:7]
        assert sorted((-round(x, 9), key) for x, key in zip(best.score[best.query == i], best.key[best.query == i], strict=True)) == want


def every(spark, small):
    return {r["vec_id"] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").collect()}


def test_route_scores_takes_every_vector(spark, small):
    assert {r["query_id"] for r in registry.QUERIES["route_scores"](spark, small).select("query_id").collect()} == every(spark, small)


def test_route_near_miss_takes_every_vector(spark, small):
    assert {r["query_id"] for r in registry.QUERIES["route_near_miss"](spark, small).select("query_id").collect()} == every(spark, small)


def test_route_confusion_counts_every_vector(spark, small):
    assert sum(r["n"] for r in registry.QUERIES["route_confusion"](spark, small).collect()) == len(every(spark, small))
