"""Resampling, neighbours and lexical search against brute force, and on hard inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.llm import lexical, neighbours, queries, resampling
from tests.compare import same
from tests.llm.brute import lower

CLASH = ["h", "h2", "c", "place", "rank", "score", "query", "bin", "part", "tile", "weight", "number", "part_", "n", "total", "terms", "df", "dim", "key", "bound"]
LONG = " ".join(f"w{i % 977} and{i % 31}" for i in range(40_000))
ROWS = [(1, "A b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG), (6, "a B c d e"), (None, "x y a"), (None, None), (1, "A b c d e"), (7, "é 中文 \U0001f600 ß a"), (8, "b " * 30), (-9, "b " * 30), (None, "b " * 30)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# ---- resampling


def resampled(rows, target):
    feats = lambda t: (w := words(t)) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, x in rows:
        f = feats(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, x) in zip(out, rows, strict=True) if len(words(x)) >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return sorted(map(str, map(tuple, out)))


def test_resampling_equals_sql(spark, small):
    same(spark, queries.op11_resampling, queries.oracle_sql()["op11_resampling"], small)


def test_resampling_hard(spark):
    rows = ROWS + [(100 + i, f"word{i % 7} " * (10 + i)) for i in range(40)]
    target = [(1, "a b c"), (2, None), (3, "word3 word3 é")]
    got = resampling.resampled(docs(spark, rows).repartition(5), items(spark, target)).collect()
    assert sorted(str(tuple(r)) for r in got) == resampled(rows, [t for _, t in target])


def test_resampling_empty(spark):
    assert resampling.resampled(docs(spark, []), items(spark, [(1, "a")])).count() == 0
    rows = [(i, "a b c d e f g h i j " * 3) for i in range(8)]
    got = resampling.resampled(docs(spark, rows), items(spark, [])).collect()
    assert sorted(str(tuple(r)) for r in got) == resampled(rows, [])
    assert {r["rank"] for r in got} == {1, 2, None}


def test_resampling_follows_the_target(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "one two three four ") * 8) for i in range(400)]
    kept = resampling.taken(docs(spark, rows), items(spark, [(1, "alpha beta gamma delta " * 50)]))
    assert kept.columns == docs(spark, rows).columns and kept.count() == 100
    assert kept.where("doc_id % 2 = 1").count() >= 95


# ---- lexical search


def ranked(rows, asked, k=20):
    docs_ = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n, total = len(docs_), sum(sum(c.values()) for _, c in docs_)
    df = Counter(t for _, c in docs_ for t in c)
    out = []
    for item, text in asked:
        scores = []
        for i, c in docs_:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            scores += [(-score, i is None, i or 0, i)] if score else []
        out += [(item, place, s[3], -s[0]) for place, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def test_search_equals_sql(spark, small):
    same(spark, queries.op13_search, queries.oracle_sql()["op13_search"], small)


def test_search_hard(spark):
    asked = [(1, "a b B nowhere"), (2, None), (3, ""), (4, "中文 w5 and7"), (4, "and1"), (None, "a"), (5, "a b B nowhere"), (6, "nowhere")]
    got = lexical.ranked(docs(spark, ROWS).repartition(3), items(spark, asked)).collect()
    assert sorted(str(tuple(r)) for r in got) == ranked(ROWS, asked)
    assert lexical.ranked(docs(spark, []), items(spark, asked)).count() == 0
    assert lexical.ranked(docs(spark, ROWS), items(spark, [])).count() == 0


@pytest.mark.parametrize(("segment", "k"), [(3_000, 20), (10**9, 3)])
def test_search_skips_nothing(spark, monkeypatch, segment, k):
    """Segments of any size, blocks of several bytes, many ties, queries in several blocks."""
    rng = np.random.default_rng(segment)
    common = [f"t{min(x, 400)}" for x in rng.zipf(1.3, 60_000)]
    cuts = np.sort(rng.integers(0, len(common), 1500))
    rows = [(int(i), " ".join(common[a:b])) for i, (a, b) in zip(rng.permutation(1500), zip(cuts, cuts[1:], strict=False), strict=False)] + [(5000, "t1 " * 70_000), (5001, "t2")]
    asked = [(j, " ".join(f"t{x}" for x in rng.integers(1, 300, 1 + j * 3))) for j in range(12)]
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 60)
    monkeypatch.setattr(lexical, "CELLS", 100)
    indexed = lexical.indexed
    monkeypatch.setattr(lexical, "indexed", lambda d: indexed(d, segment))
    got = lexical.ranked(docs(spark, rows).repartition(2), items(spark, asked), k).collect()
    assert sorted(str(tuple(r)) for r in got) == ranked(rows, asked, k)


def test_search_leaves_blocks_compressed():
    """Once there are four results, blocks of the common word are opened only where the rare one stands: the first 118, and a few."""
    vocabulary = {b"common": 0, b"rare": 1}
    tokens = [np.array([0, 1, 1] if i % 5000 == 7 else [0], np.int32) for i in range(40_000)]
    row = lexical.packed(vocabulary, tokens, list(range(40_000)), 40_000, sum(map(len, tokens))).iloc[0]
    segment, best = lexical.Segment(row), [lexical.Best(4)]
    lexical.search(segment, np.array([[0, 1]]), np.array([[5, 9000]]), best)
    assert sorted(-d for _, _, d in best[0].heap) == [7, 5007, 10007, 15007]
    assert len(segment.open) == 314 and segment.open.sum() <= 118 + 8


# ---- neighbours


def exact(vectors, k=20):
    usable = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            near = sorted((-math.fsum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def frame(spark, vectors, kind="double"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("clash") for c in CLASH})


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, near in want.items():
        mine = sorted(found.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += (Counter(r["vec_id"] for r in mine) & Counter(i for i, _ in near)).total()
    assert set(found) == {q for q, near in want.items() if near}
    return hits / max(1, sum(map(len, want.values())))


def test_neighbours_recall_on_tables(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert recall(queries.op12_neighbours(spark, small).collect(), exact([(r[0], r[1]) for r in rows])) >= 0.9


def test_neighbours_of_unequal_norms_and_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24)) * rng.lognormal(0, 0.7, (1500, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[40].tolist()) for i in range(500)]
    got = neighbours.nearest(frame(spark, vectors)).collect()
    want = exact(vectors)
    assert recall(got, want) >= 0.9
    scores = {(q, i): s for q, near in want.items() for i, s in near}
    assert all(abs(r["score"] - scores[r["query_id"], r["vec_id"]]) < 1e-9 for r in got if (r["query_id"], r["vec_id"]) in scores)
    # copies of a query that is their nearest: the least ids but its own
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 2020][:3] == [i for _, i in sorted((-s, i) for i, s in want[2020])][:3]


def test_neighbours_of_several_rotations(spark, monkeypatch):
    """Buckets of two axes, tiles, bins and parts of several tasks."""
    for name, value in (("BUCKET", 2), ("TILE", 4), ("BIN", 64), ("QUERIES", 5), ("SAMPLE", 30)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 12))
    vectors = [(i, (centres[i % 30] + 0.15 * rng.standard_normal(12)).tolist()) for i in range(900)]
    searcher = neighbours.Searcher(frame(spark, vectors))
    searcher.fit()
    assert searcher.depth == 2
    assert recall(neighbours.nearest(frame(spark, vectors)).collect(), exact(vectors)) >= 0.9


def test_neighbours_hard(spark):
    odd = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    vectors = [*odd, (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (140, [2.0]), (-20, [5.0, 1.0]), (3, [-1.0, 0.0]), (3, [0.0, 7.0]), (160, [1.0, 1.0, 1.0])]
    for kind in ("double", "float"):
        assert recall(neighbours.nearest(frame(spark, vectors, kind)).collect(), exact(vectors)) == 1
    assert neighbours.nearest(frame(spark, odd)).count() == 0
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1.0])])).count() == 0


def test_hadamard_keeps_inner_products():
    x = np.random.default_rng(1).standard_normal((5, 9))
    near = neighbours.axes(x, 0, 0)
    assert near.shape == (5, 32) and np.allclose(near[:, :16] @ near[:, :16].T, x @ x.T) and (near[:, :16] == -near[:, 16:]).all()
    first = neighbours.probes(x, 1, 2, 7)
    assert (first[:, 0] == neighbours.bucket_keys(x, 2)[:, 1]).all() and all(len(set(r)) == 7 for r in first.tolist())
