"""Indexes that are kept by commits: equal to what is made anew, and writing only what a batch touches."""

import random

import pytest
from pyspark.sql import functions as F

from corpusengine.operators import sparse
from corpusengine.operators.buckets import BucketTable
from corpusengine.operators.inverted import InvertedIndex
from corpusengine.operators.manifest import Manifest
from corpusengine.streaming import index_sync


def files_below(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def texts(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def scores(df):
    return {(r["query_id"], r["doc_id"]): r["score"] for r in df.collect()}


def equal(index, docs, queries):
    assert scores(index.okapi(queries)) == pytest.approx(scores(sparse.okapi(docs, queries)), abs=1e-9)


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "t"))
    assert m.read() is None and m.numbers() == []
    for n in (3, 12, 5, 12):
        m.commit(n, {"x": n, "é": "ü"})
    assert m.numbers() == [3, 5, 12] and m.read() == {"x": 12, "é": "ü"} and m.read(below=12)["x"] == 5 and m.read(3) is None
    assert [x["x"] for x in m.forget(2)] == [5, 12] and m.numbers() == [5, 12]


def test_inverted_index_equals_one_made_anew(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices("abcdefghij", [9, 8, 7, 5, 4, 3, 2, 1, 1, 1], k=rng.randint(0, 12)))
    index, docs = InvertedIndex(spark, str(tmp_path / "index"), buckets=4), {}
    queries = spark.createDataFrame([(1, "a b c"), (2, "j j i"), (3, "nowhere"), (4, None)], "query_id int, text string")
    for number in (1, 2, 4, 6, 7):
        fresh = {k: text() for k in rng.sample(range(12), 5)}
        gone = rng.sample(range(14), 3)
        docs = {k: t for k, t in docs.items() if k not in gone} | fresh
        index.apply(number, texts(spark, fresh), spark.createDataFrame([(k,) for k in [*gone, None]], "doc_id long"))
        if number == 4:
            index.merge(5)
            index.clean()
            assert index.manifest.children("postings") == ["segment=5"]
        anew = texts(spark, docs)
        equal(index, anew, queries)
        assert {tuple(r) for r in index.frequencies().collect()} == {tuple(r) for r in sparse.document_frequency(sparse.postings(anew, "doc_id")).collect()}
        assert {r["doc_id"] for r in index.documents().collect()} == set(docs)


def test_inverted_index_batch_again_and_empty(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "index"), buckets=4)
    queries = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert index.okapi(queries).count() == 0 and index.frequencies().count() == 0
    index.merge(1)
    index.apply(1)
    assert index.okapi(queries).count() == 0
    index.apply(2, texts(spark, {1: "a b", 2: "b c d", 3: None}))
    for _ in range(2):  # after a loss the same batch comes again
        index.apply(3, texts(spark, {2: "a a"}), spark.createDataFrame([(1,)], "doc_id long"))
    equal(index, texts(spark, {2: "a a", 3: None}), queries)
    index.apply(4, gone=spark.createDataFrame([(2,), (3,)], "doc_id long"))
    assert index.documents().count() == 0 and index.frequencies().count() == 0 and index.manifest.read()["n"] == 0


def test_inverted_index_writes_and_reads_only_touched_buckets(spark, tmp_path):
    root = tmp_path / "index"
    index = InvertedIndex(spark, str(root), buckets=16)
    index.apply(1, texts(spark, {i: f"common w{i}" for i in range(60)}))
    before = files_below(root)
    index.apply(2, texts(spark, {5: "common fresh"}))
    after = files_below(root)
    assert {f: t for f, t in after.items() if f in before} == before
    new = [f for f in after if f not in before]
    assert {f.split("/")[0] for f in new} == {"documents", "postings", "frequencies", "tombstones"}
    assert len({f.split("/")[2] for f in new if f.startswith("postings/")}) <= 2
    read = index._only(index._read("postings", [1, 2]), "token", spark.createDataFrame([("w7",)], "token string"))
    assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().toString()) and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def rows(spark, items):
    return spark.createDataFrame(items, "path string, mtime double, chunk string")


def state(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_bucket_table_touches_only_its_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), buckets=8)
    assert table.read() is None
    assert len(table.replace(0, rows(spark, [(f"p{i}", 1.0, f"c{j}") for i in range(40) for j in range(2)]))) == 8
    before = files_below(tmp_path / "t")
    assert len(table.replace(1, rows(spark, [("p3", 2.0, "new")]))) == 1
    after = files_below(tmp_path / "t")
    assert {f: t for f, t in after.items() if f in before} == before
    assert len({f.split("bucket=")[1][0] for f in after if f not in before}) == 1
    want = sorted([(f"p{i}", 1.0, f"c{j}") for i in range(40) if i != 3 for j in range(2)] + [("p3", 2.0, "new")])
    assert state(table) == want
    # the same stamps again, and the same number again, change nothing
    assert table.replace(2, rows(spark, [("p3", 2.0, "new"), ("p4", 1.0, "c0"), ("p4", 1.0, "c1")]), stamp="mtime") == []
    assert files_below(tmp_path / "t") == after and table.manifest.numbers() == [0, 1]
    assert len(table.replace(1, rows(spark, [("p3", 2.0, "new")]))) == 1 and state(table) == want
    # readers of an older commit still find it, until it is cleaned away
    assert table.read(below=1).where("path = 'p3'").count() == 2
    gone = spark.createDataFrame([(f"p{i}",) for i in range(39)] + [(None,)], "path string")
    table.replace(3, rows(spark, []), gone)
    assert state(table) == [("p39", 1.0, "c0"), ("p39", 1.0, "c1")]
    assert table.clean(keep=1) and state(table) == [("p39", 1.0, "c0"), ("p39", 1.0, "c1")]
    assert {f.split("/")[1] for f in files_below(tmp_path / "t")} <= {"version=0", "version=3"}


def test_bucket_table_without_rows(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.replace(0, rows(spark, [])) == [] and state(table) == []
    table.replace(1, rows(spark, [("a", None, None), (None, 1.0, "x")]))
    assert state(table) == [("a", None, None)]
    table.replace(2, rows(spark, []), spark.createDataFrame([("a",)], "path string"))
    assert state(table) == [] and table.read().columns == ["path", "mtime", "chunk"]


def test_sync_stream_writes_one_bucket_for_one_path(spark, tmp_path):
    schema, source, index = "path string, mtime double, text string", str(tmp_path / "in"), tmp_path / "index"
    make = lambda items: spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(source)
    chunks = lambda df: df.select("path", F.explode(F.split("text", " ")).alias("chunk"))
    run = lambda: index_sync.sync(spark.readStream.schema(schema).parquet(source), chunks, str(index), str(tmp_path / "cp"), buckets=8)
    make([(f"p{i}", 1.0, f"x{i} y") for i in range(30)])
    run()
    before = files_below(index)
    make([("p1", 2.0, "z")])
    run()
    new = set(files_below(index)) - set(before)
    assert len({f.rsplit("/", 1)[0] for f in new}) == 1 and set(before) - set(files_below(index)) == set()
    run()  # nothing has arrived
    assert set(files_below(index)) - set(before) == new
    now = index_sync.current(spark, str(index))
    assert {(r["path"], r["chunk"]) for r in now.where("path in ('p1', 'p2')").collect()} == {("p1", "z"), ("p2", "x2"), ("p2", "y")} and now.count() == 59


def test_inverted_parts_follow_the_rows(spark, tmp_path, monkeypatch):
    """Postings are dealt to as many tasks as their number asks for, and tokens are counted without a group by document and token."""
    from corpusengine.operators import inverted

    docs = spark.range(60).selectExpr("id AS doc_id", "concat('a b a c', id, ' d', id % 7) AS text")
    found = []
    for name, part in (("few", inverted.PART), ("many", 5)):
        monkeypatch.setattr(inverted, "PART", part)
        index = inverted.InvertedIndex(spark, str(tmp_path / name), buckets=2)
        index.apply(1, docs)
        index.merge(2)
        files = index._read("postings", [2]).inputFiles()
        found.append((len(files), {(r["token"], r["df"]) for r in index.frequencies().collect()}, {(r["doc_id"], r["dl"], tuple(sorted(map(tuple, r["terms"])))) for r in index.documents().collect()}))
    assert found[0][1:] == found[1][1:] and found[1][0] > 2 * inverted.SPREAD >= found[0][0]
    assert ("a", 60) in found[0][1] and (1, 5, (("a", 2), ("b", 1), ("c1", 1), ("d1", 1))) in found[0][2]
