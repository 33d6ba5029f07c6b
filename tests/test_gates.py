"""Chains of gates, streams of calls, ids of tokens."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusengine.operators import audit, sparse
from corpusengine.operators.gates import Chain, Gate
from corpusengine.operators.ordering import numbered
from corpusengine.plans import registry
from corpusengine.sources import files
from corpusengine.streaming import calls, index_sync

START = datetime(2024, 1, 1, 10)


def test_chain_counts_what_it_blocks_in_one_pass(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    chain = Chain([Gate("zero", F.col("x") == 0, F.lit("is zero")), Gate("null", F.col("y") > 1), Gate("even", F.col("id") % 2 == 0)], before=[lambda d: d.withColumn("y", F.lit(None).cast("int"))], after=[("x", F.col("x") * 10)])
    seen = Observation()
    out = chain.run(rows, seen)
    assert out.columns == ["id", "x", "y"] and {r["x"] for r in out.collect()} == {10, 20, 30, 40, 50, 60}
    want = {"total": 1000, "zero": rows.where("x = 0").count(), "null": 0, "even": rows.where("x <> 0 and id % 2 = 0").count(), "passed": rows.where("x <> 0 and id % 2 = 1").count()}
    assert seen.get == want
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    kept = Chain(chain.gates, chain.before, chain.after, finish=lambda d: d.groupBy("gate", "reason").count()).run(rows)
    assert {(r["gate"], r["reason"]): r["count"] for r in kept.collect()} == {(None, None): want["passed"], ("zero", "is zero"): want["zero"], ("even", None): want["even"]}
    with pytest.raises(ValueError, match="same name"):
        Chain([Gate("a", F.lit(True)), Gate("a", F.lit(True))])


def events(spark, rows):
    return spark.createDataFrame([(k, s, None if m is None else START + timedelta(minutes=m)) for k, s, m in rows], "event_type string, span_id string, at timestamp")


def test_calls_without_an_end_come_out_of_a_stream(spark, tmp_path):
    schema, source = "event_type string, span_id string, at timestamp", str(tmp_path / "in")
    batches = [
        [("tool_started", "a", 0), ("tool_started", "b", 1), ("tool_started", "late", 2), ("other", "x", 2), (None, None, None)],
        [("tool_ended", "a", 20), ("tool_ended", "late", 80), ("tool_started", "c", 30)],
        [("tool_started", "z", 300)],
        [("tool_ended", "b", 10), ("tool_started", "zz", 301)],  # long past the watermark
    ]
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = calls.outcomes(spark.readStream.schema(schema).parquet(source), "1 hour", "10 minutes")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r["span_id"], r["finished"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", True), ("b", False), ("late", False), ("c", False)}
    # what a table says of the events in time
    whole = events(spark, [r for rows in batches[:3] for r in rows])
    table = {(r["span_id"], r["finished"]) for r in calls.outcomes(whole, "1 hour").collect()}
    assert table == got | {("z", False)}
    assert {r["span_id"] for r in audit.unfinished(whole.where("span_id <> 'late'")).collect()} == {s for s, f in table if not f} - {"late"}


def test_audit_batch_that_runs_twice_is_there_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01T10"), ("b", "2024-01-02T10"), ("c", None)], "span_id string, started_at string")
    log = str(tmp_path / "log")
    for _ in range(2):
        calls.write_batch(rows, log, 0)
    calls.write_batch(rows.where("span_id = 'a'"), log, 1)
    got = sorted((r["span_id"], r["dt"], r["batch"]) for r in files.audit_log(spark, log).select("span_id", F.col("dt").cast("string"), "batch").collect())
    assert got == [("a", "2024-01-01", 0), ("a", "2024-01-01", 1), ("b", "2024-01-02", 0), ("c", "unknown", 0)]


def test_audit_stream(spark, tmp_path):
    schema, source, log = "span_id string, started_at string", str(tmp_path / "in"), str(tmp_path / "log")
    for span in "ab":
        spark.createDataFrame([(span, "2024-01-01T10")], schema).coalesce(1).write.mode("append").parquet(source)
        calls.logged(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "cp"))
    assert sorted((r["span_id"], r["batch"]) for r in files.audit_log(spark, log).collect()) == [("a", 0), ("b", 1)]


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    schema, source = "ts timestamp, kind string, value long", str(tmp_path / "in")
    rows = [(START + timedelta(minutes=m), "k", m) for m in (0, 1, 7, 8, 400)]
    for some in (rows[:2], rows[2:]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
    stream = index_sync.windowed(spark.readStream.schema(schema).parquet(source), "ts", "kind")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = {tuple(r) for r in index_sync.windowed(spark.createDataFrame(rows, schema), "ts", "kind").collect()}
    closed = {t for t in table if t[0] < START + timedelta(hours=6)}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == closed and len(closed) == 2


def test_vaults_list_what_may_be_read(spark, tmp_path):
    for name in ("a.md", "b/C.PDF", "d.txt", ".git/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    assert sorted((r["path"].split(f"{tmp_path.name}/")[1], r["length"]) for r in files.vault(spark, str(tmp_path)).collect()) == [("a.md", 4), ("b/C.PDF", 7)]


def test_numbers_and_ids(spark):
    rows = spark.createDataFrame([(i * 7 % 1000, "ab"[i % 2]) for i in range(1000)], "x long, y string").repartition(7)
    assert [r["n"] for r in numbered(rows, F.desc("x"), name="n").orderBy(F.desc("x")).collect()] == list(range(1, 1001))
    assert numbered(rows.where("false"), "x").count() == 0
    docs = spark.createDataFrame([(2, "c a b"), (1, "b B a b"), (3, None), (4, "")], "doc_id long, text string")
    got = sparse.token_ids(docs, "doc_id")
    assert {r["token"]: r["id"] for r in got.collect()} == {"b": 1, "B": 2, "a": 3, "c": 4}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_registry_refuses_names_that_are_taken_or_no_functions():
    class A:
        QUERIES, SQL = {"x": len}, {}

    class B:
        QUERIES, SQL = {"y": 3}, {}

    class C:
        QUERIES, SQL = {"z": len}, {"w": "SELECT 1"}

    for modules, message in (((A, A), "same name"), ((B,), "called"), ((C,), "called")):
        with pytest.raises(ValueError, match=message):
            registry.registered(*modules)
    assert registry.registered(A) == ({"x": len}, {})
