"""Operators on small tables with results worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusengine.functions import blocks
from corpusengine.operators import audit, chunk, compaction, dense, fuse, memory, pool, route, sparse, sync
from corpusengine.sources import files, papers
from corpusengine.streaming import index_sync, state


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rrf_orders_ties_by_first_appearance(spark):
    one = spark.createDataFrame([(0, k, i + 1) for i, k in enumerate("abc")], "q int, k string, rank int")
    two = spark.createDataFrame([(0, k, i + 1) for i, k in enumerate("bd")], "q int, k string, rank int")
    rows = fuse.best(fuse.fused([one, two], "k", ["q"]), ["q"], 10).orderBy("rank").collect()
    assert [r["k"] for r in rows] == ["b", "a", "d", "c"]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 60)


def test_intent_weights(spark):
    docs = spark.createDataFrame([(1, "a a b c d e f g h")], "doc_id int, text string")
    got = {r["token"]: r["weight"] for r in sparse.document_weights(docs, "doc_id").collect()}
    assert got["a"] == pytest.approx(2 / (1.5 * (1 - 0.5625) + 2))


def test_okapi_of_an_empty_corpus_and_without_hits(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert sparse.okapi_top(none, "a").count() == 0
    docs = spark.createDataFrame([(1, "b"), (2, None)], "doc_id int, text string")
    assert collected(sparse.okapi_top(docs, "a"), "doc_id", "score") == [(1, 0.0), (2, 0.0)]


def test_nearest_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "k int, embedding array<double>")
    got = dense.nearest(rows.where("k = 1").withColumnRenamed("k", "q"), rows, 2, "q", "k").orderBy("rank").collect()
    assert [(r["k"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]


def test_route_choice(spark):
    hits = spark.createDataFrame([(0, "r1", 0.9, 1), (0, "r2", 0.8, 2), (0, "r2", 0.8, 3), (0, "r1", 0.1, 4)], "q int, route string, score double, rank int")
    limits = spark.createDataFrame([("r1", 0.6), ("r2", None)], "route string, threshold double")
    assert collected(route.chosen(route.route_scores(hits, "q"), limits, "q", default=0.7), "q", "route") == [(0, "r2")]


def test_cascade(spark):
    turns = spark.createDataFrame([(1, "这篇 Figure 3 呢？", "ask", "10.1/x Figure 1"), (2, "那 Figure 3 呢？", "ask", "see 10.1000/x Figure 1"), (3, "x", None, None), (4, None, "ask", None)], "q int, text string, prev_intent string, prev_text string")
    picks = spark.createDataFrame([(1, "find", 1.5), (3, "general", 0.9)], "q int, route string, score double")
    rows = {r["q"]: (r["intent"], r["source"], r["confidence"], r["entities"]) for r in route.cascade(turns, picks, "q").collect()}
    assert rows == {1: ("find", "router", 1.0, {"figure": "3"}), 2: ("ask", "followup", 1.0, {"doi": "10.1000/x", "figure": "3"}), 3: ("general", "llm", 0.0, {}), 4: ("general", "llm", 0.0, {})}


def test_cursor_and_previous(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c"), (2, 1, "d")], "k int, seq int, text string")
    assert collected(memory.after_cursor(rows, "k", "seq", 1), "k", "seq") == [(1, 2), (1, 3)]
    got = {(r["k"], r["seq"]): r["before"] for r in memory.with_previous(rows, "k", "seq", {"text": "before"}).collect()}
    assert got == {(1, 1): None, (1, 2): "a", (1, 3): None, (2, 1): None}


def test_nearest_in_blocks_and_with_odd_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, float(i)], {0: 2.0} if i == 5 else None) for i in range(6)] + [(6, None, None), (7, [], None), (8, [1.0], None), (9, [None, 1.0], None)], "k int, v array<double>, plus map<int,double>")
    asked = rows.select(F.col("k").alias("q"), "v")
    near = lambda metric: collected(dense.nearest(asked, rows, 6, "q", "k", "v", metric).withColumn("score", F.round("score", 9)), "q", "k", "score")
    for metric in ("cosine", "l2"):
        whole = near(metric)
        monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
        assert near(metric) == whole and len(whole) == 37
        monkeypatch.undo()
    assert dense.nearest(asked, rows, 1, "q", "k", "v", plus="plus").where("q = 0").first()["k"] == 5


def test_patches(spark):
    cases = [("a\nb\nc", "-c\n+d", "a\nb\nd"), ("a\nb\nc", "@@ -3,1 +3,1 @@\n-c", "a\nb"), ("a\nb", " b", None), ("a", "-x", None), ("", "+x", "x"), ("a\nb", "\\ No newline\nodd", "a\nb"), ("a\na", " a\n-a\n+b", "a\nb"), (None, None, "")]
    rows = spark.createDataFrame(cases, "v string, p string, want string").select(blocks.patched("v", "p").alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    diff = spark.createDataFrame([("a\nb", "a\nc"), ("", "x"), (None, None)], "a string, b string").select(blocks.unified_diff("a", "b").alias("d")).collect()
    assert [r["d"] for r in diff] == ["--- old\n+++ new\n@@ -1,2 +1,2 @@\n a\n-b\n+c", "--- old\n+++ new\n@@ -0,0 +1 @@\n+x", ""]


def test_routes_and_examples(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text("routes:\n- name: a\n  utterances: [x, y]\n- name: b\n  utterances: [z]\n  score_threshold: 0.5\n")
    papers.save_thresholds(str(path), spark.createDataFrame([("a", 0.25), ("b", None), ("c", 1.0)], "name string, threshold double"))
    assert collected(papers.routes(spark, str(path)), "name", "utterance", "score_threshold") == [("a", "x", 0.25), ("a", "y", 0.25), ("b", "z", None)]
    path.write_text("eval:\n- {query: q, intent: a}\n- {query: r, intent: b, hard: true}\n")
    assert collected(papers.eval_set(spark, str(path), ["a", "b"]), "query", "intent", "hard") == [("q", "a", False), ("r", "b", True)]
    with pytest.raises(ValueError):
        papers.eval_set(spark, str(path), ["a"])


def test_sections_and_references(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\nx\n\n## References\ny"), (2, ""), (3, None)], "path int, text string")
    sections = chunk.markdown_sections(docs, "path")
    assert collected(sections, "path", "heading", "body") == [(1, "", "pre"), (1, "A", "x\n"), (1, "References", "y")]
    assert collected(chunk.chunked(sections), "chunk_index", "text") == [(0, "pre"), (1, "x")]


def test_hits_are_shown_in_order_and_cut(spark):
    hits = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (1, 9, 3)], "q int, id int, rank int")
    texts = spark.createDataFrame([(7, "notes", "é" * 300), (8, None, None)], "id int, source string, text string")
    got = dict(fuse.shown(hits, spark.createDataFrame([(1,), (2,)], "q int"), texts, "id", ["q"]).collect())
    assert got == {1: "\n".join([fuse.HITS, "- [:8] ", "- [notes:7] " + "é" * 200, "- [:9] "]), 2: fuse.NO_HITS}


def test_pool_first_wins(spark):
    rows = [(1, "d1", None, None, "t"), (2, "d1", "V", None, "t"), (3, None, None, "x", "t"), (4, None, None, None, "A-B"), (5, "", None, None, "a b")]
    papers = spark.createDataFrame(rows, "seq int, doi string, venue string, arxiv_id string, title string")
    assert collected(pool.deduplicated(papers), "dedup_key", "seq", "venue") == [("arxiv:x", 3, None), ("doi:d1", 1, "V"), ("title:ab", 4, None)]


def test_reviews(spark):
    note = spark.createDataFrame([(1, "pass", "blocking"), (2, "fail", None), (3, "pass", "minor")], "review_id int, verdict string, severity string")
    assert collected(pool.consistent_reviews(note), "review_id", "consistent") == [(1, False), (2, False), (3, True)]
    load = spark.createDataFrame([(1, "fail", None), (2, "pass", None), (3, "pass", "pass")], "review_id int, verdict string, decision string")
    assert collected(pool.consistent_reviews(load, "download"), "review_id", "consistent") == [(1, True), (2, False), (3, True)]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, mtime int")
    assert collected(sync.snapshot_diff(old, new), "path", "change") == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")]


def test_block_versions(spark):
    edits = spark.createDataFrame([("b", 1, "x", False), ("b", 2, "y", False), ("b", 3, "too long", False), ("b", 4, "z", False), ("r", 1, "x", True)], "block_id string, seq int, value string, read_only boolean")
    assert collected(memory.block_versions(edits, 5), "block_id", "version", "value") == [("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z")]


def test_passages_without_vectors_outrank_opposites(spark):
    rows = spark.createDataFrame([(1, [1.0], ["a", "b"], None, False), (2, None, ["a"], None, False), (3, [-1.0], ["a"], None, False), (4, [1.0], ["c"], None, False), (5, [1.0], ["a"], None, True)], "id int, embedding array<double>, tags array<string>, created_at string, is_deleted boolean")
    assert [r["id"] for r in memory.passages(rows, "id", ["a"], query=[1.0]).collect()] == [1, 2, 3]
    assert memory.passages(rows, "id", start="2024").count() == 0
    assert memory.passages(rows, "id", end="2024").count() == 4


CALLS = "conv int, seq int, role string, text string, tool_calls array<struct<id:string>>, tool_call_id string"


def test_compaction_pairs_and_orphans(spark):
    rows = [(1, 0, "assistant", "a", [("t1",), ("t2",)], None), (1, 1, "tool", "b", None, "t1"), (1, 2, "tool", "c", None, "t2"), (2, 0, "user", "a", None, None), (2, 1, "tool", "b", None, "t9")]
    got = compaction.recent_tail(spark.createDataFrame(rows, CALLS), "conv", "seq", 1000)
    assert collected(got, "conv", "seq") == [(1, 0), (1, 1), (1, 2), (2, 0)]
    tight = compaction.recent_tail(spark.createDataFrame(rows[:3], CALLS), "conv", "seq", 5)
    assert collected(tight, "conv", "seq") == [(1, 0), (1, 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "system"]), st.integers(1, 9), st.booleans()), min_size=1, max_size=8), st.integers(1, 60))
def test_compaction_keeps_a_tail_within_budget(spark, turns, budget):
    rows = [(1, i, role, " ".join("w" * n), [(f"t{i}",)] if role == "assistant" and call else None, f"t{i - 1}" if role == "tool" else None) for i, (role, n, call) in enumerate(turns)]
    got = compaction.recent_tail(spark.createDataFrame(rows, CALLS), "conv", "seq", budget).collect()
    ids = {c["id"] for r in got if r["tool_calls"] for c in r["tool_calls"]}
    assert all(r["tool_call_id"] in ids for r in got if r["role"] == "tool")
    assert not any(r["role"] == "system" for r in got)


def test_span_depths(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone")], "span_id string, parent_id string")
    assert collected(audit.span_depths(rows), "span_id", "root_id", "depth") == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("e", "e", 0)]


def test_breaker(spark):
    rows = spark.createDataFrame([("s", 1, 0.0, "failure"), ("s", 2, 10.0, "failure"), ("s", 3, 100.0, "call"), ("s", 4, 311.0, "call"), ("s", 5, 312.0, "failure")], "source string, seq long, at double, kind string")
    assert collected(state.breaker_replay(rows), "seq", "is_open", "failures") == [(1, False, 1), (2, False, 2), (3, True, 2), (4, False, 0), (5, False, 1)]


def test_breaker_stream_equals_replay(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, float(i * 40), k) for i, k in enumerate(["failure", "failure", "call", "success", "failure", "call"])], "source string, seq long, at double, kind string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = state.breaker_stream(stream).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert collected(spark.table("breaker"), "seq", "is_open", "failures") == collected(state.breaker_replay(rows), "seq", "is_open", "failures")


def test_task_decisions(spark):
    rows = spark.createDataFrame([("s", "f", 1, 0.0, 5.0, False), ("s", "f", 2, 2.0, 7.0, False), ("s", "f", 3, 200.0, 205.0, False), ("s", "f", 4, 306.0, 311.0, False), ("s", "p", 5, 0.0, 5.0, True), ("s", "p", 6, 10.0, 15.0, True)], "session string, fingerprint string, seq long, at double, done_at double, has_path boolean")
    assert collected(state.task_decisions(rows), "seq", "decision") == [(1, "run"), (2, "wait"), (3, "reuse"), (4, "run"), (5, "run"), (6, "run")]


def test_index_sync_replaces_by_path(spark, tmp_path):
    schema, source = "path string, mtime double, text string", str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    chunks = lambda df: df.select("path", F.explode(F.split("text", " ")).alias("chunk"))
    for rows in ([("a", 1.0, "x y"), ("b", 1.0, "z")], [("a", 2.0, "w")]):
        make(rows)
        index_sync.sync(spark.readStream.schema(schema).parquet(source), chunks, str(tmp_path / "index"), str(tmp_path / "cp"))
    now = index_sync.current(spark, str(tmp_path / "index"))
    assert collected(now, "path", "chunk") == [("a", "w"), ("b", "z")]
    assert collected(index_sync.reconciled(now, spark.createDataFrame([("b",)], "path string")), "path", "chunk") == [("b", "z")]


def test_globs_stay_below_the_root_and_are_cut(spark, tmp_path):
    for name in ("a.md", "b/c.md", "b/d/e.md", "b/f.txt", ".git/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda pattern, **k: [r["path"].split(f"{tmp_path.name}/")[-1] for r in files.globbed(spark, str(tmp_path), pattern, **k).collect()]
    assert names("**/*.md") == ["a.md", "b/c.md", "b/d/e.md"]
    assert names("*.md") == ["a.md"] and names("b/*") == ["b/c.md", "b/f.txt"]
    assert names("**/*.md", limit=2) == ["a.md", "b/c.md"] and names("../**/*.md") == []


def test_audit_lines_are_appended_by_day(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01T10"), ("b", "2024-01-02T10")], "span_id string, started_at string")
    for _ in range(2):
        files.append_audit(events, str(tmp_path / "log"))
    assert collected(files.audit_log(spark, str(tmp_path / "log")), "span_id", "started_at") == [("a", "2024-01-01T10")] * 2 + [("b", "2024-01-02T10")] * 2


def test_deletes_of_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, None), (1, True), (2, False), (None, None)], "k int, read_only boolean")
    gone = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    assert {(r["k"], r["read_only"]) for r in memory.deleted(rows, gone, "k").collect()} == {(1, True), (None, None)}
    assert collected(memory.deletions(rows, gone, "k"), "k", "outcome") == [(1, "read_only"), (2, "deleted"), (3, "missing")]


def test_fake_vectors_are_unit_vectors_of_their_texts(spark):
    encode = dense.fake_vector(8)
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "text string").select(encode(F.col("text")).alias("v")).collect()
    v = [r["v"] for r in rows]
    assert v[0] == v[1] != v[2] and v[3] == v[4]
    assert all(sum(x * x for x in row) == pytest.approx(1) for row in v)


def test_router_top_and_postings_of_repeated_keys(spark, monkeypatch):
    """Products are summed by document in tiles, not by a group of all pairs; rows that share a key count together."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(7, "w1 w2 w2"), (8, None), (None, "w3 w3"), (None, "w3 w4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w5") for q in range(8)], "query_id long, text string")
    weights, mean = sparse.router_weights(asked, docs, "query_id")
    want = sparse.ranked(sparse.sparse_dot(weights, sparse.document_weights(docs, "doc_id", mean=mean, wanted=weights), "query_id", "doc_id"), ["query_id"], "score", "doc_id", 5)
    monkeypatch.setattr(dense, "SCORES", 20)
    monkeypatch.setattr(sparse, "QUERY_TOKENS", 9)
    shown = lambda d: sorted((r["query_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in d.collect())
    assert shown(sparse.router_top(weights, docs, mean, 5, "query_id", "doc_id")) == shown(want)
    post = sparse.postings(docs, "doc_id")
    assert {(r["doc_id"], r["dl"], r["token"], r["tf"]) for r in post.where("doc_id is null").collect()} == {(None, 2, "w3", 3), (None, 2, "w4", 1)}
    alone = sparse.postings(docs.where("doc_id < 7"), "doc_id")
    assert "Aggregate" not in alone._jdf.queryExecution().optimizedPlan().toString() and alone.count() > 0
