"""Feeds, parsed papers and data sources on records written by hand."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusengine.functions import blocks
from corpusengine.operators import audit, compaction
from corpusengine.sources import files, papers, readers

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><div type="abstract"><p>short</p></div></teiHeader><text><body>
<div><head>One <b>x</b></head><p>see <ref>1</ref> more</p><div><head/><p/><table><row><cell>a</cell>b</row></table></div><figure><p><figDesc>deep</figDesc></p></figure></div>
<div><head>nothing</head><figure><figDesc/></figure></div><q:div xmlns:q="other"><p>not this</p></q:div></body></text></TEI>"""


def test_tei_of_all_divisions_and_bad_documents(spark):
    docs = spark.createDataFrame([(1, TEI), (2, "<TEI><unclosed>"), (3, None), (4, ""), (5, "<TEI><div><p>no name space</p></div></TEI>")], "k int, xml string")
    assert [tuple(r) for r in papers.tei_sections(docs, "k").orderBy("section").collect()] == [(1, 0, "abstract", "short"), (1, 1, "One ", "see "), (1, 2, "", "")]
    assert sorted(tuple(r) for r in papers.tei_parts(docs, "k").collect()) == [(1, "figure", 0, "deep"), (1, "figure", 1, ""), (1, "table", 0, "ab")]
    assert {r["k"]: r["error"] is not None for r in papers.tei_parsed(docs, "k").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_works(spark):
    full = {"id": "W1", "display_name": "N", "title": "not this", "doi": "https://doi.org/10.1/X", "publication_year": 2001, "cited_by_count": 7, "primary_location": {"pdf_url": "no", "source": {"display_name": "V", "issn": ["1", "2"], "type": "journal"}}, "best_oa_location": {"pdf_url": "http://p"}}
    rows = [(1, json.dumps(full)), (2, "{}"), (3, json.dumps({"primary_location": None, "best_oa_location": {"pdf_url": ""}})), (4, '{"id": '), (5, None), (6, json.dumps({"primary_location": {"source": {"issn": None}}, "best_oa_location": None}))]
    got = {r["seq"]: r.asDict() for r in papers.work_papers(spark.createDataFrame(rows, "seq int, json string")).collect()}
    empty = {"title": "", "doi": None, "openalex_id": "", "year": None, "venue": None, "issn": None, "venue_type": None, "pdf_url": None, "downloadable": False, "cited_by_count": 0}
    assert got == {1: {"seq": 1, "title": "N", "doi": "https://doi.org/10.1/X", "openalex_id": "W1", "year": 2001, "venue": "V", "issn": "1", "venue_type": "journal", "pdf_url": "http://p", "downloadable": True, "cited_by_count": 7}, 2: {"seq": 2, **empty}, 3: {"seq": 3, **empty, "pdf_url": ""}, 6: {"seq": 6, **empty}}


def test_entries(spark):
    rows = [(1, "<entry><id>http://arxiv.org/abs/2401.1v2</id><title> A\n  b </title><published>2024-01-02T</published><summary> s\tt </summary></entry>"), (2, "<entry><id>odd</id><title>t</title><published>199</published></entry>"), (3, "<entry><id>x</id>"), (4, None)]
    got = {r["seq"]: (r["title"], r["arxiv_id"], r["year"], r["abstract"], r["pdf_url"], r["downloadable"], r["venue"]) for r in papers.atom_papers(spark.createDataFrame(rows, "seq int, xml string")).collect()}
    assert got == {1: ("A b", "2401.1v2", 2024, "s t", "https://arxiv.org/pdf/2401.1v2", True, None), 2: ("t", "odd", None, "", "https://arxiv.org/pdf/odd", True, None)}


def vault(root, names):
    for i, (name, text) in enumerate(names.items()):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() if isinstance(text, str) else text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_vault_in_batches_with_filters(spark, tmp_path, monkeypatch):
    readers.register(spark)
    vault(tmp_path, {"a.md": "one", "in/b.MD": "two é", "in/c.md": b"\xff!", "in/d.txt": "no", ".git/e.md": "no", "z.md": ""})
    rows = spark.read.format("vault").option("path", str(tmp_path)).load()
    assert sorted((r["path"], r["length"], r["text"]) for r in rows.collect()) == [("a.md", 3, "one"), ("in/b.MD", 6, "two é"), ("in/c.md", 2, "�!"), ("z.md", 0, "")]
    some = rows.where("path LIKE 'in/%' AND mtime > timestamp '2023-11-14 22:13:21' AND length < 6")
    assert [r["path"] for r in some.collect()] == ["in/c.md"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan vault" in plan and "Filter (" not in plan  # the source takes all of them
    reader = readers.Reader(readers.VaultSource({"path": str(tmp_path)}))
    left = list(reader.pushFilters([readers.StringStartsWith(("path",), "in/"), readers.LessThan(("length",), 6), readers.StringStartsWith(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)]
    assert [[f.path for f in p.files] for p in reader.partitions()] == [["in/c.md"]]
    monkeypatch.setattr(readers, "PACK", 1)
    assert len(readers.Reader(readers.VaultSource({"path": str(tmp_path)})).partitions()) == 4
    with pytest.raises(Exception, match="path is missing"):
        spark.read.format("vault").load().count()
    assert spark.read.format("vault").option("path", str(tmp_path / "none")).load().count() == 0


def test_vault_stream_equals_the_batch(spark, tmp_path):
    readers.register(spark)
    root = tmp_path / "vault"
    vault(root, {f"{i}.md": f"text {i}" for i in range(5)})

    def run():
        stream = spark.readStream.format("vault").option("path", str(root)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination(120)

    batch = lambda: sorted(map(tuple, spark.read.format("vault").option("path", str(root)).load().collect()))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch()
    (root / "sub").mkdir()
    (root / "sub/new.md").write_text("new")
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch() and len(batch()) == 6


def test_feeds(spark, tmp_path):
    ns = 'xmlns="http://www.w3.org/2005/Atom"'
    vault(tmp_path / "atom", {"a.xml": f"<feed {ns}><entry><id>x/abs/1</id><title>T</title></entry><entry><id>2</id></entry></feed>", "b.xml": "<feed>", "c.xml": f"<feed {ns}/>"})
    vault(tmp_path / "works", {"a.json": json.dumps({"results": [{"id": "W1"}, {"id": "W2"}]}), "b.jsonl": '{"id": "W3"}\n\n{"id": "W4"}\n', "c.json": "{", "d.json": "[1"})
    readers.register(spark)
    rows = spark.read.format("feed").option("path", str(tmp_path / "atom")).load()
    assert sorted((r["path"], r["seq"]) for r in rows.where("error is null").collect()) == [("a.xml", 0), ("a.xml", 1)]
    assert [r["path"] for r in rows.where("error is not null").collect()] == ["b.xml"]
    assert sorted(r["arxiv_id"] for r in readers.read_papers(spark, "arxiv", str(tmp_path / "atom")).collect()) == ["1", "2"]
    assert sorted(r["openalex_id"] for r in readers.read_papers(spark, "openalex", str(tmp_path / "works")).collect()) == ["W1", "W2", "W3", "W4"]
    with pytest.raises(ValueError, match="none of"):
        readers.read_papers(spark, "other", "x")


def test_only_one_file_and_rendered_sections(spark):
    rows = spark.createDataFrame([("in/A  b.pdf",), ("in/c.pdf",), ("x/C.pdf",)], "path string")
    assert files.only(rows, " a B.PDF ") == "in/A  b.pdf"
    with pytest.raises(ValueError, match="only"):
        files.only(rows, "c.pdf")
    with pytest.raises(FileNotFoundError):
        files.only(rows, "d.pdf")
    parts = spark.createDataFrame([(1, 1, "B", "y"), (1, 0, "", "x")], "k int, section int, heading string, body string")
    assert files.rendered(parts, "k").first()["text"] == "## \nx\n\n## B\ny"


def test_spans_in_cycles_end_without_a_root(spark):
    spans = [("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "d"), ("f", "f"), ("g", "gone"), *((f"n{i}", f"n{i - 1}" if i else None) for i in range(70))]
    got = {r["span_id"]: (r["root_id"], r["depth"]) for r in audit.span_depths(spark.createDataFrame(spans, "span_id string, parent_id string")).collect()}
    assert {k: got[k] for k in "abcdefg"} == {"a": ("a", 0), "b": ("a", 1), "c": (None, None), "d": (None, None), "e": (None, None), "f": (None, None), "g": ("g", 0)}
    assert got["n69"] == ("n0", 69)


def test_long_conversations_compact_in_time(spark):
    calls = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))))
    rows = spark.range(16_000).select(F.lit(1).alias("conv"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("tool").alias("role"), F.lit("a b").alias("text"), calls.alias("tool_calls"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") - F.col("id") % 3).cast("string"))).alias("tool_call_id"))
    began = time.perf_counter()
    assert compaction.recent_tail(rows, "conv", "seq", 6 * 15_000).count() == 15_001  # the first result's call is brought along
    assert time.perf_counter() - began < 15


def test_patches_of_several_blocks_are_refused(spark):
    rows = spark.createDataFrame([("a", "*** Update Block: x\n-a\n+b"), ("a", "-a\n+b"), ("a", "*** Add Block: y"), ("a", None)], "v string, p string")
    assert [r[0] for r in rows.select(blocks.patched("v", "p")).collect()] == [None, "b", None, "a"]
