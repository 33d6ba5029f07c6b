"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from corpusengine.llm import decontam, mixing, queries, simhash
from tests.llm import brute


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out = stage(spark, docs, small)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name == "simhash":
            fps = simhash.near_duplicates(docs)
            assert {r[0] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in fps.collect() if r["doc_id"] == r["component_id"]}
        if name == "passages":
            assert brute.repeated_windows({r["doc_id"]: r["text"] for r in out.collect()}, 51) == {}
        if name == "decontamination":
            bad = decontam.contamination(docs, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated")
            assert out.count() == docs.count() - bad.count()
        if name == "mixing":
            assert out.columns == [*columns, "copy"]
            want = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).where("copies > 0").collect()}
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
        else:
            assert out.columns == columns
        kept[name] = out.count()
        docs = out
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    left = {r["doc_id"] for r in spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-toxicity").collect()}
    clean = [i for i, m in marks.items() if m == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert kept["toxicity"] >= kept["simhash"] >= kept["passages"] >= kept["decontamination"] > 0 < kept["mixing"]


def test_run(spark, small):
    assert queries.pipeline(spark, small).count() > 0
    assert list(dict(corpus_pipeline.STAGES)) == ["toxicity", "simhash", "passages", "decontamination", "mixing"]
