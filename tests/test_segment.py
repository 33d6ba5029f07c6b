"""Words of texts without blanks, against all ways to cut them."""

import random

from pyspark.sql import functions as F

from corpusengine.functions import segment
from corpusengine.functions.text import tokens
from corpusengine.operators import sparse


def cuts(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in cuts(text[:-n]):
            yield [*rest, text[-n:]]


def test_path_is_the_cheapest_of_all_cuts():
    rng = random.Random(4)
    for _ in range(200):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        known = segment.Lexicon.of(words.items())
        text = "".join(rng.choices("abcd", k=rng.randint(0, 9)))
        allowed = [c for c in cuts(text) if all(len(w) == 1 or w in known.costs for w in c)]
        least = min(map(known.cost, allowed))
        best = max((c for c in allowed if known.cost(c) == least), key=lambda c: [len(w) for w in c[::-1]])
        assert known.path(text) == best


def test_tokens_of_mixed_texts(spark):
    words = spark.createDataFrame([("北京", 50), ("大学", 40), ("北京大学", 30), ("学生", 40), ("生活", 20), ("生", 5), ("東京", 9), ("", 3), ("都", None)], "word string, count long")
    cut = segment.segmenter(spark, segment.lexicon(words))
    docs = spark.createDataFrame([(1, "北京大学生活 Spark3 很好"), (2, "BERT在北京大学"), (3, "no such script"), (4, None), (5, ""), (6, "東京都x学生")], "doc_id long, text string")
    got = {r[0]: r[1] for r in docs.select("doc_id", tokens("text", segment=cut)).collect()}
    assert got == {1: ["北京大学", "生活", "spark3", "很", "好"], 2: ["bert", "在", "北京大学"], 3: ["no", "such", "script"], 4: [], 5: [], 6: ["東京", "都", "x", "学生"]}
    assert sparse.okapi_top(docs, "北京大学", 2, segment=cut).collect()[0]["doc_id"] in (1, 2)
    assert [r["doc_id"] for r in sparse.okapi_top(docs, "学生", 1, segment=cut).collect()] == [6]


def test_lexicon_is_bounded_and_read_from_files(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("北京 50 ns\n大学 40 n\n\nbroken\n学生 x\n北京 2\n", encoding="utf-8")
    words = segment.read_lexicon(spark, str(tmp_path))
    assert sorted(map(tuple, words.collect())) == [("北京", 2), ("北京", 50), ("大学", 40)]
    assert set(segment.lexicon(words, 1).costs) == {"北京"}
    assert segment.lexicon(words.where("false")).path("ab") == ["a", "b"]


def test_arrays_without_the_script_stay_in_the_jvm(spark):
    cut = segment.segmenter(spark, segment.Lexicon.of([("北京", 1)]))
    rows = spark.createDataFrame([(["a", None, "北京大"],), (None,), ([],)], "w array<string>").select(cut(F.col("w")).alias("w")).collect()
    assert [r[0] for r in rows][1:] == [None, []]
