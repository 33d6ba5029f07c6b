"""Benchmark decontamination: test n-grams in a broadcast hash set, document windows scanned against it and verified.

DataFrame functions only. Windows are hashed where the words are; the hash join keeps the few that are in the
set, and the words of these alone are compared with the benchmark's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contamination rule: words in a window, and one hit word in this many makes a document contaminated.
WINDOW = 13
ONE_IN = 20
#: A word is a run of digits, letters and whatever is not ASCII; this is what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The most bytes of windows that are broadcast at once, as Spark's rows and hash table hold them; a larger set is scanned for in blocks.
BROADCAST_BYTES = 128_000_000


def words(text: str | Column) -> Column:
    """The words of a text in order; none of a null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, h, win``: the distinct windows of each item; an item of fewer words, but not none, is one window."""
    items = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("win"))
    return wins.select("item_id", window_hash(F.transform("win", lambda w: F.xxhash64(w))).alias("h"), "win").distinct()


def window_hash(hashes: Column) -> Column:
    """Of a window, from the hashes of its words."""
    return F.xxhash64(hashes)


def hits(docs: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """``key..., start, length, win``: each place (from 1) of ``docs(key..., text)`` at which a window occurs."""
    distinct = windows.select("h", "win").distinct()
    lengths = sorted(r[0] for r in windows.select(F.size("win")).distinct().collect())  # WINDOW values at most
    if not lengths:
        return docs.select(*key, F.lit(1).alias("start"), F.lit(1).alias("length"), F.array(F.lit("")).alias("win")).limit(0)
    # a row with its place in the table, and for each word its offset and its bytes in words of eight
    held = F.aggregate("win", F.lit(100).cast("long"), lambda n, w: n + 16 + F.octet_length(w))
    blocks = max(1, math.ceil(distinct.agg(F.sum(held)).first()[0] / BROADCAST_BYTES))
    tokens = docs.select(*key, words("text").alias("w")).where(F.size("w") >= lengths[0])
    places = [F.when(F.size("w") >= n, F.size("w") - (n - 1)).otherwise(F.lit(0)) for n in lengths]

    def hashed(hw: Column, n: int, count: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), count), lambda i: window_hash(F.slice(hw, i, n)))
        return each if n == lengths[0] else F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))

    # bound by a lambda, the words' hashes are made once: each word is read once, however many windows it is in
    bound = F.transform(F.array(F.transform("w", lambda w: F.xxhash64(w))), lambda hw: F.concat(*(hashed(hw, n, c) for n, c in zip(lengths, places, strict=True))))
    tokens = tokens.withColumn("hs", F.element_at(bound, 1))
    at, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for n, count in zip(lengths, places, strict=True):  # where the place falls among the lengths that were put in a row
        inside = (F.col("at") >= before) & (F.col("at") < before + count)
        at, length, before = F.when(inside, F.col("at") - before + 1).otherwise(at), F.when(inside, F.lit(n)).otherwise(length), before + count
    found = None
    for block in range(blocks):
        some = distinct if blocks == 1 else distinct.where(F.pmod("h", F.lit(blocks)) == block)
        # outer: else the planner tests for empty arrays before the words are made, and makes them for every window
        scanned = tokens.select(*key, "w", F.posexplode_outer("hs").alias("at", "h"))
        same = scanned.join(F.broadcast(some), "h").select(*key, at.alias("start"), length.alias("length"), "win", "w")
        # between, not equal: an equality would become a join key, and every window's words be built to probe with
        same = same.where(F.slice("w", F.col("start"), F.col("length")).between(F.col("win"), F.col("win"))).drop("w")
        found = same if found is None else found.unionByName(same)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """``doc_id, tk, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs(doc_id, text)``.

    A word inside any occurrence of a benchmark window is hit. ``tk`` is a hash of the text: rows that
    repeat a doc_id are told apart by their texts, and equal rows get equal results. Null or empty
    texts have no words and are clean; null doc_ids are kept. An empty benchmark hits nothing. Other columns are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    windows = item_windows(benchmark, window)
    # equal rows are scanned once each, so a place is found once for each of them: sets count it once
    found = hits(keyed, windows, ["doc_id", "tk"])
    covered = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    spans = found.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set(window_hash(F.transform("win", lambda w: F.xxhash64(w)))).alias("hs"))
    spans = spans.select("doc_id", "tk", F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_hit"), "hs")
    of = windows.groupBy("h").agg(F.collect_set("item_id").alias("ids"))
    items = spans.select("doc_id", "tk", "n_hit", F.explode("hs").alias("h")).join(of, "h")
    items = items.select("doc_id", "tk", "n_hit", F.explode("ids").alias("item_id")).groupBy("doc_id", "tk", "n_hit")
    items = items.agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    per = items.select(F.col("doc_id").alias("d"), F.col("tk").alias("k"), "n_hit", F.size("ids").cast("long").alias("n_items"), F.array_join(F.array_sort("ids"), ",").alias("ids"))
    base = keyed.select("doc_id", "tk", F.size(words("text")).cast("long").alias("n_words"))
    rows = base.join(per, base["doc_id"].eqNullSafe(per["d"]) & (base["tk"] == per["k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "tk", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that the rule does not call contaminated."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("tk").alias("bad_tk")).distinct()
    on = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_tk"])
    return docs.join(bad, on, "left_anti")


def clean_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, tk, spans``: for documents with hits the merged runs ``(first, last)`` of hit words, for cutting them out."""
    found = hits(docs.select("doc_id", F.xxhash64("text").alias("tk"), "text"), item_windows(benchmark), ["doc_id", "tk"])
    runs = found.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("length") - 1).alias("last")))).alias("spans"))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def joined(done: Column, s: Column) -> Column:
        tail = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        longer = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], s["last"]).alias("last"))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return runs.select("doc_id", "tk", F.aggregate("spans", none, joined).alias("spans"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for ``contamination`` less ``tk``."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    word = f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}'), [])"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {word} AS w FROM {documents}),
bw AS (SELECT item_id, {word} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM bw WHERE len(w) > 0)),
occ AS (SELECT rid, i, n, w[i:i + n - 1] AS win FROM (
  SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT len(win) AS n FROM win))),
hit AS (SELECT DISTINCT rid, i, n, item_id FROM occ JOIN win USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
