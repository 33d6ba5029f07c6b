"""Importance resampling towards a target: hashed n-gram counts of both sides, gains of buckets, and the highest noisy weights.

Two passes over the texts as Arrow batches. The first counts the buckets of all features in one vector a partition, and a tree of sums
merges these. The second gathers the broadcast gain of each feature and sums them by document. Noise that follows from the id alone
makes the highest scores a draw without replacement, which any run repeats.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.operators.ordering import numbered

from .shared import cut
from .words import BATCH_BYTES, ROW_BYTES

#: Fixed values of the contract.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: A word in the bytes of a text whose A-Z are lower-cased: digits, letters and whatever is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: bytes | None) -> tuple[list[int], int]:
    """The CRC-32 of each word and of each two words in a row, joined by a blank, and the number of words."""
    words = WORD.findall((text or b"").lower())
    single = list(map(crc32, words))
    # a run's value goes on from that of the words before
    return single + list(map(crc32, map(b" ".__add__, words[1:]), single)), len(words)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches of about BATCH_BYTES of text, the buckets of their features, and the numbers of features and of words of each row."""
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()], np.int64)
        part = np.cumsum(sizes + ROW_BYTES) // BATCH_BYTES
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip([0, *ends], ends, strict=False):
            if a == b:
                continue
            found, n, words = [], [], []
            for t in text.slice(a, b - a):
                crcs, count = features(t.as_py())
                found.append(np.array(crcs, np.uint32) % np.uint32(BUCKETS))
                n.append(len(crcs))
                words.append(count)
            yield batch.slice(a, b - a), np.concatenate(found), np.array(n, np.int64), np.array(words, np.int64)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts of ``rows(text)`` fall into each bucket: a vector a partition, merged by a tree."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, buckets, _, _ in _texts(batches):
            total += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    # about a hundred vectors meet in a task of the tree, however many partitions there are
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions(), 100)))
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth)


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket floor(1000 ln) of the target's smoothed share over that of the raw texts."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str) -> int:
    """floor(1000 g) of a Gumbel value g that follows from the key."""
    h = int(hashlib.sha256(f"{SEED}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score`` for every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buckets, n, words in _texts(batches):
            # sums of integers, exact below 2**53
            sums = np.bincount(np.repeat(np.arange(len(n)), n), sent.value[buckets], len(n)).astype(np.int64)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            score = weight + np.array([noise(key or "") for key in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, words, weight, score))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    # ids as text, as they are hashed
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id string, n_features long, n_words long, weight long, score long")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs(doc_id, text)``, drawn towards ``target(text)``.

    Of the documents with ``least_words`` words or more, the share ``percent`` with the highest scores has ranks 1, 2, 3 ..., ties by the smaller doc_id,
    a null one last; all others have null. Null, empty and wordless texts have no features, weight 0 and the noise of their id; a null id has
    the noise of an empty one. Rows that repeat a doc_id are documents each, those equal in all columns ranked in any order. Without target texts
    gains follow from the smoothing alone; no documents give no rows. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    rows = cut(weighed(docs, gains))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    named = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(able.select(*named), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).select(*named, F.lit(None).cast("long").alias("rank")))


def taken(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, all columns kept; rows that share their doc_id with a drawn one come too."""
    ids = resampled(docs, target).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["drawn_id"]), "left_semi")


def oracle() -> str:
    """DuckDB SQL for ``resampled``: CRC-32 byte by byte over the distinct features."""
    word = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    half = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, {half}, k + 1 FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({word}, []) AS w FROM documents),
b AS (SELECT coalesce({word}, []) AS w FROM benchmark),
dall AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
ball AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
known AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]))) % {BUCKETS} AS k
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dall UNION SELECT f FROM ball)), steps),
s AS (SELECT k, count(*) AS n FROM dall JOIN known USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM ball JOIN known USING (f) GROUP BY k),
g AS (SELECT r.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(k) LEFT JOIN s ON s.k = r.k LEFT JOIN t ON t.k = r.k),
per AS (SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dall JOIN known USING (f) JOIN g USING (k) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN per USING (rid)),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)
"""
