"""Ranked lexical search by Block-Max WAND over an index of segments.

A segment holds a few million words of documents, in the order of their ids. The postings of a term are cut into blocks of BLOCK, whose
gaps and frequencies are packed in as few bytes as their greatest value takes; beside them stand a block's first and last document and the
maximum impact in it. A search sorts a query's lists by the documents they stand at and finds the pivot, the first document at which the lists'
maxima reach the threshold, the score of the k-th best so far. Lists move to the pivot's blocks by these blocks' ends alone, and only if the blocks' maxima reach
the threshold are they decompressed and the document scored; otherwise all lists skip to where a block ends. All queries of a task take these steps
at once, as arrays of a row a query, and thresholds are carried on from segment to segment. Nothing that could be among the best is skipped.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resampling import WORD
from .shared import cut, discarded, stored
from .words import batches

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Results of a query; postings in a block; words in a segment (or one document, if it has more).
K, BLOCK, SEGMENT = 20, 128, 4_000_000
#: Terms of queries that are sent to all tasks at once, about 100 bytes each; more queries are searched for in blocks. A text of a query counts whole.
QUERY_TERMS = 200_000
#: Cells of a matrix of queries and their terms that take their steps together.
CELLS = 1 << 16

_SEGMENT = "ids binary, nulls int, norms binary, terms binary, df binary, first binary, last binary, top binary, widths binary, data binary"


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def _words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def packed(vocabulary: dict[bytes, int], tokens: list[np.ndarray], ids: list[int | None], n: int, total: int) -> pd.DataFrame:
    """A segment of documents given by the numbers of their words, for a corpus of ``n`` documents and ``total`` words."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sizes = np.array([len(t) for t in tokens], np.int64)
    norms = np.array([75 + 25 * int(sizes[i]) * n // total for i in order], np.int64)
    terms = sorted(vocabulary)
    rank = np.empty(len(terms), np.int64)
    rank[[vocabulary[t] for t in terms]] = np.arange(len(terms))
    key, tf = np.unique(rank[np.concatenate(tokens)] * len(ids) + np.repeat(place, sizes), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    df = np.bincount(term, minlength=len(terms))
    size = _sizes(df)
    start = np.cumsum(size) - size
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    wide = np.stack([_width(np.maximum.reduceat(x, start)) for x in (gap, tf)])
    offset = np.concatenate([[0], np.cumsum(size * wide.sum(0))])
    data = np.zeros(offset[-1], np.uint8)
    for values, width, begin in ((gap, wide[0], offset[:-1]), (tf, wide[1], offset[:-1] + size * wide[0])):
        for w in (1, 2, 4):
            of = np.flatnonzero(width == w)
            at, value = _ragged(np.zeros(len(of), np.int64), size[of]) * w + np.repeat(begin[of], size[of]), values[_ragged(start[of], size[of])]
            for byte in range(w):
                data[at + byte] = value >> 8 * byte & 255
    top = np.maximum.reduceat(impact(tf, norms[doc]), start)
    known = np.array([ids[i] for i in order if ids[i] is not None], np.int64)
    row = {"ids": known, "nulls": len(ids) - len(known), "norms": norms, "terms": b"\n".join(terms), "df": df.astype(np.int32), "first": doc[start].astype(np.int32), "last": doc[start + size - 1].astype(np.int32)}
    row |= {"top": top.astype(np.int32), "widths": (wide[0] * 16 + wide[1]).astype(np.uint8), "data": data}
    return pd.DataFrame({k: [v.tobytes() if isinstance(v, np.ndarray) else v] for k, v in row.items()})


def _sizes(df: np.ndarray) -> np.ndarray:
    """Postings in each block of lists of the lengths given."""
    blocks = -(-df // BLOCK)
    size = np.full(blocks.sum(), BLOCK, np.int64)
    size[np.cumsum(blocks) - 1] = df - (blocks - 1) * BLOCK
    return size


class Segment:
    """A segment opened for searching: blocks are decompressed when a search first needs them."""

    def __init__(self, row: pd.Series) -> None:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.norms = read("ids", np.int64), read("norms", np.int64)
        self.docs_in = len(self.norms)
        self.terms = {t: i for i, t in enumerate(bytes(row["terms"]).split(b"\n"))}
        self.df = read("df", np.int32).astype(np.int64)
        self.first, self.last, self.top = (read(c, np.int32).astype(np.int64) for c in ("first", "last", "top"))
        self.width = np.stack([read("widths", np.uint8) >> 4, read("widths", np.uint8) & 15]).astype(np.int64)
        self.data = read("data", np.uint8)
        blocks = -(-self.df // BLOCK)
        self.end = np.cumsum(blocks)
        self.begin = self.end - blocks
        self.size = _sizes(self.df)
        self.start = np.cumsum(self.size) - self.size
        used = self.size * self.width.sum(0)
        self.offset = np.cumsum(used) - used
        self.list_top = np.maximum.reduceat(self.top, self.begin)
        self.ends = np.repeat(np.arange(len(blocks)), blocks) * (self.docs_in + 1) + self.last
        self.open = np.zeros(len(self.size), bool)
        self.doc, self.impact = np.empty(self.df.sum(), np.int32), np.empty(self.df.sum(), np.int32)

    def seek(self, lists: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block of each list that ends at the target or later; ``end`` of the list if there is none."""
        return np.minimum(np.searchsorted(self.ends, lists * (self.docs_in + 1) + target), self.end[lists])

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = np.unique(blocks[~self.open[blocks]])
        if not len(blocks):
            return
        self.open[blocks] = True
        size, begin = self.size[blocks], self.offset[blocks]
        gap, tf = (self._values(size, begin + after, width) for after, width in ((0, self.width[0, blocks]), (size * self.width[0, blocks], self.width[1, blocks])))
        upto = np.cumsum(gap)
        doc = upto - np.repeat(upto[np.cumsum(size) - size] - self.first[blocks], size)
        at = _ragged(self.start[blocks], size)
        self.doc[at], self.impact[at] = doc, impact(tf, self.norms[doc])

    def _values(self, size: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
        wide = np.repeat(width, size)
        at = _ragged(np.zeros(len(size), np.int64), size) * wide + np.repeat(begin, size)
        out = self.data[at].astype(np.int64)
        for byte in range(1, int(width.max())):
            more = np.flatnonzero(wide > byte)
            out[more] |= self.data[at[more] + byte].astype(np.int64) << 8 * byte
        return out

    def find(self, blocks: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first posting at the target or later of decompressed blocks that end there or later."""
        low, high = self.start[blocks], self.start[blocks] + self.size[blocks] - 1
        for _ in range(BLOCK.bit_length()):
            middle = (low + high) >> 1
            less = self.doc[middle] < target
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            low = np.minimum(low, high)
        return low


class Best:
    """The k best documents of a query so far; ties go to the smaller id, a null one last."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A lower score can't be among the best; scores above 0 count."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        item = (score, doc is not None, -(doc or 0))
        heapq.heappush(self.heap, item) if len(self.heap) < self.k else heapq.heappushpop(self.heap, item)


def search(segment: Segment, lists: np.ndarray, weights: np.ndarray, best: list[Best]) -> None:
    """Offers the documents of a segment that may be among the best: ``lists`` and ``weights`` have a row a query, lists of -1 are none."""
    none = segment.docs_in
    row = np.flatnonzero((lists >= 0).any(1))
    lists, weights = lists[row], np.where(lists[row] >= 0, weights[row], 0)
    block = segment.begin[lists]
    at = np.where(lists >= 0, segment.first[block], none)  # the document a list stands at, or a bound below it
    most = weights * segment.list_top[lists]
    posting = np.full(at.shape, -1)  # known once a block is decompressed
    least = np.array([best[r].least for r in row], np.int64)
    while len(row):
        order = np.argsort(at, 1)
        reach = np.cumsum(np.take_along_axis(most, order, 1), 1) >= least[:, None]
        on = reach[:, -1]
        if not on.all():  # the rest can't reach their thresholds any more
            row, lists, weights, block, at, most, posting, least, order, reach = (x[on] for x in (row, lists, weights, block, at, most, posting, least, order, reach))
            if not len(row):
                return
        pivot = np.take_along_axis(at, np.take_along_axis(order, reach.argmax(1)[:, None], 1), 1)
        # shallow moves: to the blocks that may hold the pivot, by their ends
        behind = at <= pivot
        r, c = np.nonzero(behind & (segment.last[block] < pivot))
        if len(r):
            to, target = segment.seek(lists[r, c], pivot[r, 0]), pivot[r, 0]
            over = to >= segment.end[lists[r, c]]
            to = np.where(over, block[r, c], to)
            block[r, c], posting[r, c] = to, -1
            at[r, c] = np.where(over, none, np.maximum(target, segment.first[to]))
            most[r, c] = np.where(over, 0, most[r, c])
        behind &= at < pivot
        at, posting = np.where(behind, pivot, at), np.where(behind, -1, posting)
        here = at == pivot
        enough = (weights * segment.top[block] * here).sum(1) >= least
        if not enough.all():  # no document up to where a block ends or another list begins can reach the threshold
            skip = np.where(here, segment.last[block] + 1, np.where(at > pivot, at, none)).min(1, keepdims=True)
            moved = here & ~enough[:, None]
            at, posting = np.where(moved, skip, at), np.where(moved, -1, posting)
            most = np.where(at >= none, 0, most)
        if not enough.any():
            continue
        here &= enough[:, None]
        r, c = np.nonzero(here & (posting < 0))
        if len(r):
            segment.decompress(block[r, c])
            found = segment.find(block[r, c], pivot[r, 0])
            posting[r, c], at[r, c] = found, segment.doc[found]
        r, c = np.nonzero(here & (at == pivot))
        p = posting[r, c]
        score = np.zeros(len(row), np.int64)
        np.add.at(score, r, weights[r, c] * segment.impact[p])
        for i in np.flatnonzero(score >= least).tolist():
            doc = int(pivot[i, 0])
            best[row[i]].offer(int(score[i]), int(segment.ids[doc]) if doc < len(segment.ids) else None)
            least[i] = best[row[i]].least
        # lists that stood at the pivot go on to their next posting, or to their next block's first
        b = block[r, c]
        inside = p + 1 < segment.start[b] + segment.size[b]
        following = np.where(inside, b, b + 1)
        over = following >= segment.end[lists[r, c]]
        following = np.where(over, b, following)
        after = np.where(inside, segment.doc[np.where(inside, p + 1, p)], segment.first[following])
        block[r, c], posting[r, c] = following, np.where(inside, p + 1, -1)
        at[r, c] = np.where(over, none, after)
        most[r, c] = np.where(over, 0, most[r, c])


@dataclass
class Index:
    """Segments, and the numbers of documents that have terms and of all their terms."""

    segments: DataFrame
    n: int
    total: int

    def frequencies(self, terms: list[bytes]) -> dict[bytes, int]:
        """In how many documents each of the terms is; one scan of the segments' lists of terms."""
        sent = self.segments.sparkSession.sparkContext.broadcast(terms)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for names, df in zip(frame["terms"], frame["df"], strict=True):
                    place = {t: i for i, t in enumerate(bytes(names).split(b"\n"))}
                    found = [(i, place[t]) for i, t in enumerate(sent.value) if t in place]
                    of = np.array(found, np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"term": of[:, 0], "df": np.frombuffer(df, np.int32)[of[:, 1]]})

        rows = self.segments.select("terms", "df").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return {terms[r["term"]]: r["df"] for r in rows.collect()}  # QUERY_TERMS at most, but for one long text

    def best(self, asked: list[tuple[int, dict[bytes, int]]], k: int = K) -> DataFrame:
        """``query, doc_id, score``: the k best documents of each part of the index for queries ``(query, {term: repeats})``."""
        frequency = self.frequencies(sorted({t for _, terms in asked for t in terms}))
        weight = {t: math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1))) for t, df in frequency.items()}
        queries = [(q, {t: c * weight[t] for t, c in terms.items() if weight.get(t)}) for q, terms in asked]
        sent = self.segments.sparkSession.sparkContext.broadcast(sorted((x for x in queries if x[1]), key=lambda x: len(x[1])))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            queries = sent.value
            best, groups = [Best(k) for _ in queries], list(together([len(t) for _, t in queries]))
            for frame in frames:
                for _, row in frame.iterrows():
                    segment = Segment(row)
                    for a, b in groups:
                        shape = (b - a, len(queries[b - 1][1]))
                        lists, weights = np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
                        for i, (_, terms) in enumerate(queries[a:b]):
                            lists[i, : len(terms)] = [segment.terms.get(t, -1) for t in terms]
                            weights[i, : len(terms)] = list(terms.values())
                        search(segment, lists, weights, best[a:b])
            found = [(q, None if not known else str(-doc), score) for (q, _), b in zip(queries, best, strict=True) for score, known, doc in b.heap]
            yield pd.DataFrame(found, columns=["query", "doc_id", "score"])

        found = self.segments.mapInPandas(run, "query long, doc_id string, score long")
        return found.select("query", F.col("doc_id").cast("long").alias("doc_id"), "score")


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of queries, in ascending order of their terms, whose matrix has CELLS cells at most; one query at least."""
    a = 0
    for b in range(1, len(sizes) + 1):
        if b == len(sizes) or (b + 1 - a) * sizes[b] > CELLS:
            yield a, b
            a = b


def indexed(docs: DataFrame, segment: int = SEGMENT) -> Index:
    """An index of all rows of ``docs(doc_id, text)``, stored in the shared folder; rows without terms aren't in it."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            sizes = [len(_words(text)) for text in frame["text"]]
            yield pd.DataFrame({"n": [sum(x > 0 for x in sizes)], "total": [sum(sizes)]})

    row = docs.select("text").mapInPandas(counted, "n long, total long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total"))).first()
    n, total = row["n"], row["total"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, tokens, ids, held = defaultdict(count().__next__), [], [], 0
        for frame in batches(frames):
            for key, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = _words(text)
                if not words:
                    continue
                if held and held + len(words) > segment:
                    yield packed(vocabulary, tokens, ids, n, total)
                    vocabulary, tokens, ids, held = defaultdict(count().__next__), [], [], 0
                tokens.append(np.array(list(map(vocabulary.__getitem__, words)), np.int32))
                ids.append(None if key is None else int(key))
                held += len(words)
        if held:
            yield packed(vocabulary, tokens, ids, n, total)

    # ids as text: pandas would turn longs with nulls among them into floats
    return Index(stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, _SEGMENT), "segments"), n, total)


def ranked(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring rows of ``docs(doc_id, text)`` for every row of ``queries(item_id, text)``.

    Terms are maximal runs of ASCII letters and digits and of whatever isn't ASCII, with A-Z lower-cased; a query's repeated term counts each time. Scores are whole
    numbers above 0; equal ones go by ascending doc_id, a null one last. Rows that repeat a doc_id are documents each. Rows that repeat an item_id
    are ranked each; null and empty texts, and queries whose terms no document has, give no rows, nor does an empty table. Other columns are ignored.
    """
    spark = queries.sparkSession
    index = indexed(docs)
    rows = queries.select("item_id", F.xxhash64("text").alias("h"), F.md5(F.col("text").cast("binary")).alias("md5"), F.col("text").alias("query_text")).where("query_text is not null")
    # equal texts are one query
    texts = cut(rows.groupBy("h", "md5").agg(F.first("query_text").alias("query_text")).withColumn("query", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil((texts.agg(F.sum(F.regexp_count(F.col("query_text"), F.lit(TERMS)))).first()[0] or 0) / QUERY_TERMS))
    found = None
    for block in range(blocks):
        some = texts.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "query_text")
        part = index.best([(r["query"], dict(Counter(_words(r["query_text"])))) for r in some.collect()], k)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = cut(found.withColumn("rank", place).where(F.col("rank") <= k))
    discarded(index.segments)
    named = rows.select("item_id", "h", "md5").join(texts.select("h", "md5", "query"), ["h", "md5"])
    return named.join(best, "query").select("item_id", "rank", "doc_id", "score")


def oracle(k: int = K) -> str:
    """DuckDB SQL for ``ranked`` over ``documents`` and ``benchmark``: all scores of documents that share a term."""
    word = f"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}'), [])"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {word} AS w FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, {word} AS w FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
asked AS (SELECT qid, t, count(*) AS c FROM (SELECT qid, unnest(w) AS t FROM q) GROUP BY qid, t),
post AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY rid, t),
weights AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, c GROUP BY t, n),
norms AS (SELECT rid, doc_id, 75 + (25 * len(w)::BIGINT * n) // total AS m FROM d, c WHERE len(w) > 0),
scores AS (SELECT qid, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN post USING (t) JOIN norms USING (rid) GROUP BY qid, rid, doc_id),
placed AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed JOIN q USING (qid) WHERE rank <= {k}
"""
