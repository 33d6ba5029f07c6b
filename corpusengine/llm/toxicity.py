"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself, its first four and six bytes and its last four; filters of
three widths slide over the words of the whole text, each keeps its maximum, and a logistic layer reads the maxima. It is trained on
all labelled rows that aren't held out: they are dealt into shards by their ids, each round every shard goes on from the same model over all of its rows, and what
the shards learned is averaged by their rows. Languages are the groups that the texts fall into by how their words begin and end, found
without labels of language: each shard finds its own, and these are grouped by how many texts they stand for. Per group a threshold is found on a part of the rows
that was not trained on, by counts of all their scores, and scores are rescaled so that every group's threshold is the one that predictions are made at.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release
from .words import Words, batches, mix, tokenise

#: Rows of a shard, about (a round moves one vector of 2 MB for each); ids of labels that are broadcast (more are joined by a shuffle); models or centres that meet in one task.
SHARD, BROADCAST, MEET = 16_000, 1_000_000, 8
#: One in this many rows, by a hash of the text, only calibrates; a language with fewer of either label takes the threshold of all.
HELD, LEAST = 5, 20
#: Texts whose order is mixed while a shard learns; scores are counted by steps of a logit, up to the greatest.
POOL, STEPS, GREATEST = 256, 100, 60
SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.01, 1e-4, 8
THRESHOLD = 0.3
#: Groups of texts by language and slots of the beginnings and ends of words that tell them apart.
GROUPS, PROFILE = 8, 512


def features(w: Words) -> np.ndarray:
    """Four slots for each word."""
    spans = [(w.start, w.end), (w.start, np.minimum(w.start + 4, w.end)), (w.start, np.minimum(w.start + 6, w.end)), (np.maximum(w.end - 4, w.start), w.end)]
    salts = np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([(mix(w.run_hash(a, b) ^ s) >> np.uint64(64 - 15)).astype(np.int32) for (a, b), s in zip(spans, salts, strict=True)], 1)


def profiles(w: Words) -> np.ndarray:
    """Per text the square roots of the shares of hashed first and last three bytes of its words, of length one."""
    ends = [(w.start, np.minimum(w.start + 3, w.end)), (np.maximum(w.end - 3, w.start), w.end)]
    slots = [mix(w.run_hash(a, b) + np.uint64(k)) % np.uint64(PROFILE) for k, (a, b) in enumerate(ends)]
    texts, doc = len(w.first) - 1, w.doc
    counts = sum(np.bincount(doc * PROFILE + x.astype(np.int64), minlength=texts * PROFILE) for x in slots).reshape(texts, PROFILE)
    return np.sqrt(counts / np.maximum(2 * np.diff(w.first), 1)[:, None]).astype(np.float32)


def grouped(x: np.ndarray, groups: int = GROUPS, starts: int = 5, turns: int = 20, n: np.ndarray | None = None) -> np.ndarray:
    """Centres of length one by k-means over the profiles, each standing for ``n`` texts: of several starts that with the greatest likeness to them."""
    n = np.ones(len(x)) if n is None else n
    x, n = x[x.any(1)], n[x.any(1)]
    best, most = np.zeros((1, PROFILE), np.float32), -1.0
    for start in range(starts if len(x) else 0):
        rng = np.random.default_rng([SEED, start])
        centres = x[[rng.integers(len(x))]]
        while len(centres) < groups:  # the next is drawn by how unlike it is to those chosen
            gap = n * np.maximum(1 - (x @ centres.T).max(1), 1e-6).astype(np.float64) ** 2
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum())]])
        for _ in range(turns):
            own = (x @ centres.T).argmax(1)
            centres = np.stack([np.average(x[own == g], 0, n[own == g]) if (own == g).any() else centres[g] for g in range(groups)]).astype(np.float32)
            centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        if (like := float(((x @ centres.T).max(1) * n).sum())) > most:
            best, most = centres, like
    return best


@dataclass
class Model:
    """Embeddings, filters by width as (width * DIM, FILTERS), their biases, the logistic layer, centres of languages, and a logit threshold each."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    centres: np.ndarray = field(default_factory=lambda: np.zeros((1, PROFILE), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))

    def languages(self, w: Words) -> np.ndarray:
        """Per text the group it is most like."""
        return (profiles(w) @ self.centres.T).argmax(1)

    def pooled(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (texts, widths * FILTERS) of rectified filter outputs, and for training the words at which they are reached."""
        some = np.flatnonzero(np.diff(first))
        pools, places = [], []
        pad = max(WIDTHS) - 1
        # between texts stand words of zeros, so that a filter may run over an end but never into the next text
        at = np.arange(len(slots)) + np.repeat(np.arange(len(first) - 1), np.diff(first)) * pad
        x = np.zeros((len(slots) + pad * len(first), DIM), np.float32)
        x[at] = self.table[slots[:, 0]] + self.table[slots[:, 1]] + self.table[slots[:, 2]] + self.table[slots[:, 3]]
        for width, weight, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            y = x @ weight[:DIM]
            for j in range(1, width):
                y[:-j] += x[j:] @ weight[j * DIM : (j + 1) * DIM]
            y = y[at]
            pool = np.zeros((len(first) - 1, FILTERS), np.float32)
            if len(some):
                pool[some] = np.maximum(np.maximum.reduceat(y, first[some]) + bias, 0)
            pools.append(pool)
            places.append(y)
        return np.hstack(pools), places

    def logits(self, w: Words) -> np.ndarray:
        pools, _ = self.pooled(features(w), w.first)
        return pools @ self.out + self.bias

    def scores(self, w: Words) -> np.ndarray:
        """Between 0 and 1, and THRESHOLD at the threshold of the text's language."""
        shift = np.log(THRESHOLD / (1 - THRESHOLD)) - self.thresholds[self.languages(w)]
        return 1 / (1 + np.exp(-np.clip(self.logits(w) + shift, -60, 60)))


class Learner:
    """A model with what its training keeps: Adam's moments of the dense layers, the table's sums of squares, and the number of steps."""

    def __init__(self) -> None:
        rng, n = np.random.default_rng(SEED), len(WIDTHS) * FILTERS
        self.model = Model(
            rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32), [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, n**-0.5, n).astype(np.float32), 0.0,
        )
        self.dense = [*self.model.filters, *self.model.biases, self.model.out, np.zeros(1, np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.dense]
        self.squares = np.full((SLOTS, 1), 1e-8, np.float32)
        self.steps = 0

    def step(self, slots: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Adam on log loss for a batch of texts; returns the slots that it changes."""
        model, dense, moments, squares = self.model, self.dense, self.moments, self.squares
        self.steps += 1
        pools, outputs = model.pooled(slots, first)
        p = 1 / (1 + np.exp(-np.clip(pools @ model.out + model.bias, -30, 30)))
        d = ((p - toxic) / len(toxic)).astype(np.float32)
        grads = [np.zeros_like(g) for g in dense]
        grads[-2], grads[-1] = pools.T @ d, np.array([d.sum()], np.float32)
        back = np.outer(d, model.out) * (pools > 0)
        some = np.flatnonzero(np.diff(first))
        words, rows = [], []
        for k, width in enumerate(WIDTHS):
            y = outputs[k]
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[len(WIDTHS) + k] = own.sum(0)
            for t in some:
                live = np.flatnonzero(own[t])
                if not len(live):
                    continue
                peak = first[t] + y[first[t] : first[t + 1]][:, live].argmax(0)
                for j in range(width):
                    fits = peak + j < first[t + 1]
                    q, f = peak[fits] + j, live[fits]
                    x = model.table[slots[q]].sum(1)
                    block = slice(j * DIM, (j + 1) * DIM)
                    np.add.at(grads[k][block].T, f, x * own[t, f][:, None])
                    words.append(slots[q])
                    rows.append(model.filters[k][block][:, f].T * own[t, f][:, None])
        for i, (value, grad) in enumerate(zip(dense, grads, strict=True)):
            m, v = moments[i]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8) + DECAY * value)
        model.bias = float(dense[-1][0])
        if not words:
            return np.zeros(0, np.int64)
        slot, row = np.concatenate(words), np.concatenate(rows)
        touched, inverse = np.unique(slot, return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse.reshape(slot.shape), row[:, None, :].repeat(4, 1))
        squares[touched] += (total * total).mean(1, keepdims=True)
        model.table[touched] -= 0.05 * (total / np.sqrt(squares[touched]) + 0.001 * model.table[touched])
        return touched

    def learned(self, rows: Iterable[tuple[np.ndarray, float]], seed: list[int]) -> np.ndarray | None:
        """Goes once over ``rows``, pairs of a text's slots and its label, and returns what has changed, times the number of rows: one vector; none without rows.

        Slots that a shard doesn't change don't count in their averages, so that rare words learn as fast however many shards there are.
        """
        rng, n, old = np.random.default_rng([SEED, *seed]), 0, (self.model.table.copy(), self.squares.copy(), self.steps)
        changed = np.zeros(SLOTS, bool)
        pool: list[tuple[np.ndarray, float]] = []

        def flush() -> None:
            order = rng.permutation(len(pool))
            for begin in range(0, len(order), BATCH):
                some = [pool[i] for i in order[begin : begin + BATCH]]
                changed[self.step(np.concatenate([s for s, _ in some]), np.cumsum([0, *(len(s) for s, _ in some)]), np.array([y for _, y in some], np.float32))] = True
            pool.clear()

        for row in rows:
            n += 1
            pool.append(row)
            if len(pool) == POOL:
                flush()
        flush()
        if not n:
            return None
        parts = [self.model.table - old[0], self.squares - old[1], changed, *self.dense, *(x for pair in self.moments for x in pair), [self.steps - old[2]], [1]]
        return (np.concatenate([np.ravel(p) for p in parts]) * np.float64(n)).astype(np.float32)

    def take(self, sums: np.ndarray) -> None:
        """Goes on from the sum of what shards returned."""
        sums, at = sums.astype(np.float64), 0

        def cut_off(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return sums[at - like.size : at].reshape(like.shape)

        table, squares, changed = cut_off(self.model.table), cut_off(self.squares), cut_off(self.squares)
        self.model.table += (table / np.maximum(changed, 1)).astype(np.float32)
        self.squares += (squares / np.maximum(changed, 1)).astype(np.float32)
        for value in [*self.dense, *(x for pair in self.moments for x in pair)]:
            value[...] = cut_off(value) / sums[-1]
        self.steps += round(sums[-2] / sums[-1])
        self.model.bias = float(self.dense[-1][0])


def slotted(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, float]]:
    """The slots and the label of each row of ``frames(text, toxic)``."""
    for frame in batches(frames):
        w = tokenise(frame["text"])
        slots = features(w)
        for i, y in enumerate(frame["toxic"]):
            yield slots[w.first[i] : w.first[i + 1]].copy(), float(y)


def counted(model: Model, frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """``lang, step, toxic, n``: how many rows have which label and score, in steps of a logit."""
    parts = [pd.DataFrame({"lang": np.zeros(0, np.int64), "step": np.zeros(0, np.int64), "toxic": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})]
    for frame in batches(frames):
        w = tokenise(frame["text"])
        step = np.floor(np.clip(model.logits(w), -GREATEST, GREATEST) * STEPS).astype(np.int64)
        parts.append(pd.DataFrame({"lang": model.languages(w), "step": step, "toxic": frame["toxic"].to_numpy(np.int64), "n": 1}))
    return pd.concat(parts).groupby(["lang", "step", "toxic"], as_index=False)["n"].sum()


def calibrate(model: Model, counts: pd.DataFrame) -> None:
    """Per group the middle of the thresholds with most held rows on their right sides; small groups take that of all."""

    def best(own: pd.DataFrame) -> float:
        low = int(own["step"].min()) - STEPS
        size = int(own["step"].max()) + STEPS - low + 1
        clean, toxic = (np.bincount(o["step"] - low, o["n"], size) for o in (own[own["toxic"] == 0], own[own["toxic"] == 1]))
        # a threshold at the lower end of a step has the clean below it and the toxic from it on
        right = np.concatenate([[0], np.cumsum(clean)[:-1]]) + toxic.sum() - np.concatenate([[0], np.cumsum(toxic)[:-1]])
        most = np.flatnonzero(right == right.max())
        return (low + (most[0] + most[-1]) / 2) / STEPS

    n = [int(counts["n"][counts["toxic"] == y].sum()) for y in (0, 1)]
    if min(n):
        model.thresholds[:] = best(counts)
        for lang in range(len(model.thresholds)):
            own = counts[counts["lang"] == lang]
            if min(int(own["n"][own["toxic"] == y].sum()) for y in (0, 1)) >= LEAST:
                model.thresholds[lang] = best(own)


def constant(model: Model, clean: int, toxic: int) -> Model:
    """Makes all scores the share of toxic rows, where there are not both kinds to learn from."""
    model.bias = float(np.log((toxic + 0.5) / (clean + 0.5))) if clean + toxic else -2.0
    model.out[:] = 0
    return model


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """A model of texts in memory, which are one shard; each fifth only calibrates."""
    learner, held = Learner(), np.arange(len(texts)) % HELD == HELD - 1
    if not (~held).any() or len(set(toxic.tolist())) < 2:
        return constant(learner.model, int((toxic == 0).sum()), int((toxic > 0).sum()))
    rows = pd.DataFrame({"text": texts, "toxic": toxic})
    for epoch in range(EPOCHS):
        learner.learned(slotted([rows[~held]]), [epoch, 0])
    learner.model.centres = grouped(np.vstack([profiles(tokenise(part["text"])) for part in batches([rows])]))
    calibrate(learner.model, counted(learner.model, [rows[held]]))
    return learner.model


def _marks(labels: DataFrame) -> DataFrame:
    """``labelled_id, toxic``: ids whose crc32 is not 2 modulo 4; null labels and ids teach nothing."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return labels.where("doc_id is not null and toxic in (0, 1)").where(~held).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, calibrates``: all rows with a label that aren't held out, in about SHARD to a partition by a hash of their ids, in the order of another.

    Of rows that repeat an id the least text teaches. Equal texts all calibrate or all don't. There are as many partitions as
    the rows need, whatever number the session prefers, as each becomes a shard that sends a vector of the whole model.
    """
    marks = cut(_marks(labels))
    n = marks.count()
    rows = docs.select("doc_id", "text")
    found = rows.join(F.broadcast(marks) if n <= BROADCAST else marks, rows["doc_id"] == marks["labelled_id"]).drop("doc_id")
    shards = max(1, math.ceil(n / SHARD))
    found = found.withColumn("shard", F.pmod(F.xxhash64("labelled_id"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    found = found.groupBy("shard", "labelled_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    found = found.sortWithinPartitions(F.xxhash64(F.col("labelled_id").cast("string")), "labelled_id")
    return found.select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == HELD - 1).alias("calibrates"))


def _met(parts: DataFrame, merged, shards: int) -> list:  # noqa: ANN001
    """The vectors of all shards; of more than MEET those that ``merged`` makes of MEET each, and so on."""
    rows = parts
    while shards > MEET:
        shards = math.ceil(shards / MEET)
        # in the order of parts, so that sums don't depend on which task ends first
        rows = rows.groupBy((F.col("part") / MEET).cast("int").alias("part")).applyInPandas(
            lambda frame: pd.DataFrame({"part": [int(frame["part"].min())], "v": [merged(frame.sort_values("part")["v"].tolist())]}), "part int, v binary"
        )
    return [bytes(r["v"]) for r in sorted(rows.collect(), key=lambda r: r["part"])]


def _added(vectors: list[bytes]) -> bytes:
    total = np.zeros(len(vectors[0]) // 4)
    for v in vectors:
        total += np.frombuffer(v, np.float32)
    return total.astype(np.float32).tobytes()


def _regrouped(centres: list[bytes]) -> bytes:
    """Centres behind the number of texts that each stands for, grouped anew."""
    rows = np.concatenate([np.frombuffer(c, np.float32).reshape(-1, PROFILE + 1) for c in centres])
    n, x = rows[:, 0].astype(np.float64), rows[:, 1:]
    if len(centres) == 1 or not x.any():
        return rows.tobytes()
    at = grouped(x, n=n)
    return _weighed(x, n, at).tobytes()


def _weighed(x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.bincount((x @ at.T).argmax(1), n, len(at)) if len(x) else np.zeros(len(at))
    return np.hstack([sums[:, None], at]).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows: one pass over them for languages, one a round, and one for thresholds."""
    spark, rows, learner = docs.sparkSession, cut(labelled(docs, labels)), Learner()
    release(spark)  # the texts as they were dealt, beside the checkpoint
    shards, model = rows.rdd.getNumPartitions(), learner.model
    n = {(r["toxic"], r["calibrates"]): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}  # four rows
    of = [n.get((y, False), 0) + n.get((y, True), 0) for y in (0, 1)]
    if not min(of) or not n.get((0, False), 0) + n.get((1, False), 0):
        return constant(model, *of)
    learn, rest = (rows.where(F.col("calibrates") == held).select("text", "toxic") for held in (False, True))

    def languages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [profiles(tokenise(part["text"])) for part in batches(frames)]
        if found:
            x = np.vstack(found)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "v": [_weighed(x, np.ones(len(x)), grouped(x)).tobytes()]})

    centres = _met(rows.select("text").mapInPandas(languages, "part int, v binary"), _regrouped, shards)
    model.centres = np.frombuffer(_regrouped(centres), np.float32).reshape(-1, PROFILE + 1)[:, 1:].copy()
    for epoch in range(EPOCHS):
        sent = spark.sparkContext.broadcast(learner)  # about 2 MB, whatever the input

        def run(frames: Iterator[pd.DataFrame], sent=sent, epoch: int = epoch) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            part = TaskContext.get().partitionId()
            own = copy.deepcopy(sent.value)  # a worker's tasks share the value
            if (vector := own.learned(slotted(frames), [epoch, part])) is not None:
                yield pd.DataFrame({"part": [part], "v": [vector.tobytes()]})

        sums = _met(learn.mapInPandas(run, "part int, v binary"), _added, shards)
        learner.take(np.frombuffer(_added(sums), np.float32))
        sent.destroy()
        release(spark)  # the round's vectors
    sent = spark.sparkContext.broadcast(model)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield counted(sent.value, frames)

    # GROUPS * 2 * GREATEST * STEPS * 2 rows at most
    calibrate(model, rest.mapInPandas(count, "lang long, step long, toxic long, n long").groupBy("lang", "step", "toxic").agg(F.sum("n").alias("n")).toPandas())
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Whole texts are scored; null and empty ones get the score of a text without words. A null doc_id is not
    held out but teaches nothing. Without labels of both kinds the score is the same for all texts.
    Repeated rows are scored alike. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))  # about 1.6 MB, whatever the input

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.value.scores(tokenise(frame["text"])).astype(np.float64)})

    # ids as text: pandas would turn longs with nulls among them into floats
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    at = docs.columns.index("text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches([frame.set_axis([f"c{i}" for i in range(frame.shape[1])], axis=1)], f"c{at}"):
                yield part[model.value.scores(tokenise(part[f"c{at}"])) < THRESHOLD].set_axis(frame.columns, axis=1)

    return docs.mapInPandas(run, docs.schema)
