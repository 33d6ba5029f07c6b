"""A hierarchical Pitman-Yor bigram model: Chinese-restaurant seating sampled by Gibbs, predictive probabilities averaged.

Every word is a context with a restaurant of its own; all of these share one parent, the restaurant of single words, whose base is
uniform over the known words and one unknown. A customer is an occurrence of a word after its context; each table of a
context's restaurant is a customer of the parent.

A restaurant with T tables lays weight (strength + discount * T) times the parent's probability on a new table, its own tables counted as
they open. As this weight is a moment of a gamma variable, a sweep draws x from a gamma distribution of shape strength / discount + T for each
restaurant, and given x its dishes are independent: a dish with c customers has t tables with weight S(c, t) * (discount * x * parent)**t, S
the generalised Stirling number. At a discount of one half S has a closed form, so that t is drawn from its exact distribution whatever
c is. The parent's probabilities are those of the sweep before. All random numbers follow from the word, the context and the sweep,
so scores do not depend on how the work is dealt out.

Texts become blocks of word numbers, counted and numbered by buckets of words. Pairs (context, word) are dealt to buckets by context, and
frequent contexts to several, by word. A sweep sends the tables of words and of contexts to the word's buckets, which add
them up, seat the parent's customers and publish the answers for the next sweep. The last sweeps are samples: the probability of a pair is their mean.
All that moves is packed arrays, a row for each block and bucket, never more than a row for each pair; answers are published in files
of many blocks or buckets, which are read by their places.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discarded, new_folder, release, stored
from .store import filesystem
from .words import batches, mix, tokenise

#: The discount of all restaurants, at which tables have a closed form; the strengths of contexts and of the parent.
DISCOUNT, STRENGTH, PARENT_STRENGTH = 0.5, 2.0, 10.0
#: Sweeps that only warm up, and sweeps whose probabilities are averaged.
BURN, SAMPLES, SEED = 3, 3, 1
#: Bytes of text in a block; tokens that a bucket of pairs is meant to have: a context with over half as many is dealt to several.
BLOCK_BYTES, BUCKET_TOKENS = 5_000_000, 1_000_000
#: Logarithms of pairs travel as multiples of 2 ** -36 (7e-12 at most from the double), which have five bytes and add up the same in any order.
FIXED = float(1 << 36)
#: Blocks or buckets whose answers share a file.
SHARED = 64
_END = mix(np.array([0x656E64], np.uint64))[0]
_DOCS = np.dtype([("id", "<i8"), ("null", "?"), ("held", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, its bytes by significance."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())


def unpack(data: bytes, kind: str | np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


# ---- seating


def uniforms(key: np.ndarray, turn: int, draw: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from the key, the sweep and the number of the draw."""
    salt = mix(np.array([(SEED << 48) + (turn << 24) + draw], np.uint64))[0]
    return ((mix(key ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """Gamma variables of shapes of 1 or more, by Marsaglia and Tsang's rejection."""
    d = shape - 1 / 3
    c, out, todo, draw = 1 / np.sqrt(9 * d), np.zeros(len(shape)), np.arange(len(shape)), 1
    while len(todo):
        a, b, u = (uniforms(key[todo], turn, draw + i) for i in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + c[todo] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u) < x * x / 2 + d[todo] * (1 - v + np.log(v)))
        out[todo[ok]] = (d[todo] * v)[ok]
        todo, draw = todo[~ok], draw + 3
    return out


def tables(c: np.ndarray, a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each dish with c customers a number t of tables, of weight S(c, t) * a**t at a discount of one half, by one uniform number u.

    S(c, t) = (2c - t - 1)! / ((c - t)! (t - 1)! 4**(c - t)), so weights follow from each other by a ratio that falls as t
    rises. They are summed from the greatest outwards as far as they change a double.
    """
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    n, a, u = c[many].astype(np.float64), a[many], u[many]
    b = 2 * n - 1 + 4 * a
    mode = np.clip(np.ceil(8 * a * n / (b + np.sqrt(np.maximum(b * b - 16 * a * n, 0)))), 1, n)
    spread = 1 / np.sqrt(1 / mode + 1 / np.maximum(n - mode, 0.5) - 1 / (2 * n - mode))
    reach = np.ceil(10 * spread) + 15
    low, high = np.maximum(1, mode - reach), np.minimum(n, mode + reach)
    size = (high - low).astype(np.int64) + 1
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(many)), size)
    at = np.arange(len(own)) - first[own] + low[own] - 1  # the ratio of the weight of at + 1 to that of at
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log(4 * a[own] * (n[own] - at) / (at * (2 * n[own] - at - 1)))
    step[first] = 0
    logs = np.cumsum(step)
    weight = np.exp(logs - logs[first + (mode - low).astype(np.int64)][own])
    upto = np.cumsum(weight)
    before = (upto - weight)[first]
    last = first + size - 1
    got = np.clip(np.searchsorted(upto, before + u * (upto[last] - before)), first, last)
    t[many] = (low + got - first).astype(t.dtype)
    return t


class Restaurants:
    """A bucket's cells (context, word) that are trained on or asked for, in order, with c customers each.

    ``contexts`` has ``sizes`` cells each; ``word`` is the place of a cell's word in ``words``, which are in the order of the buckets they come from.
    """

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, word: np.ndarray, c: np.ndarray) -> None:
        self.contexts, self.sizes, self.words, self.word, self.c = contexts, sizes, words, word, c
        self.context = np.repeat(np.arange(len(contexts)), sizes)
        self.many = np.flatnonzero(c > 1)
        self.key = mix(contexts[self.context[self.many]] * _ODD + words[word[self.many]])

    @classmethod
    def made(cls, u: np.ndarray, w: np.ndarray, c: np.ndarray, parents: int = 1) -> Restaurants:
        """From cells in the order of context and word."""
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])[: len(u)])
        words, word = np.unique(w, return_inverse=True)
        order = np.argsort(words % np.uint64(parents), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return cls(u[first], np.diff(first, append=len(u)), words[order], place[word], c)

    @classmethod
    def of(cls, row) -> Restaurants:  # noqa: ANN001
        return cls(np.cumsum(unpack(row.contexts, "<u8")), unpack(row.sizes, "<u4"), unpack(row.words, "<u8"), unpack(row.word, "<u4"), unpack(row.c, "<u8").astype(np.int64))

    def row(self) -> dict[str, bytes]:
        return {"contexts": pack(np.diff(self.contexts, prepend=np.uint64(0))), "sizes": pack(self.sizes.astype(np.uint32)), "words": pack(self.words), "word": pack(self.word.astype(np.uint32)), "c": pack(self.c.astype(np.uint64))}

    def seated(self, turn: int, before: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Tables of each cell after a sweep, given all tables of each context before it and the parent's probability of each word."""
        x = gammas(STRENGTH / DISCOUNT + before, mix(self.contexts), turn)
        t = np.minimum(self.c, 1)
        t[self.many] = tables(self.c[self.many], DISCOUNT * x[self.context[self.many]] * parent[self.word[self.many]], uniforms(self.key, turn, 0))
        return t

    def probabilities(self, t: np.ndarray, all_tables: np.ndarray, customers: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Of each cell's word after its context."""
        over = (STRENGTH + DISCOUNT * all_tables)[self.context] * parent[self.word]
        return (self.c - DISCOUNT * t + over) / (STRENGTH + customers)[self.context]


# ---- answers


def _published(folder: str):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Write the answers for one block or bucket after the other, and where each begins; a task that runs again replaces its files by the same."""
        rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        for file, of_file in groupby(rows, itemgetter(0)):
            fs, path = filesystem(f"{folder}/{file}")
            places, end = {}, 0
            with fs.open_output_stream(attempt := f"{path}.{uuid.uuid4().hex}", compression=None) as out:
                for key, parts in groupby(of_file, itemgetter(1)):
                    out.write(data := pickle.dumps([part[2:] for part in parts]))
                    places[key], end = (end, len(data)), end + len(data)
                out.write(directory := pickle.dumps(places))
                out.write(len(directory).to_bytes(8, "little"))
            fs.move(attempt, path)
            yield pd.DataFrame({"file": [file]})

    return run


def files_for(keys: int, tasks: int) -> int:
    """Files for the answers of so many blocks or buckets: one for each task as long as these are few, then one for ``SHARED`` of them."""
    return max(1, math.ceil(keys / SHARED), min(keys, tasks))


def file_of(block: str, files: int) -> int:
    """The file with a block's answers."""
    return int(block[:8], 16) % files


def published(answers: DataFrame, key: str, file: Column, files: int, folder: str) -> None:
    """Write answers below a folder by the files given, a key's together."""
    rows = answers.select(file.cast("int").alias("file"), key, *(c for c in answers.columns if c != key))
    rows = rows.repartitionById(files, "file").sortWithinPartitions("file", key)
    rows.mapInPandas(_published(folder), "file int").write.format("noop").mode("overwrite").save()


def answers_for(folder: str, file: int, key: str | int) -> list[tuple]:
    """What a file holds for one block or bucket, read by its place."""
    fs, path = filesystem(f"{folder}/{file}")
    with fs.open_input_file(path) as f:
        end = f.size() - 8
        length = int.from_bytes(f.read_at(8, end), "little")
        begin, size = pickle.loads(f.read_at(length, end - length))[key]
        return pickle.loads(f.read_at(size, begin))


# ---- blocks and their words


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block: its distinct word hashes, the places of its words among them by document, and its documents."""

    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        vocab, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        docs = np.concatenate([d for _, d in held])
        return pd.DataFrame({"block": [uuid.uuid4().hex], "n": [int(docs["tokens"].sum())], "vocab": [vocab.tobytes()], "places": [pack(at.astype(np.uint32))], "docs": [pack(docs)]})

    held, size = [], 0
    for frame in batches(frames):
        w = tokenise(frame["text"])
        docs = np.zeros(len(frame), _DOCS)
        ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        docs["id"], docs["null"] = [x or 0 for x in ids], [x is None for x in ids]
        docs["held"], docs["tokens"] = [held_out(x) for x in ids], np.diff(w.first) + 1
        held.append((np.insert(w.hash, w.first[1:], _END), docs))  # an end after the words of each document
        size += len(w.buf)
        if size >= BLOCK_BYTES:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def _asked(buckets: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                vocab, docs = np.frombuffer(row.vocab, np.uint64), unpack(row.docs, _DOCS)
                learn = np.repeat(~docs["held"], docs["tokens"])
                counts = np.bincount(unpack(row.places, "<u4")[learn], minlength=len(vocab))
                bucket = (vocab >> np.uint64(32)).astype(np.int64) % buckets
                parts = [(b, np.flatnonzero(bucket == b)) for b in np.unique(bucket).tolist()]
                yield pd.DataFrame([(b, row.block, vocab[p].tobytes(), pack(counts[p].astype(np.uint64))) for b, p in parts], columns=["bucket", "block", "hashes", "counts"])

    return run


def _numbered(buckets: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Numbers and counts of a bucket's words for each block that asked; frequent words get small numbers."""
        bucket = int(pdf["bucket"].iat[0])
        sent = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        words, at = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.zeros(len(words), np.uint64)
        np.add.at(counts, at, np.concatenate([unpack(x, "<u8") for x in pdf["counts"]]))
        rank = np.empty(len(words), np.uint64)
        rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=np.uint64)
        numbers = rank * np.uint64(buckets) + np.uint64(bucket)
        rows, begin = [], 0
        for block, part in zip(pdf["block"], sent, strict=True):
            own = at[begin : begin + len(part)]
            begin += len(part)
            rows.append((bucket, block, pack(numbers[own]), pack(counts[own]), 0, 0))
        rows.append((bucket, None, b"", b"", int((counts > 0).sum()), int(counts.sum())))
        return pd.DataFrame(rows, columns=["bucket", "block", "numbers", "counts", "v", "n"])

    return run


_PAIRS = ["of_docs", "bucket", "block", "u", "w", "c", "at", "docs"]


def _paired(parents: int, buckets: int, per_bucket: int, known_words: int, known_tokens: int, folder: str, files: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's distinct pairs by bucket, and its documents with what single words say and the pair that each of their tokens is."""
        for frame in frames:
            for row in frame.itertuples(index=False):
                vocab, docs = np.frombuffer(row.vocab, np.uint64), unpack(row.docs, _DOCS).copy()
                numbers, counts = np.zeros(len(vocab), np.uint64), np.zeros(len(vocab), np.uint64)
                bucket = (vocab >> np.uint64(32)).astype(np.int64) % parents
                for b, got, count in answers_for(folder, file_of(row.block, files), row.block):
                    own = np.flatnonzero(bucket == b)
                    numbers[own], counts[own] = unpack(got, "<u8"), unpack(count, "<u8")
                places = unpack(row.places, "<u4")
                first = np.concatenate([[0], np.cumsum(docs["tokens"])])[:-1]
                c = counts[places].astype(np.float64)
                docs["known"] = np.add.reduceat((c > 0).astype(np.int64), first)
                docs["base"] = np.add.reduceat(np.log10((c + 0.5) / (known_tokens + 0.5 * (known_words + 1))), first)
                before = np.empty_like(places)
                before[1:] = places[:-1]
                before[first] = np.searchsorted(vocab, _END)  # a text begins after an end
                pairs, at = np.unique(before.astype(np.uint64) << np.uint64(32) | places, return_inverse=True)
                u, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
                learned = np.bincount(at[np.repeat(~docs["held"], docs["tokens"])], minlength=len(pairs))
                # a frequent context is dealt to several buckets, by its words
                shard = mix(numbers[w]) % (np.uint64(1) + counts[u] // np.uint64(max(1, per_bucket // 2)))
                u, w = numbers[u], numbers[w]
                place = (mix(u * _ODD + shard) >> np.uint64(32)).astype(np.int64) % buckets
                order = np.lexsort((w, u, place))
                u, w, place, learned = u[order], w[order], place[order], learned[order]
                turned = np.empty(len(order), np.uint32)
                turned[order] = np.arange(len(order), dtype=np.uint32)
                rows, cuts = [], np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows.append((False, int(place[a]), row.block, pack(np.diff(u[a:b], prepend=np.uint64(0))), pack(w[a:b]), pack(learned[a:b].astype(np.uint32)), None, None))
                yield pd.DataFrame([*rows, (True, -1, row.block, None, None, None, pack(turned[at]), pack(docs))], columns=_PAIRS)

    return run


def _opened(parents: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's pairs of all blocks as one row: its restaurants, and of each block the cells it has."""
        sent = [(row.block, np.cumsum(unpack(row.u, "<u8")), unpack(row.w, "<u8"), unpack(row.c, "<u4")) for row in pdf.itertuples()]
        u, w, c = (np.concatenate([x[i] for x in sent]) for i in (1, 2, 3))
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        cell = np.empty(len(u), np.int64)
        cell[order] = np.cumsum(new) - 1
        r, blocks, begin = Restaurants.made(u[new], w[new], np.bincount(cell, c), parents), [], 0
        for block, uu, _, _ in sent:
            own = cell[begin : begin + len(uu)]
            begin += len(uu)
            blocks.append((block, pack(np.diff(own, prepend=0).astype(np.uint32))))
        return pd.DataFrame([{"bucket": int(pdf["bucket"].iat[0]), **r.row(), "blocks": pickle.dumps(blocks)}])

    return run


# ---- sweeps


class Sweeps:
    """What the word's buckets published after each sweep: the parent's shares of words, and all tables and customers of contexts."""

    def __init__(self, home: str, parents: int, words: int, files: int) -> None:
        self.home, self.parents, self.known_words, self.files, self.scalars = home, parents, words, files, []

    def folder(self, turn: int) -> str:
        return f"{self.home}/sweep-{turn}"

    def read(self, turn: int, bucket: int, r: Restaurants) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent's probability of the bucket's words; tables and customers of its contexts."""
        all_tables, all_customers = self.scalars[turn]
        share, seats, customers = np.zeros(len(r.words)), np.zeros(len(r.contexts)), np.zeros(len(r.contexts))
        answers = {b: rest for b, *rest in answers_for(self.folder(turn), bucket % self.files, bucket)}
        for b, p, q in self.parts(r):
            share[p], seats[q], customers[q] = (unpack(x, kind) for x, kind in zip(answers[b], ("<f8", "<u8", "<u8"), strict=True))
        return (share + (PARENT_STRENGTH + DISCOUNT * all_tables) / (self.known_words + 1)) / (PARENT_STRENGTH + all_customers), seats, customers

    def parts(self, r: Restaurants) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Buckets of words, and which words and contexts each has."""
        of_word, of_context = ((x % np.uint64(self.parents)).astype(np.int64) for x in (r.words, r.contexts))
        order = np.argsort(of_context, kind="stable")
        ends = [np.searchsorted(x, np.arange(self.parents + 1)).tolist() for x in (of_word, of_context[order])]
        for b in range(self.parents):
            p, q = slice(*ends[0][b : b + 2]), order[ends[1][b] : ends[1][b + 1]]
            if p.start < p.stop or len(q):
                yield b, p, q


def _upward(sweeps: Sweeps, turn: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tables of each word and context in a bucket's restaurants after a sweep, to the buckets of words; at first each dish has one."""
        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            bucket, r = int(row.bucket), Restaurants.of(row)
            if turn:
                parent, before, _ = sweeps.read(turn - 1, bucket, r)
            t = r.seated(turn, before, parent) if turn else np.minimum(r.c, 1)
            seats, tables_, customers = (np.bincount(at, x, n).astype(np.uint64) for at, x, n in ((r.word, t, len(r.words)), (r.context, t, len(r.contexts)), (r.context, r.c, len(r.contexts))))
            rows = [(b, bucket, *map(pack, (r.words[p], seats[p], r.contexts[q], tables_[q], customers[q]))) for b, p, q in sweeps.parts(r)]
            yield pd.DataFrame(rows, columns=["bucket", "asked_by", "words", "seats", "contexts", "tables", "customers"])

    return run


def _summed(numbers: pd.Series, *values: pd.Series) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct numbers, where each sender's stand among them, and the sums of values."""
    sent = [unpack(x, "<u8") for x in numbers]
    distinct, at = np.unique(np.concatenate(sent), return_inverse=True)
    sums = [np.zeros(len(distinct), np.uint64) for _ in values]
    for total, value in zip(sums, values, strict=True):
        np.add.at(total, at, np.concatenate([unpack(x, "<u8") for x in value]))
    return distinct, np.split(at, np.cumsum([len(x) for x in sent])[:-1]), sums


def _parent(turn: int, x: float | None, known_words: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Seat the parent's customers of a bucket of words; each bucket of contexts gets back what they hold beyond discounts, and its contexts' totals."""
        words, at, (c,) = _summed(pdf["words"], pdf["seats"])
        _, own, (seats, customers) = _summed(pdf["contexts"], pdf["tables"], pdf["customers"])
        c = c.astype(np.int64)
        t = np.minimum(c, 1) if x is None else tables(c, np.full(len(c), DISCOUNT * x / (known_words + 1)), uniforms(mix(words ^ _ODD), turn, 0))
        share, bucket = c - DISCOUNT * t, int(pdf["bucket"].iat[0])
        rows = [(int(by), bucket, pack(share[p]), pack(seats[q]), pack(customers[q]), 0, 0) for by, p, q in zip(pdf["asked_by"], at, own, strict=True)]
        return pd.DataFrame([*rows, (-1, bucket, None, None, None, int(t.sum()), int(c.sum()))], columns=["to", "bucket", "share", "tables", "customers", "all_tables", "all_customers"])

    return run


def _scored(sweeps: Sweeps, kept: range):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """-log10 of the mean probability of a bucket's pairs in fixed point, for each block that has them."""
        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            bucket, r = int(row.bucket), Restaurants.of(row)
            mean, (parent, before, _) = np.zeros(len(r.c)), sweeps.read(kept[0] - 1, bucket, r)
            for turn in kept:
                t = r.seated(turn, before, parent)  # the sweep's numbers once more
                parent, before, customers = sweeps.read(turn, bucket, r)
                mean += r.probabilities(t, before, customers, parent) / len(kept)
            logs = np.round(np.log10(mean) * -FIXED).astype(np.uint64)
            for block, cells in pickle.loads(row.blocks):
                yield pd.DataFrame({"block": [block], "bucket": [bucket], "logs": [pack(logs[np.cumsum(unpack(cells, "<u4").astype(np.int64))])]})

    return run


def _added(own: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the sums over their tokens; buckets stand in the order of the block's pairs."""
    docs, at = unpack(own["docs"].iat[0], _DOCS), unpack(own["at"].iat[0], "<u4")
    every = np.concatenate([unpack(x, "<u8") for x in logs.sort_values("bucket")["logs"]]).astype(np.int64)
    # in two halves, as the whole of a very long text is beyond 64 bits
    first = np.concatenate([[0], np.cumsum(docs["tokens"])])[:-1]
    high, low = (np.add.reduceat(half[at], first).astype(np.float64) for half in (every >> 32, every & 0xFFFFFFFF))
    score = (high * 4294967296.0 + low) / -FIXED
    ids = pd.array(docs["id"], "Int64")
    ids[docs["null"]] = pd.NA
    return pd.DataFrame({"doc_id": ids, "held_out": docs["held"], "n_tokens": docs["tokens"], "n_known": docs["known"], "base_score": docs["base"], "score": score})


def scored(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    The model learns from all rows that are not held out (crc32 of the id modulo 5 is 1; a null id is never held out). A null or empty
    text is its end alone. Words that training does not have share one unknown word's probability. Repeated rows are documents of
    their own. Without training rows every word is unknown; no rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    home = new_folder(spark, "hpylm")
    blocks = stored(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_blocks, "block string, n long, vocab binary, places binary, docs binary"), "blocks")
    # buckets follow the tokens, so that numbers of words, and with them the random numbers, are those of the corpus alone
    tokens, many = (int(x or 0) for x in blocks.agg(F.sum("n"), F.count("*")).first())
    buckets, parents = 1 + tokens // bucket_tokens, 1 << math.ceil(math.log2(max(1.0, math.sqrt(tokens) / 150)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks, files = max(1, min(buckets, 2 * partitions)), files_for(many, partitions)
    asked = blocks.mapInPandas(_asked(parents), "bucket int, block string, hashes binary, counts binary")
    numbered = stored(asked.groupBy("bucket").applyInPandas(_numbered(parents), "bucket int, block string, numbers binary, counts binary, v long, n long"), "numbers")
    known_words, known_tokens = (int(x or 0) for x in numbered.where("block is null").agg(F.sum("v"), F.sum("n")).first())
    answers = numbered.where("block is not null").select("block", "bucket", "numbers", "counts")
    published(answers, "block", F.conv(F.substring("block", 1, 8), 16, 10).cast("long") % files, files, f"{home}/numbers")
    discarded(numbered)
    release(spark)
    pairs = blocks.drop("n").mapInPandas(_paired(parents, buckets, bucket_tokens, known_words, known_tokens, f"{home}/numbers", files), "of_docs boolean, bucket int, block string, u binary, w binary, c binary, at binary, docs binary")
    pairs = stored(pairs, "pairs", "of_docs")
    discarded(blocks, f"{home}/numbers")
    # a number of partitions of its own: packed rows are few bytes and much work
    opened = pairs.where("not of_docs").select("bucket", "block", "u", "w", "c").repartition(tasks, "bucket").groupBy("bucket")
    restaurants = stored(opened.applyInPandas(_opened(parents), "bucket int, contexts binary, sizes binary, words binary, word binary, c binary, blocks binary"), "restaurants")
    discarded(*{f.rpartition("/")[0] for f in pairs.inputFiles() if "/of_docs=false/" in f})
    release(spark)
    sweeps, x = Sweeps(home, parents, known_words, files_for(buckets, partitions)), None
    for turn in range(burn + samples):
        up = restaurants.drop("blocks").mapInPandas(_upward(sweeps, turn), "bucket int, asked_by int, words binary, seats binary, contexts binary, tables binary, customers binary")
        shares = stored(up.groupBy("bucket").applyInPandas(_parent(turn, x, known_words), "to int, bucket int, share binary, tables binary, customers binary, all_tables long, all_customers long"), "shares")
        sums = tuple(int(v or 0) for v in shares.agg(F.sum("all_tables"), F.sum("all_customers")).first())
        x = float(gammas(np.array([PARENT_STRENGTH / DISCOUNT + sums[0]]), np.array([SEED], np.uint64), turn)[0])
        answers = shares.where("to >= 0").select("to", "bucket", "share", "tables", "customers")
        published(answers, "to", F.col("to") % sweeps.files, sweeps.files, sweeps.folder(turn))
        sweeps.scalars.append(sums)
        discarded(shares, *([sweeps.folder(turn - 1)] if 0 < turn < burn else []))
        release(spark)
    logs = restaurants.mapInPandas(_scored(sweeps, range(burn, burn + samples)), "block string, bucket int, logs binary")
    of_docs = pairs.where("of_docs").select("block", "at", "docs")
    out = of_docs.groupBy("block").cogroup(logs.groupBy("block")).applyInPandas(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame, score: str = "score") -> DataFrame:
    """``held_out, n_tokens, perplexity`` over the documents of ``scored``."""
    sums = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(score).alias("s"))
    return sums.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"))
