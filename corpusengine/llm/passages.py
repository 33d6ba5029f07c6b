"""Substring dedup: exact windows of 51 words, MinHash banding over paragraphs, exact Jaccard, components, removal of all but one copy.

Exact copies are found by windows of 51 words, wherever they stand and whatever the lines. Every window names the rightmost least of its
26-word grams, so equal windows name equal grams. Windows whose gram several documents name are hashed whole, and the least
document that has a window keeps it; no stretch of over 50 words is missed. Both texts of a stretch are compared before it is reported.

Near copies are found by paragraphs. A paragraph is a line, or a stretch of lines of fewer than SHORT words each. Paragraphs whose words are
equal, by 128 bits of BLAKE2 over them, are one node. Nodes that agree on one of several bands of least hashes of their five-word shingles are compared by the exact
Jaccard of their words, and links make components, in which the paragraph of the least document stays. Copied paragraphs that follow
each other without a word between, here and where they are kept, are one passage, and removed if they are long enough. Polynomial hashes only
propose: no word is removed unless it, or that digest of it, was compared.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, discarded, release, stored
from .words import Words, batches, mix, power, shingles, spaced, tokenise

SHINGLE, JACCARD = 5, 0.8
#: The chance that two paragraphs of just the wanted Jaccard agree on some band; the least hashes in a band.
RECALL, ROWS = 0.99, 3
#: Lines of fewer words are one paragraph with such lines that follow.
SHORT = 8
#: A repeated passage is removed if it has more words.
PASSAGE = 50
#: Paragraphs of a group of candidates that meet in one task with as many others; characters of text for each bucket of packed rows.
TILE, BUCKET = 256, 8_000_000
#: Words of text that a task holds before it packs what it found.
HELD = 600_000
#: Words of the grams that windows of PASSAGE + 1 words are sampled by; windows that a task holds before it packs them.
GRAM, WINDOWS = 26, 200_000
_NO_ID = np.iinfo(np.int64).max
_ANCHOR = np.dtype([("key", "<u8"), ("dk", "<i8"), ("start", "<i4"), ("n", "<i4")])
_WINDOW = np.dtype([("key", "<u8"), ("dk", "<i8"), ("doc", "<i8"), ("start", "<i4")])


def bands(jaccard: float = JACCARD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of so many least hashes each that paragraphs of the Jaccard given agree on one with the chance given."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows))


def _lines(w: Words) -> np.ndarray:
    """The line that each word stands in."""
    return np.concatenate([[0], np.cumsum(w.buf == 10)])[w.start]


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (in all of ``w``) and number of words of every paragraph: a line, or lines of fewer than SHORT words that follow each other."""
    n = len(w.hash)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    doc, first = w.doc, np.flatnonzero(np.diff(_lines(w), prepend=-1))
    short = np.diff(first, append=n) < SHORT
    joined = np.concatenate([[False], short[1:] & short[:-1] & (doc[first[1:]] == doc[first[:-1]])])
    first = first[~joined]
    return doc[first], first, np.diff(first, append=n)


def _keys(w: Words, first: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
    """Keys (paragraphs, count) of the bands of paragraphs of SHINGLE words or more."""
    sh = shingles(w.hash, SHINGLE)
    ends = np.stack([first, first + n - SHINGLE + 1], 1).ravel()
    ends = ends[:-1] if len(ends) and ends[-1] >= len(sh) else ends
    keys = np.zeros((len(first), count), np.uint64)
    if len(ends):
        for k, odd in enumerate(mix(np.arange(1, count * ROWS + 1, dtype=np.uint64)) | np.uint64(1)):
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ np.minimum.reduceat(sh * odd, ends)[::2])
    return mix(keys ^ np.arange(count, dtype=np.uint64)[None, :])


def _pack(records: np.ndarray, buckets: int) -> pd.DataFrame:
    bucket = (records["key"] >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = [("anchor", int(bucket[part[0]]), records[part].tobytes()) for part in np.split(order, cuts[1:]) if len(part)]
    return pd.DataFrame(rows, columns=["kind", "bucket", "data"])


def _nodes(w: Words, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """128 bits of BLAKE2 of the words of each paragraph, with one blank between."""
    data, at = spaced(w)
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), (at[first + n] - 1).tolist(), strict=True)]


def sampled(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and gram of every run of windows of PASSAGE + 1 words that name the same gram."""
    low = shingles(w.hash, GRAM)
    at, width, size = np.arange(len(low)), PASSAGE + 2 - GRAM, 1
    if len(w.hash) <= PASSAGE:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    while size < width:  # the rightmost least of ever more grams
        step = min(size, width - size)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    doc = w.doc
    start = np.flatnonzero(doc[: len(low)] == doc[PASSAGE:])
    first = np.flatnonzero(np.diff(at[start], prepend=-1))
    s = start[first]
    return doc[s], s - w.first[doc[s]], np.diff(first, append=len(start)), low[s]


def _grouped(rows: np.ndarray, by: str, *then: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of the columns, and the number of each one's group by the first."""
    rows = rows[np.lexsort([rows[c] for c in (*then[::-1], by)])]
    return rows, np.cumsum(np.diff(rows[by], prepend=~rows[by][:1]) != 0) - 1


def _several(rows: np.ndarray, group: np.ndarray, other: str) -> np.ndarray:
    """For rows in the order of group and ``other``, whether their group has more than one of these."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return (rows[other][starts] != rows[other][np.append(starts[1:], len(rows)) - 1])[group]


_FOUND = "kind string, bucket int, data binary, dk long, doc long, start int, n int, node binary, bands array<long>"


def _mapped(buckets: int, count: int):  # noqa: ANN202
    """The paragraphs of some texts, each node's bands once, and packs of sampled grams."""

    def described(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        w = tokenise(frame["text"])
        dk, ids = frame["dk"].to_numpy(np.int64), frame["id"].to_numpy(np.int64)
        doc, first, n = paragraphs(w)
        out = pd.DataFrame({"kind": "paragraph", "dk": dk[doc], "doc": ids[doc], "start": first - w.first[doc], "n": n, "node": _nodes(w, first, n)})
        long = np.flatnonzero(n >= SHINGLE)
        keys = _keys(w, first[long], n[long], count).view(np.int64)
        given = np.full(len(out), None, object)
        given[long] = list(keys)
        out["bands"] = given
        doc, start, n, key = sampled(w)
        anchors = np.zeros(len(doc), _ANCHOR)
        for name, value in (("key", key), ("dk", dk[doc]), ("start", start), ("n", n)):
            anchors[name] = value
        return out, anchors, len(w.hash)

    def packed(held: list[tuple[pd.DataFrame, np.ndarray, int]]) -> Iterator[pd.DataFrame]:
        places = pd.concat([x[0] for x in held], ignore_index=True)
        places.loc[places["node"].duplicated(), "bands"] = None
        yield places
        # a gram that several documents name here goes on once, so a common one is no more than a row of each pack
        anchors, group = _grouped(np.concatenate([x[1] for x in held]), "key", "dk")
        if len(anchors):
            several = _several(anchors, group, "dk")
            yield _pack(anchors[~several | (np.diff(group, prepend=-1) != 0)], buckets)
            hot = anchors[several]
            if len(hot):
                yield pd.DataFrame({"kind": "hot", "bucket": [int(hot["key"][0] % np.uint64(buckets))], "data": [hot.tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[pd.DataFrame, np.ndarray, int]] = []
        for frame in batches(frames):
            held.append(described(frame))
            if sum(x[2] for x in held) >= HELD:
                yield from map(whole, packed(held))
                held = []
        if any(x[2] for x in held):
            yield from map(whole, packed(held))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pd.DataFrame({c: frame[c] if c in frame else np.full(len(frame), None, object) for c in names})

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket the sampled grams that are in several documents."""
    rows = np.frombuffer(b"".join(pdf["data"]), _ANCHOR)
    if pdf["kind"].iat[0] != "hot":
        rows, group = _grouped(rows, "key", "dk")
        rows = rows[_several(rows, group, "dk")]
    return pd.DataFrame({"dk": rows["dk"], "start": rows["start"], "n": rows["n"]})


def _quoted(rows: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    """``dk, start, n, words`` of the spans (dk, start, n): their words with one blank between, or 128 bits of BLAKE2 of these."""
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    wanted = spans.select("dk", span.alias("span")).groupBy("dk").agg(F.collect_set("span").alias("spans"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            w = tokenise(frame["text"])
            data, at = spaced(w)
            spans = np.concatenate([np.asarray(x, np.int64) for x in frame["spans"]])
            doc = np.repeat(np.arange(len(frame)), frame["spans"].str.len())
            start, n = spans >> 32, spans & 0xFFFFFFFF
            first = w.first[doc] + start
            quotes = (data[a:b] for a, b in zip(at[first].tolist(), (at[first + n] - 1).tolist(), strict=True))
            words = [hashlib.blake2b(q, digest_size=16).digest() if digest else bytes(q) for q in quotes]
            yield pd.DataFrame({"dk": frame["dk"].to_numpy(np.int64)[doc], "start": start, "n": n, "words": words})

    found = rows.select("dk", "text").join(wanted, "dk").mapInPandas(run, "dk long, start int, n int, words binary")
    return found.dropDuplicates(["dk", "start", "n"])  # rows that repeat a document give the same


def _thin(rows: np.ndarray) -> bytes:
    """Windows column by column and their starts as differences, which compress to little more than the keys."""
    return b"".join([*(rows[c].tobytes() for c in ("key", "dk", "doc")), np.diff(rows["start"], prepend=np.int32(0)).tobytes()])


def _thick(parts: list[bytes]) -> np.ndarray:
    out = [np.zeros(len(data) // _WINDOW.itemsize, _WINDOW) for data in parts]
    for data, rows in zip(parts, out, strict=True):
        n = len(rows)
        for i, c in enumerate(("key", "dk", "doc")):
            rows[c] = np.frombuffer(data, _WINDOW[c], n, 8 * n * i)
        rows["start"] = np.cumsum(np.frombuffer(data, "<i4", n, 24 * n))
    return np.concatenate([np.zeros(0, _WINDOW), *out])


def _split(rows: np.ndarray, by: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.lexsort((rows["start"], rows["dk"], by))
    cuts = np.flatnonzero(np.diff(by[order], prepend=-1))
    return [(int(by[part[0]]), _thin(rows[part])) for part in np.split(order, cuts[1:]) if len(part)]


def _windows(buckets: int):  # noqa: ANN202
    """Packs of hashed windows: all of them as ``place``, and the least of each hash as ``least`` by bucket."""

    def described(frame: pd.DataFrame) -> np.ndarray:
        w = tokenise(frame["text"])
        spans = np.concatenate([np.asarray(x, np.int64) for x in frame["spans"]])
        doc = np.repeat(np.arange(len(frame)), frame["spans"].str.len())
        first, n = (spans >> 32) + w.first[doc], spans & 0xFFFFFFFF
        at = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
        out, doc = np.zeros(len(at), _WINDOW), w.doc[at]
        columns = ("key", shingles(w.hash, PASSAGE + 1)[at]), ("dk", frame["dk"].to_numpy(np.int64)[doc]), ("doc", frame["id"].to_numpy(np.int64)[doc]), ("start", at - w.first[doc])
        for name, value in columns:
            out[name] = value
        return out

    def packed(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        pack = uuid.uuid4().int >> 65
        yield pd.DataFrame({"kind": "place", "bucket": [0], "data": [_thin(rows)], "pack": pack})
        ordered, group = _grouped(rows, "key", "doc", "dk", "start")
        least = ordered[np.diff(group, prepend=-1) != 0]
        bucket = (least["key"] >> np.uint64(33)).astype(np.int64) % buckets
        yield pd.DataFrame([("least", b, data, pack) for b, data in _split(least, bucket)], columns=["kind", "bucket", "data", "pack"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for frame in batches(frames):
            held.append(described(frame))
            if sum(map(len, held)) >= WINDOWS:
                yield from packed(np.concatenate(held))
                held = []
        if any(map(len, held)):
            yield from packed(np.concatenate(held))

    return run


def _kept(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each pack the least places of windows that another pack has in a lesser one."""
    rows, pack = _thick(pdf["data"].tolist()), np.repeat(pdf["pack"].to_numpy(np.int64), pdf["data"].str.len() // _WINDOW.itemsize)
    order = np.lexsort((rows["start"], rows["dk"], rows["doc"], rows["key"]))
    rows, pack = rows[order], pack[order]
    first = np.diff(rows["key"], prepend=~rows["key"][:1]) != 0
    least = rows[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]
    return pd.DataFrame(_split(least, pack[~first]), columns=["pack", "data"])


def _exact(places: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """Windows of a pack that another document keeps, joined where they follow each other in both texts; stretches that their neighbours cover go."""
    rows, group = _grouped(_thick(places["data"].tolist()), "key", "doc", "dk", "start")
    least = rows[np.diff(group, prepend=-1) != 0]
    other = _thick(kept["data"].tolist())
    least[np.searchsorted(least["key"], other["key"])] = other
    k = least[group]
    copied = rows["dk"] != k["dk"]
    rows, k = rows[copied], k[copied]
    _, one = np.unique(rows[["dk", "start"]], return_index=True)
    rows, k = rows[one], k[one]
    along = (rows["dk"][1:] == rows["dk"][:-1]) & (k["dk"][1:] == k["dk"][:-1]) & (rows["start"][1:] == rows["start"][:-1] + 1) & (k["start"][1:] == k["start"][:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~along])[: len(rows)])
    n = np.diff(first, append=len(rows)) + PASSAGE
    rows, k = rows[first], k[first]
    # both ends ascend, so the last stretch that begins before this one's end is the next that is needed
    at = (np.cumsum(np.diff(rows["dk"], prepend=~rows["dk"][:1]) != 0) << 32) + rows["start"]
    ahead = np.maximum(np.searchsorted(at, at + n, "right") - 1, np.arange(1, len(at) + 1)).tolist()
    need, i = [], 0
    while i < len(at):
        need.append(i)
        i = ahead[i]
    rows, k, n = rows[need], k[need], n[need]
    return pd.DataFrame({"dk": rows["dk"], "doc": rows["doc"], "kdk": k["dk"], "kdoc": k["doc"], "start": rows["start"], "n": n, "kstart": k["start"]})


def _exact_repeats(rows: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """``dk, doc, kdoc, start, n, kstart`` of stretches over PASSAGE words whose windows the least document that has them keeps."""
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    spans = stored(anchors.select("dk", span.alias("span")).groupBy("dk").agg(F.collect_set("span").alias("spans")), "spans")
    packs = stored(rows.join(spans, "dk").mapInPandas(_windows(buckets), "kind string, bucket int, data binary, pack long"), "windows", "kind")
    kept = packs.where("kind = 'least'").groupBy("bucket").applyInPandas(_kept, "pack long, data binary")
    places = packs.where("kind = 'place'").select("pack", "data")
    found = places.groupBy("pack").cogroup(kept.groupBy("pack")).applyInPandas(_exact, "dk long, doc long, kdk long, kdoc long, start int, n int, kstart int")
    found = stored(found.distinct(), "stretches")
    discarded(spans, packs)
    release(rows.sparkSession)
    # hashes have found them; the words decide
    keeping = found.select(F.col("kdk").alias("dk"), F.col("kstart").alias("start"), "n")
    quoted = stored(_quoted(rows, found.select("dk", "start", "n").unionByName(keeping).distinct(), True), "quoted")
    own, kept = quoted.withColumnRenamed("words", "own"), quoted.select(F.col("dk").alias("kdk"), F.col("start").alias("kstart"), "n", F.col("words").alias("kept"))
    return found.join(own, ["dk", "start", "n"]).join(kept, ["kdk", "kstart", "n"]).where("own = kept").select("dk", "doc", "kdoc", "start", "n", "kstart")


def _linked(pdf: pd.DataFrame, jaccard: float) -> pd.DataFrame:
    """Edges that connect, in each group of candidates, the nodes that chains of similar ones connect."""
    edges: list[tuple[int, int]] = []
    for _, group in pdf.groupby(["key", "tile_l", "tile_r"], sort=False):
        group = group.drop_duplicates("id")
        waiting = []
        for node, data in zip(group["id"].tolist(), group["words"], strict=True):
            w = bytes(data).split(b" ")
            waiting.append((node, set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))))
        while waiting:  # search from one node on; whatever is reached needs no comparing with what was reached before
            front = [waiting.pop()]
            while front and waiting:
                node, own = front.pop()
                rest = []
                for item in waiting:
                    low, high = sorted((len(own), len(item[1])))
                    common = len(own & item[1]) if low >= jaccard * high else 0
                    if common >= jaccard * (low + high - common):
                        edges.append((node, item[0]))
                        front.append(item)
                    else:
                        rest.append(item)
                waiting = rest
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def _similar(rows: DataFrame, paras: DataFrame, jaccard: float, buckets: int) -> DataFrame:
    """``node, root``: nodes that chains of similar ones connect, without those that are their own root; large groups of candidates are cut into tiles that meet pair by pair."""
    nodes = paras.where("bands is not null").groupBy("node").agg(F.min(F.struct("dk", "start", "n", "bands")).alias("at"))
    # numbered as they are stored: a number is half of what a node takes, and there is one for each band
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "at.*"), "nodes")
    cands = nodes.select("id", F.explode("bands").alias("key"))
    # bands mostly repeat each other's groups; of those with the same nodes one is enough
    same = ["size", "least", "most", "both"]
    groups = cands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.max("id").alias("most"), F.bit_xor(F.xxhash64("id")).alias("both")).where("least < most")
    groups = cut(groups.groupBy(*same).agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    dealt = cut(cands.join(groups, "key").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")))
    wanted = nodes.join(dealt.select("id").distinct(), "id", "left_semi").select("id", "node", "dk", "start", "n")
    texts = stored(wanted.join(_quoted(rows, wanted, False), ["dk", "start", "n"]).select("id", "node", "words"), "texts")
    discarded(nodes)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    sent = dealt.select("key", "id", "tile", other.alias("other"))
    sent = sent.select("key", "id", F.least("tile", "other").alias("tile_l"), F.greatest("tile", "other").alias("tile_r")).join(texts.select("id", "words"), "id")
    sent = sent.withColumn("bucket", F.pmod(F.xxhash64("key", "tile_l", "tile_r"), F.lit(4 * buckets))).repartition(buckets, "bucket")
    edges = stored(sent.groupBy("bucket").applyInPandas(lambda pdf: _linked(pdf, jaccard), "a long, b long"), "edges")
    roots = connected_components(edges)
    named = roots.join(texts.select(F.col("id").alias("root"), F.col("node").alias("root_node")), "root").withColumnRenamed("node", "id")
    named = cut(named.join(texts.select("id", "node"), "id").select("node", F.col("root_node").alias("root")))
    discarded(texts, edges)
    return named


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copied paragraphs, in the order of documents and words, joined where they follow each other in both texts; the long ones."""

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        dk, kdk, start, kstart, n, kn = (f[c].to_numpy() for c in ("dk", "kdk", "start", "kstart", "n", "kn"))
        along = (dk[1:] == dk[:-1]) & (kdk[1:] == kdk[:-1]) & (start[1:] == (start + n)[:-1]) & (kstart[1:] == (kstart + kn)[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~along]))
        last = np.append(first[1:], len(f)) - 1
        out = f.iloc[first][["dk", "doc", "kdoc", "start", "kstart"]].reset_index(drop=True).assign(n=(start + n)[last] - start[first])
        return out[out["n"] > PASSAGE]

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        at = int(np.searchsorted(frame["dk"].to_numpy(), frame["dk"].iat[-1])) if len(frame) else 0
        held = frame.iloc[at:]
        if at:
            yield joined(frame.iloc[:at])
    if held is not None and len(held):
        yield joined(held)


def _near_repeats(rows: DataFrame, paras: DataFrame, jaccard: float, buckets: int) -> DataFrame:
    """``dk, doc, kdoc, start, n, kstart`` of paragraphs, or several in a row, over PASSAGE words that are similar to those of a lesser document."""
    roots = _similar(rows, paras, jaccard, buckets)
    place = F.struct("doc", "dk", "start", "n")
    nodes = paras.groupBy("node").agg(F.min(place).alias("e"), (F.min("dk") < F.max("dk")).alias("several"))
    nodes = cut(nodes.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node", "left").where("several or root is not null"))
    # the least document that has just the same words keeps them; of such keepers in a component the least
    similar = cut(nodes.where("root is not null").groupBy("root").agg(F.min("e").alias("s")))
    keepers = cut(nodes.join(similar, "root", "left").select("node", "e", "s"))
    copies = paras.select("dk", "doc", "start", "n", "node").join(keepers, "node")
    copies = copies.withColumn("k", F.when(F.col("dk") != F.col("e.dk"), F.col("e")).otherwise(F.coalesce("s", "e"))).where("dk <> k.dk")
    copies = copies.select("dk", "doc", "start", "n", F.col("k.dk").alias("kdk"), F.col("k.doc").alias("kdoc"), F.col("k.start").alias("kstart"), F.col("k.n").alias("kn"))
    runs = copies.distinct().repartition("dk").sortWithinPartitions("dk", "start", "kdk", "kstart")
    return runs.mapInPandas(_runs, "dk long, doc long, kdoc long, start int, kstart int, n int").select("dk", "doc", "kdoc", "start", "n", "kstart")


def repeated(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``doc_id, dk, start, n, kept_doc_id, kept_start``: every stretch of over PASSAGE words that another document keeps.

    ``start`` is the position of the first word (from 0) and ``n`` the number of words in ``docs(doc_id, text)``; the same words, or
    similar paragraphs, stand at ``kept_start`` in the least doc_id that has them. ``dk`` is a hash of
    doc_id and text, so rows that repeat a doc_id are told apart; rows equal in both are one document and copy nothing from each other.
    A null doc_id comes after all others. Null, empty and short texts have nothing to compare. A passage that a
    document repeats within itself stays. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("dk"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    # buckets follow the texts, so that what a task holds doesn't
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / BUCKET))
    found = stored(rows.mapInPandas(_mapped(buckets, bands(jaccard)), _FOUND), "paragraphs", "kind")
    near = stored(_near_repeats(rows, found.where("kind = 'paragraph'").select("dk", "doc", "start", "n", "node", "bands"), jaccard, buckets), "near")
    # what is wide goes before the windows are made
    discarded(*{f.rpartition("/")[0] for f in found.inputFiles() if "/kind=paragraph/" in f})
    release(spark)
    anchors = found.where("kind in ('anchor', 'hot')").select("kind", "bucket", "data").groupBy("kind", "bucket").applyInPandas(_gathered, "dk long, start int, n int")
    whole = stored(_exact_repeats(rows, anchors, buckets), "exact")
    out = near.unionByName(whole).distinct()
    named_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(named_id("doc").alias("doc_id"), "dk", "start", "n", named_id("kdoc").alias("kept_doc_id"), F.col("kstart").alias("kept_start"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (``n_chars`` follows, if there is one); rows that lose all their words go."""
    columns = docs.columns
    spans = repeated(docs).groupBy("dk").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("dk"), F.struct(*columns).alias("row"))
    spans = cut(spans)
    both = keyed.join(spans, "dk", "left")
    cleaned = both.select("row", F.col("row.text").alias("text"), F.to_json("spans").alias("spans"), F.col("spans").isNotNull().alias("hit"))
    whole = cleaned.where("not hit").select("row.*")
    hit = cleaned.where("hit")

    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["start"], s["n"]) for s in json.loads(x)]) for t, x in zip(texts, spans, strict=True)], dtype=object)

    out = hit.select("row", left("text", "spans").alias("left")).where("left <> ''")
    new = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return whole.unionByName(out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns)))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans (first, number) and the white space after each; "" if no word is left."""
    w = tokenise([text])
    keep = np.ones(len(w.hash), bool)
    for start, n in spans:
        keep[start : start + n] = False
    if not keep.any():
        return ""
    data, ends = text.encode("utf-8", "replace"), np.append(w.start[1:], len(w.buf) - 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    parts = [data[w.start[a] : ends[b - 1]] for a, b in zip(edges[0::2], edges[1::2], strict=True)]
    return b"".join(parts).decode("utf-8").rstrip()
