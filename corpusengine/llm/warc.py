"""WARC archives with a two-level capture index.

Tasks write records to archives of their own, each record a gzip member, and return where each stands. Captures are range-partitioned by
key (reversed host, path, page) into index shards: sorted lines in compressed blocks, then a directory with the first key
of every block. A reader bisects the shards, then a shard's directory, reads that one block and bisects its lines, and so
knows the byte range of the record. Files live in the shared folder under names no other attempt uses: what a
lost or repeated task wrote is never listed.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_folder, stored
from .store import filesystem

#: Fixed value of the contract: payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Lines in an index block, bytes in an archive (a new one is begun beyond), bytes of an archive that are read by one task.
BLOCK_LINES, ARCHIVE_BYTES, READ_BYTES = 1000, 1 << 30, 16 << 20
#: Groups of equal payloads that are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """What ``write`` made: the table of captures and the first and last key and file of each index shard."""

    captures: DataFrame
    shards: list[tuple[str, str, str]]


def surt(url: str | None, page_id: int | None) -> str:
    """``com,example,www)/path?query`` and the page, sorted by number; white space and controls are percent-encoded."""
    rest = (url or "").partition("://")[2] or (url or "")
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:at].rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    key = f"{','.join(reversed(name.split('.')))}{colon}{port}){rest[at:]}" if url is not None else "-"
    key = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in key)
    return f"{key}\t{'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def target(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _framed(kind: str, name: str, headers: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, file: str) -> bytes:
    """The record that an archive begins with."""
    return _framed("warcinfo", name, [f"WARC-Filename: {file.rpartition('/')[2]}", "Content-Type: application/warc-fields"], b"software: corpusengine\r\nformat: WARC File Format 1.1\r\n")


def record(name: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, of: tuple[int, str | None, str] | None = None) -> bytes:
    """A response, or with ``of`` (page, url and record) a revisit of it, which has the headers of its capture and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [*([f"WARC-Target-URI: {target(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {'' if page_id is None else page_id}"]
    if of is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {of[2]}", f"WARC-Refers-To-Date: {DATE}", *([f"WARC-Refers-To-Target-URI: {target(of[1])}"] if of[1] is not None else []), f"Refers-To-Page-ID: {of[0]}"]
    return _framed("response" if of is None else "revisit", name, [*headers, "Content-Type: application/http; msgtype=response"], http + (payload or b""))


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


_CAPTURES = "key string, file string, offset long, length long, record string, page_id string, url string, digest string"


def _written(folder: str):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Writes rows ``page_id, url, payload, size, digest, of_page, of_url, of_record`` as records; their places are the captures."""
        fs, base = filesystem(f"{folder}/archives/{uuid.uuid4().hex}")
        out, file, at, files = None, "", 0, 0
        name = lambda: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{at}')}>"  # noqa: E731  # no two records stand at one place
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    file, at, files = f"{base}-{files}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(file, compression=None)
                    at += out.write(gzip.compress(info(name(), file), 4, mtime=0))
                page, of_page = (None if pd.isna(x) else int(x) for x in (row.page_id, row.of_page))
                payload = None if row.payload is None else bytes(row.payload)
                own = name()
                data = gzip.compress(record(own, page, row.url, payload, int(row.size), row.digest, None if of_page is None else (of_page, row.of_url, row.of_record)), 4, mtime=0)
                out.write(data)
                found.append((surt(row.url, page), file, at, len(data), own, row.page_id, row.url, row.digest))
                at += len(data)
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _CAPTURES.split(", ")])
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame) -> Archive:
    """Archive every row of ``pages(page_id, url, html)``; see ``round_trip`` for what becomes of nulls and repeated rows.

    Responses are written first, so that revisits, which need no payloads, can name the record that they refer to.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("size") >= LEAST_REVISIT)
    groups = cut(large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n"))
    small = groups.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    # page ids as text: pandas would turn longs with nulls among them into floats
    named = [F.col("page_id").cast("string"), "url"]
    none = [F.lit(None).cast("string").alias(c) for c in ("of_page", "of_url", "of_record")]
    responses = rows.where(~F.coalesce(F.col("kept") != F.coalesce("page_id", F.col("kept") - 1), F.lit(False)))
    responses = stored(responses.select(*named, "payload", "size", "digest", *none).mapInPandas(_written(folder), _CAPTURES), "responses")
    originals = responses.join(F.broadcast(groups) if small else groups, "digest").where(F.col("page_id") == F.col("kept").cast("string"))
    originals = originals.groupBy("digest").agg(F.min(F.struct("record", "url")).alias("o"), F.first("page_id").alias("of_page"))
    originals = cut(originals.select("digest", "of_page", F.col("o.url").alias("of_url"), F.col("o.record").alias("of_record")))
    revisits = rows.where(F.col("kept") != F.coalesce("page_id", F.col("kept") - 1)).select(*named, "size", "digest")
    revisits = revisits.join(F.broadcast(originals) if small else originals, "digest").withColumn("payload", F.lit(None).cast("binary"))
    revisits = stored(revisits.mapInPandas(_written(folder), _CAPTURES), "revisits")
    captures = responses.unionByName(revisits)
    return Archive(captures, _index(captures, folder))


def _index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Write the index shards; the list of them has a row for each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(f"{folder}/index/{uuid.uuid4().hex}.cdx")
        out, at, blocks, lines, last = None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            blocks.append((lines[0].rsplit("\t", 3)[0], at, len(data)))
            at, lines = at + len(data), []

        for frame in frames:
            for row in frame.itertuples(index=False):
                out = out or fs.open_output_stream(path, compression=None)
                lines.append(f"{row.key}\t{row.file}\t{row.offset}\t{row.length}")
                last = row.key
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            directory = zlib.compress(json.dumps(blocks).encode())
            out.write(directory)
            out.write(len(directory).to_bytes(8, "big"))
            out.close()
            yield pd.DataFrame([(blocks[0][0], last, path)], columns=["first", "last", "file"])

    ordered = captures.repartitionByRange("key").sortWithinPartitions("key").select("key", "file", "offset", "length")
    shards = cut(ordered.mapInPandas(run, "first string, last string, file string"))
    return sorted((r["first"], r["last"], r["file"]) for r in shards.collect())


class Reader:
    """Looks captures up in index shards; the last shard's directory and the last block are kept, as keys mostly come in order."""

    def __init__(self, shards: list[tuple[str, str, str]], uri: str) -> None:
        self.shards, self.firsts = shards, [s[0].encode("utf-8", "surrogatepass") for s in shards]
        self.fs, _ = filesystem(f"{uri}/x")
        self.open: tuple[str, object, list, list[bytes]] | None = None
        self.block: tuple[tuple[str, int], list[bytes]] | None = None

    def _directory(self, path: str) -> tuple[list, list[bytes]]:
        if self.open is None or self.open[0] != path:
            f = self.fs.open_input_file(path)
            size = f.size()
            length = int.from_bytes(f.read_at(8, size - 8), "big")
            blocks = json.loads(zlib.decompress(f.read_at(length, size - 8 - length)))
            self.open = (path, f, blocks, [b[0].encode("utf-8", "surrogatepass") for b in blocks])
        return self.open[2], self.open[3]

    def _lines(self, path: str, offset: int, length: int) -> list[bytes]:
        if self.block is None or self.block[0] != (path, offset):
            self.block = ((path, offset), zlib.decompress(self.open[1].read_at(length, offset)).split(b"\n"))
        return self.block[1]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """File, offset and length of every capture with the key."""
        want, found = key.encode("utf-8", "surrogatepass"), []
        for first, last, path in self.shards[max(0, bisect.bisect_left(self.firsts, want) - 1) :]:
            if first.encode("utf-8", "surrogatepass") > want:
                break
            if last.encode("utf-8", "surrogatepass") < want:
                continue
            blocks, firsts = self._directory(path)
            for b in range(max(0, bisect.bisect_left(firsts, want) - 1), len(blocks)):
                if firsts[b] > want:
                    break
                lines = self._lines(path, *blocks[b][1:])
                at = bisect.bisect_left(lines, want + b"\t")
                while at < len(lines) and lines[at].startswith(want + b"\t"):
                    file, offset, length = lines[at].decode("utf-8", "surrogatepass").rsplit("\t", 3)[1:]
                    found.append((file, int(offset), int(length)))
                    at += 1
        return found


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """``file, offset, length`` of the captures of ``wanted(page_id, url)``, once each."""
    shards, uri = archive.shards, new_folder(wanted.sparkSession, "warc")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": [surt(u, None if pd.isna(p) else int(p)) for p, u in zip(frame["page_id"], frame["url"], strict=True)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shards, uri)
        for frame in frames:
            yield pd.DataFrame([x for key in frame["key"] for x in reader.find(key)], columns=["file", "offset", "length"])

    keys = cut(wanted.select(F.col("page_id").cast("string"), "url").mapInPandas(keyed, "key string").distinct())
    return keys.repartitionByRange(_tasks(wanted), "key").sortWithinPartitions("key").mapInPandas(run, "file string, offset long, length long")


def _tasks(df: DataFrame) -> int:
    """A number of partitions of its own: places are few bytes and much reading, which adaptive execution would put into a few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read(places: DataFrame) -> DataFrame:
    """The records at ``file, offset, length``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, the payload (null in a revisit), and the ids ``record`` and ``of_record``."""
    folder = new_folder(places.sparkSession, "warc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(f"{folder}/x")
        name, f = "", None
        for frame in frames:
            out = []
            for file, offset, length in frame.itertuples(index=False):
                if file != name:
                    name, f = file, fs.open_input_file(file)
                headers, http, payload = parsed(gzip.decompress(f.read_at(length, offset)))
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the payload at {offset} of {file} is not what was archived")
                out.append((headers["Page-ID"].strip() or None, int(http["Content-Length"]), digest, kind, headers.get("Refers-To-Page-ID"), payload if kind == "response" else None, headers["WARC-Record-ID"], headers.get("WARC-Refers-To")))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record", "of_record"])

    dealt = places.repartition(_tasks(places), "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    rows = dealt.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, record string, of_record string")
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def resolved(records: DataFrame) -> DataFrame:
    """What ``read`` returns, each revisit with the payload of the response it refers to."""
    originals = records.where("record_type = 'response'").select(F.col("record").alias("original"), F.col("payload").alias("found"))
    originals = originals.join(records.select(F.col("of_record").alias("original")).distinct(), "original", "left_semi")
    both = records.join(originals, records["of_record"] == originals["original"], "left")
    return both.select(*(F.coalesce("payload", "found").alias(c) if c == "payload" else records[c] for c in records.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` and read every capture back by its index entry.

    A null html is an empty payload; a null url has no target and sorts under ``-``; a null page_id cannot be referred to, so such
    rows are revisits only where an equal payload has an id. Rows that repeat a page_id are records of their own, all responses if the id is the largest.
    No rows give no rows. Other columns are ignored.
    """
    archive = write(pages)
    return read(lookup(archive, pages.select("page_id", "url")))


def oracle() -> str:
    """DuckDB SQL for ``round_trip`` less the payload."""
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS kept FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < {LEAST_REVISIT} OR kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < {LEAST_REVISIT} OR kept IS NULL OR kept = page_id THEN NULL ELSE kept END AS refers_to FROM k
"""
