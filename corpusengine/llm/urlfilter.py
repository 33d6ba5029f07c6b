"""URL filtering with a memory-mapped sorted array of 64-bit digests.

Rules are strings, a host and a path prefix. The index file holds their xxHash64 digests in order, the offsets of
their strings and the strings. Spark hands the file to every executor, whose tasks map it rather than
load it, so that its size is bounded by disks. A batch of URLs is turned into the keys that could be rules (as many last labels
and as long a path as some rule has), whose digests are found by vectorised binary search and confirmed with the stored strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir
from .store import filesystem

#: The contract's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The verdict where no rule fits.
DEFAULT = "allow"


def index_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of rules (verdict, host, path): counts, shapes, then digests, verdicts, offsets and strings by ascending digest.

    A rule given twice counts once, as given last. A shape is the labels of a host and the characters of a path.
    """
    verdicts = {(host.lower(), path): verdict for verdict, host, path in rules}
    keys = sorted(((xxhash.xxh64_intdigest((h + p).encode()), h, p, v) for (h, p), v in verdicts.items()), key=lambda k: k[0])
    strings = [f"{h}\t{p}".encode() for _, h, p, _ in keys]
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p, _ in keys})
    head = np.array([len(keys), len(shapes), *(x for s in shapes for x in s)], np.int64)
    digests = np.array([k[0] for k in keys], np.uint64)
    blocks = np.array([k[3] == "block" for k in keys], np.int64)
    offsets = np.cumsum([0, *map(len, strings)]).astype(np.int64)
    return b"".join([head.tobytes(), digests.tobytes(), blocks.tobytes(), offsets.tobytes(), *strings])


class Index:
    """An index file, mapped."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n, shapes = data[:16].view(np.int64).tolist()
        at = 16 + 16 * shapes
        self.shapes = data[16:at].view(np.int64).reshape(-1, 2).tolist()
        self.digests, self.blocks = data[at : at + 8 * n].view(np.uint64), data[at + 8 * n : at + 16 * n].view(np.int64)
        self.offsets, self.strings = data[at + 16 * n : at + 24 * n + 8].view(np.int64), data[at + 24 * n + 8 :]

    def find(self, keys: list[tuple[str, str] | None]) -> list[str | None]:
        """For each (host, path) the verdict of the rule that has just these, or None."""
        out: list[str | None] = [None] * len(keys)
        asked = [i for i, k in enumerate(keys) if k is not None]
        wanted = np.array([xxhash.xxh64_intdigest((keys[i][0] + keys[i][1]).encode("utf-8", "replace")) for i in asked], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        for i, p, digest in zip(asked, at.tolist(), wanted, strict=True):
            while p < len(self.digests) and self.digests[p] == digest:  # more than one only where digests collide
                if self.strings[self.offsets[p] : self.offsets[p + 1]].tobytes() == "\t".join(keys[i]).encode("utf-8", "replace"):
                    out[i] = "block" if self.blocks[p] else "allow"
                p += 1
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the contract has them; both empty for a null or a text without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut_at = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut_at].partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def judge(urls: list[str | None], index: Index, default: str = DEFAULT) -> pd.DataFrame:
    """``host, path, rule, verdict`` of each URL: the longest rule that fits, of equals the one with the longer host."""
    split = [parts(u) for u in urls]
    best: list[tuple[int, int, str, str] | None] = [None] * len(urls)
    for labels, length in index.shapes:
        keys: list[tuple[str, str] | None] = []
        for host, path in split:
            suffix = host.rsplit(".", labels)
            fits = host and len(path) >= length and len(suffix) >= labels
            keys.append((".".join(suffix[-labels:]), path[:length]) if fits else None)
        for i, verdict in enumerate(index.find(keys)):
            if verdict is not None:
                host, path = keys[i]
                best[i] = max(best[i] or (-1, -1, "", ""), (len(host) + len(path), len(host), host + path, verdict))
    return pd.DataFrame({"host": [s[0] for s in split], "path": [s[1] for s in split], "rule": [b and b[2] for b in best], "verdict": [b[3] if b else default for b in best]})


def filtered(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains of it if the path begins with its path. Null URLs have empty hosts and
    paths and take the default verdict, as do hosts no rule fits; null page_ids and repeated rows are kept. Other columns are ignored.
    """
    spark = pages.sparkSession
    name = publish(spark, index_bytes(rules))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for frame in frames:
            yield pd.concat([frame["page_id"].reset_index(drop=True), judge(frame["url"].tolist(), index, default)], axis=1)

    # ids as text: pandas would turn longs with nulls among them into floats
    out = pages.select(F.col("page_id").cast("string"), "url").mapInPandas(run, "page_id string, host string, path string, rule string, verdict string")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def publish(spark: SparkSession, data: bytes) -> str:
    """Write an index to the shared folder under a name from its contents and have Spark fetch it to every executor."""
    name = f"urls-{hashlib.sha256(data).hexdigest()[:32]}.idx"
    uri = f"{shared_dir(spark)}/{name}"
    fs, path = filesystem(uri)
    with fs.open_output_stream(path) as out:
        out.write(data)
    spark.sparkContext.addFile(uri)
    return name


def oracle() -> str:
    """DuckDB SQL for ``filtered`` with the contract's rules."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH r(verdict, rhost, rpath) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM u),
m AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""
