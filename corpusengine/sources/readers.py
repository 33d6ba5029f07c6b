"""Python data sources: vaults of notes and feeds of papers, as tables in batches and as streams, with filters that reach the listing.

    register(spark)
    spark.read.format("vault").option("path", root).load().where("path LIKE 'inbox/%'")
    spark.readStream.format("feed").option("path", root).option("records", "works").load()

Folders may lie in any file system that Arrow knows by its address. Files are listed on the driver, names, times and sizes only, and read by the tasks.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from . import papers
from .files import DENIED

#: Bytes of files that one task reads, and what a file counts besides its own; records in a batch.
PACK, FILE, BATCH = 32_000_000, 4_096, 1_000
#: Fixed value: the element of an entry.
ENTRY = "{http://www.w3.org/2005/Atom}entry"


@dataclass(frozen=True)
class File:
    path: str
    mtime: int  # microseconds
    length: int


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    files: list[File]

    def __init__(self, files: list[File]) -> None:
        self.files = files


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    address = root if "://" in root else f"file://{root.removeprefix('file:')}"
    return arrow_fs.FileSystem.from_uri(address.rstrip("/"))


def listed(root: str, suffixes: tuple[str, ...]) -> list[File]:
    """Files below a root with one of the suffixes (any case), by path from there; denied folders are left out."""
    system, base = opened(root)
    found = system.get_file_info(arrow_fs.FileSelector(base, recursive=True, allow_not_found=True))
    names = ((f, posixpath.relpath(f.path, base)) for f in found if f.type == arrow_fs.FileType.File)
    rows = [File(name, f.mtime_ns // 1000, f.size) for f, name in names if name.lower().endswith(suffixes) and not set(name.split("/")) & set(DENIED)]
    return sorted(rows, key=lambda f: f.path)


def packs(files: list[File]) -> list[Files]:
    """Files in runs of about PACK bytes; one file at least."""
    out: list[list[File]] = []
    room = 0
    for f in files:
        if not out or f.length + FILE > room:
            out.append([])
            room = PACK
        out[-1].append(f)
        room -= f.length + FILE
    return [Files(x) for x in out]


def _micros(value: object) -> int | None:
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=UTC)
        return round(at.timestamp() * 1e6)
    return None


class _Source(DataSource):
    """Options: ``path``, the root folder; ``suffixes``, parted by commas."""

    suffixes = ".md"

    @property
    def root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return self.options["path"]

    @property
    def ends(self) -> tuple[str, ...]:
        return tuple(x.strip().lower() for x in self.options.get("suffixes", self.suffixes).split(","))

    def rows(self, file: File, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return Stream(self)


class VaultSource(_Source):
    """A row a file: ``path`` from the root, ``mtime``, ``length``, ``text`` as UTF-8 with malformed bytes replaced."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, mtime timestamp, length long, text string"

    def rows(self, file: File, data: bytes) -> Iterator[tuple]:
        yield file.path, file.mtime, file.length, data.decode("utf-8", "replace")


class FeedSource(_Source):
    """A row a record: ``path, mtime, seq, record, error``. The option ``records`` is ``entries`` (Atom, as XML) or ``works`` (JSON: a line each, or a list ``results``).

    A record is text that ``papers.atom_papers`` or ``papers.work_papers`` reads. A file that can't be read has one row with the error.
    """

    suffixes = ".xml,.json,.jsonl,.txt"

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "path string, mtime timestamp, seq int, record string, error string"

    def rows(self, file: File, data: bytes) -> Iterator[tuple]:
        try:
            for i, record in enumerate(entries(data) if self.options.get("records", "entries") == "entries" else works(data)):
                yield file.path, file.mtime, i, record, None
        except (ElementTree.ParseError, ValueError) as e:
            yield file.path, file.mtime, None, None, str(e)


def entries(data: bytes) -> list[str]:
    """The entries of an Atom feed, each as XML without name spaces."""
    out = []
    for entry in ElementTree.fromstring(data).iter(ENTRY):
        for e in entry.iter():
            e.tag = e.tag.rpartition("}")[2]
        out.append(ElementTree.tostring(entry, encoding="unicode").strip())
    return out


def works(data: bytes) -> list[str]:
    """The records of an answer with ``results``, or the lines of a file that aren't empty."""
    text = data.decode("utf-8")
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) == 1 or (lines and lines[0].strip() == "{"):
        whole = json.loads(text)
        if "results" in whole:
            return [json.dumps(w, ensure_ascii=False) for w in whole["results"]]
    return lines


def _read(source: _Source, files: list[File]) -> Iterator[pa.RecordBatch]:
    system, base = opened(source.root)
    kinds = {"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "int": pa.int32()}
    columns = [c.split() for c in source.schema().split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in columns])
    held: list[tuple] = []
    size = 0
    for file in files:
        with system.open_input_stream(f"{base}/{file.path}") as f:
            data = f.read()
        for row in source.rows(file, data):
            held.append(row)
            size += len(data)
            if len(held) >= BATCH or size >= PACK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class Reader(DataSourceReader):
    """All files of a source; filters on paths, times and lengths leave files out before they are read."""

    def __init__(self, source: _Source) -> None:
        self.source, self.tests = source, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column in ("path", "mtime", "length") and isinstance(f, IsNotNull):
                continue  # they never are
            if column == "path" and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
                self.tests.append((type(f).__name__, "path", value))
            elif column in ("mtime", "length") and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo) and (column == "length" and "length" in self.source.schema() or _micros(value) is not None):
                self.tests.append((type(f).__name__, column, value if column == "length" else _micros(value)))
            else:
                yield f

    def wanted(self, file: File) -> bool:
        made = {
            "EqualTo": lambda a, b: a == b, "In": lambda a, b: a in b, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith,
            "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b,
        }
        return all(made[kind](getattr(file, column), value) for kind, column, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        # a source without files still has a partition, as none isn't allowed
        return packs([f for f in listed(self.source.root, self.source.ends) if self.wanted(f)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.source, partition.files)


class Stream(DataSourceStreamReader):
    """Files in the order of time and path: a batch has those after the last one of the batch before. A file that is changed comes again.

    Files that appear with a time before those that were read aren't seen; ``operators.sync.snapshot_diff`` of a listing finds them.
    """

    def __init__(self, source: _Source) -> None:
        self.source = source

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((f.mtime, f.path) for f in listed(self.source.root, self.source.ends)), default=(-1, ""))
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["mtime"], o["path"]) for o in (start, end))
        return packs([f for f in listed(self.source.root, self.source.ends) if low < (f.mtime, f.path) <= high]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.source, partition.files)


#: Readers of papers by the name of the feed: what the source is told, and how its records become papers.
READERS = {"arxiv": ("entries", papers.atom_papers, "xml"), "openalex": ("works", papers.work_papers, "json")}


def register(spark: SparkSession) -> None:
    """Makes ``vault`` and ``feed`` known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VaultSource, FeedSource):
        spark.dataSource.register(source)


def read_papers(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """Papers of all files of a feed that READERS names; ``seq`` is the path and the place in the file."""
    if feed not in READERS:
        raise ValueError(f"feed {feed!r} is none of {sorted(READERS)}")
    records, parsed, column = READERS[feed]
    register(spark)
    rows = spark.read.format("feed").option("path", path).option("records", records).load().where("error is null")
    return parsed(rows.selectExpr("struct(path, seq AS place) AS seq", f"record AS {column}"))
