"""Operators as table functions of SQL: polymorphic, with named and typed arguments that are checked when a query is analysed.

    register(spark)
    spark.sql("SELECT * FROM token_windows(TABLE(docs), column => 'text', size => 128, overlap => 16)")

Each gives the columns of its table but the text, and what it finds in it; a row's results depend on that row alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Fixed value: a word is a run of letters, digits and underscores, as ``text.WORDS`` has it.
_WORD = r"[\p{L}\p{N}_]+"
#: Fixed value: every line break that ``text.LINE_BREAKS`` knows.
_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _lines(text: str | None) -> list[str]:
    parts = re.split(_BREAKS, text or "")
    return parts[:-1] if parts[-1] == "" else parts


def _schema(rows: AnalyzeArgument, column: AnalyzeArgument, **more: DataType) -> StructType:
    """The columns of the result; ValueError where the table lacks the text, the text isn't one, or a new column's name is taken."""
    if not rows.isTable:
        raise ValueError("the first argument must be a table")
    name = constant(column, "column", str)
    types = {f.name: f for f in rows.dataType.fields}
    if name not in types:
        raise ValueError(f"the table has no column {name!r}: {list(types)}")
    if not isinstance(types[name].dataType, StringType):
        raise ValueError(f"the column {name!r} holds no text")
    out = StructType([f for f in rows.dataType.fields if f.name != name])
    for new, kind in more.items():
        if new in out.names:
            raise ValueError(f"the table has a column {new!r} already")
        out = out.add(new, kind)
    return out


def constant(argument: AnalyzeArgument, name: str, kind: type) -> object:
    """The value of an argument that must be a constant of a type."""
    if not argument.isConstantExpression or not isinstance(argument.value, kind) or isinstance(argument.value, bool):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


def _rest(row: Row, column: str) -> tuple:
    return tuple(v for k, v in row.asDict().items() if k != column)


class TokenWindows:
    """``window`` from 0 and ``words``, parted by blanks: as ``text.token_windows`` of the lower-cased words; a text without words has one empty window."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not 0 <= constant(overlap, "overlap", int) < constant(size, "size", int):
            raise ValueError("overlap must be 0 or more, and less than size")
        return AnalyzeResult(_schema(rows, column, window=IntegerType(), words=StringType()))

    def eval(self, rows: Row, column: str, size: int, overlap: int) -> Iterator[tuple]:
        import regex

        words = regex.findall(_WORD, (rows[column] or "").lower())
        starts = [0] if len(words) <= size else range(0, len(words), size - overlap)
        for i, a in enumerate(starts):
            yield (*_rest(rows, column), i, " ".join(words[a : a + size]))


class MatchingLines:
    """``line_no`` from 0 and ``line`` of the lines that a pattern finds something in."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        try:
            re.compile(constant(pattern, "pattern", str))
        except re.error as e:
            raise ValueError(f"pattern: {e}") from e
        return AnalyzeResult(_schema(rows, column, line_no=IntegerType(), line=StringType()))

    def eval(self, rows: Row, column: str, pattern: str) -> Iterator[tuple]:
        for i, line in enumerate(_lines(rows[column])):
            if re.search(pattern, line):
                yield (*_rest(rows, column), i, line)


class MarkdownSections:
    """``section, heading, body`` as ``chunk.markdown_sections`` has them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_schema(rows, column, section=IntegerType(), heading=StringType(), body=StringType()))

    def eval(self, rows: Row, column: str) -> Iterator[tuple]:
        section, heading, body = 0, "", []
        for line in [*_lines(rows[column]), None]:
            if line is None or line.startswith("#"):
                if heading or "\n".join(body):
                    yield (*_rest(rows, column), section, heading, "\n".join(body))
                section, heading, body = section + 1, (line or "").lstrip("# "), []
            else:
                body.append(line)


FUNCTIONS = {"token_windows": TokenWindows, "matching_lines": MatchingLines, "markdown_sections": MarkdownSections}


def register(spark: SparkSession) -> None:
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
