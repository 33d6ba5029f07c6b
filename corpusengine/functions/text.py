"""Text primitives that keep the semantics of Python strings inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every line break that Python's ``str.splitlines`` knows.
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Fixed value: what ``(?U)\\s`` matches.
BLANKS = "\t\n\u000b\u000c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORDS = r"[\p{L}\p{N}_]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_lines(text: str | Column) -> Column:
    """``splitlines``: all Unicode line breaks, no empty line after a last break, none for an empty text."""
    parts = F.split(_c(text), LINE_BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def py_strip(text: str | Column) -> Column:
    """``strip``: all Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def squeezed(text: str | Column) -> Column:
    """``" ".join(text.split())``."""
    return F.regexp_replace(py_strip(text), r"(?U)\s+", " ")


def tokens(text: str | Column, lower: bool = True, segment: Callable[[Column], Column] | None = None) -> Column:
    """Runs of letters, digits and underscores in order; retrieval folds case, routing doesn't. ``segment`` cuts those that are written without blanks."""
    col = F.coalesce(_c(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(col) if lower else col, F.lit(WORDS), F.lit(0))
    return words if segment is None else segment(words)


def missing(value: str | Column) -> Column:
    """Null for what Python calls false: null and the empty string."""
    return F.nullif(_c(value), F.lit(""))


def token_windows(words: str | Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of ``size`` words every ``size - overlap``, the first alone if it holds all; a tail inside the one before it is kept."""
    words, stride = _c(words), max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(stride))
    many = F.transform(starts, lambda i: F.slice(words, i + 1, size))
    return F.when(F.size(words) <= size, F.array(words)).otherwise(many)


def repetition_ratio(text: str | Column) -> Column:
    """One less the share of distinct lines among stripped lines that aren't empty; 0 below 100 characters."""

    def ratio(lines: Column) -> Column:
        return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines))

    lines = F.filter(F.transform(py_lines(text), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    # bound by a lambda, the lines are made once
    return F.when(F.length(_c(text)) < 100, F.lit(0.0)).otherwise(F.element_at(F.transform(F.array(lines), ratio), 1))
