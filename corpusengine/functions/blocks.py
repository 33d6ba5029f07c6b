"""Edits of text blocks, fingerprints, redaction and rendering."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, py_lines, py_strip, squeezed

# Keys whose values are masked, the first that matches, and what marks a path in a task.
REDACTED = [("(?i)api_key|token|password|secret", "***"), ("(?i)content|text|abstract|full_text|body", "HIDDEN")]
TASK_PATH = "(?<![A-Za-z0-9_])/[^\\s，,;:。（）\"']+"
#: Rounds of questions after which a query is dispatched as it is.
ROUNDS = 2


def replaced_once(value: str | Column, old: str | Column, new: str | Column) -> Column:
    """The value with its one occurrence of ``old`` replaced; null if there is none or are several."""
    value, old, new = _c(value), _c(old), _c(new)
    times = (F.length(value) - F.length(F.replace(value, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & (times == 1), F.replace(value, old, new))


def line_inserted(value: str | Column, line: str | Column, at: int | Column) -> Column:
    """A line inserted before line ``at`` (from 0), at the end for -1 or beyond it."""
    lines, at = py_lines(value), F.lit(at) if isinstance(at, int) else at
    lines = F.when(F.length(_c(value)) == 0, F.array().cast("array<string>")).otherwise(lines)
    place = F.when((at < 0) | (at > F.size(lines)), F.size(lines)).otherwise(at)
    return F.array_join(F.concat(F.slice(lines, F.lit(1), place), F.array(_c(line)), F.slice(lines, place + 1, F.size(lines))), "\n")


def patched(value: str | Column, patch: str | Column) -> Column:
    """The value with a lenient unified diff applied, or null where it doesn't fit, or where the patch is one of several blocks.

    A header moves on to its line; a context line must stand right where it is said to; a removed line is the next one that equals it,
    and what lies before it is kept; added lines go in at that point; other lines of the patch say nothing.
    """
    lines = py_lines(F.coalesce(_c(value), F.lit("")))
    state = "struct<at:int,out:array<string>,bad:boolean>"
    made = lambda at, out, bad: F.struct(at.cast("int").alias("at"), out.alias("out"), bad.alias("bad")).cast(state)

    def step(s: Column, p: Column) -> Column:
        at, rest = s["at"], F.substring(p, 2, 1 << 30)
        ahead = F.slice(lines, at + 1, F.size(lines))
        target = F.regexp_extract(p, r"^@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@", 1).try_cast("int") - 1
        skip = F.greatest(F.lit(0), F.least(target, F.size(lines)) - at)
        found = F.array_position(ahead, rest).cast("int")
        fits = F.coalesce(F.try_element_at(ahead, F.lit(1)) == rest, F.lit(False))
        moved = F.when(target.isNotNull(), made(at + skip, F.concat(s["out"], F.slice(ahead, F.lit(1), skip)), s["bad"])).otherwise(s)
        kept = made(at + 1, F.concat(s["out"], F.array(rest)), s["bad"] | ~fits)
        removed = made(at + found, F.concat(s["out"], F.slice(ahead, F.lit(1), F.greatest(found - 1, F.lit(0)))), s["bad"] | (found == 0))
        added = made(at, F.concat(s["out"], F.array(rest)), s["bad"])
        first = F.substring(p, 1, 1)
        return F.when(F.startswith(p, F.lit("@@")), moved).when(first == " ", kept).when(first == "-", removed).when(first == "+", added).otherwise(s)

    start = made(F.lit(0), F.array().cast("array<string>"), F.lit(False))
    end = lambda s: F.when(~s["bad"], F.array_join(F.concat(s["out"], F.slice(lines, s["at"] + 1, F.size(lines))), "\n"))
    several = F.coalesce(F.contains(_c(patch), F.lit("*** Add Block:")) | F.contains(_c(patch), F.lit("*** Update Block:")), F.lit(False))
    return F.when(~several, F.aggregate(py_lines(F.coalesce(_c(patch), F.lit(""))), start, step, end))


def unified_diff(old: str | Column, new: str | Column, name: str = "old", new_name: str = "new") -> Column:
    """The unified diff of two texts with three lines of context; "" if they are equal. Null is an empty text."""

    @F.pandas_udf("string")
    def diff(olds: pd.Series, news: pd.Series) -> pd.Series:
        pairs = zip(olds.fillna(""), news.fillna(""), strict=True)
        return pd.Series(["\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), name, new_name, lineterm="")) for a, b in pairs], dtype=object)

    return diff(_c(old), _c(new))


def truncated_lines(text: str | Column, most: int = 200) -> Column:
    """The first lines of a text, and how many more there are."""
    lines = py_lines(text)
    more = F.concat(F.lit("… +"), (F.size(lines) - most).cast("string"), F.lit(" lines"))
    return F.when(F.size(lines) <= most, _c(text)).otherwise(F.array_join(F.concat(F.slice(lines, 1, most), F.array(more)), "\n"))


def line_appended(value: str | Column, line: str | Column) -> Column:
    value = py_strip(F.coalesce(_c(value), F.lit("")))
    return F.when(value == "", _c(line)).otherwise(F.concat(value, F.lit("\n"), _c(line)))


def lines_removed(value: str | Column, key: str | Column) -> Column:
    """The lines that aren't blank and don't begin with ``- key``; null for a blank key or if none does."""
    key = _c(key)
    lines = F.filter(py_lines(value), lambda x: py_strip(x) != "")
    kept = F.filter(lines, lambda x: ~F.startswith(x, F.concat(F.lit("- "), key)))
    return F.when((py_strip(key) != "") & (F.size(kept) < F.size(lines)), F.array_join(kept, "\n"))


def history_line(at: str | Column, action: str | Column, title: str | Column) -> Column:
    return F.concat(F.lit("["), F.date_format(_c(at), "yyyy-MM-dd HH:mm"), F.lit("] "), _c(action), F.lit("《"), _c(title), F.lit("》"))


def unread_line(title: str | Column, source: str | Column) -> Column:
    return F.concat(F.lit("- "), _c(title), F.lit(" ("), _c(source), F.lit(")"))


def front_matter_stripped(text: str | Column) -> Column:
    """What follows the second ``---`` of a text that begins with one, without line feeds at its ends; else the text."""
    text = _c(text)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^---.*?---", ""), r"^\n+|\n+$", "")
    return F.when(text.rlike(r"(?s)^---.*?---"), body).otherwise(text)


def front_matter_field(text: str | Column, key: str) -> Column:
    return py_strip(F.regexp_extract(_c(text), rf"(?m)^{key}:[^\S\r\n]*([^\r\n]*?)[^\S\r\n]*$", 1))


def redacted(params: str | Column) -> Column:
    """A map of parameters with secrets and contents masked by key."""

    def masked(k: Column, v: Column) -> Column:
        out = v
        for pattern, mask in reversed(REDACTED):
            out = F.when(k.rlike(pattern), F.lit(mask)).otherwise(out)
        return out

    return F.transform_values(_c(params), masked)


def task_fingerprint(task: str | Column, mode: str | Column) -> Column:
    text = F.concat(F.coalesce(_c(mode), F.lit("")), F.lit("\n"), squeezed(task))
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def task_has_path(task: str | Column) -> Column:
    return _c(task).rlike(TASK_PATH)


def chunk_id(path: str | Column, index: str | Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(_c(path), F.lit(":"), _c(index).cast("string")), "UTF-8")), 1, 16)


def relative_path(path: str | Column, roots: list[str]) -> Column:
    """The path below the first root that holds it, else null."""
    path, out = _c(path), F.lit(None).cast("string")
    for root in reversed([r.rstrip("/") + "/" for r in roots]):
        out = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(out)
    return out


def denied_path(path: str | Column, segments: list[str]) -> Column:
    """Whether a segment of the path is on the list, in any case."""
    return F.arrays_overlap(F.split(F.lower(_c(path)), "/"), F.array(*(F.lit(s.lower()) for s in segments)))


def compacted(value: str | Column) -> Column:
    """One line: whole up to 40 characters, head and tail up to 120, beyond that with the number of characters."""
    s = F.replace(_c(value), F.lit("\n"), F.lit(" "))
    n = F.length(s)
    tail = lambda k: F.substr(s, n - (k - 1), F.lit(k))
    long = F.concat(F.substring(s, 1, 40), F.lit("…("), n.cast("string"), F.lit(" chars)…"), tail(20))
    return F.when(n <= 40, s).when(n <= 120, F.concat(F.substring(s, 1, 35), F.lit("…"), tail(10))).otherwise(long)


def json_body(text: str | Column) -> Column:
    """From the first ``{`` to the last ``}`` of the first fenced block, or of the text if none is fenced."""
    text = _c(text)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.nullif(F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0), F.lit(""))


def arxiv_query(text: str | Column) -> Column:
    words = F.filter(F.split(squeezed(text), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("all:"), w)), " AND ")


def clamped(n: str | Column, low: int = 3, high: int = 50) -> Column:
    return F.least(F.greatest(F.lit(low), _c(n)), F.lit(high))


def clarified(original: str | Column, answer: str | Column) -> Column:
    return F.concat(_c(original), F.lit("（用户澄清："), _c(answer), F.lit("）"))


def pending(original: str | Column, rounds: str | Column, answer: str | Column, most: int = ROUNDS) -> Column:
    """``(query, forced)`` of an answer to a question that may be pending: merged with the original, or from the last round on the original alone, to be dispatched as it is.

    Without an original nothing is pending, and the query is the answer.
    """
    original, answer = _c(original), _c(answer)
    waits, over = original.isNotNull(), F.coalesce(_c(rounds) >= most, F.lit(False))
    query = F.when(waits & over, original).when(waits, clarified(original, answer)).otherwise(answer)
    return F.struct(query.alias("query"), (waits & over).alias("forced"))
