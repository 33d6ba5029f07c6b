"""Words of texts that are written without blanks: a lexicon, a lattice of its words over a run of characters, and the cheapest path.

The lexicon is given, as a table of words and how often each is used; nothing is learned here. Costs are whole thousandths of a natural
logarithm, so that paths compare exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scripts whose words follow each other without blanks, as Java's regular expressions name them.
CONTINUOUS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: The most words that are sent to all tasks; of a larger table the most frequent are taken, ties by the word.
LEXICON = 500_000


@dataclass(frozen=True)
class Lexicon:
    """Costs of words, the length of the longest, and what a character costs that is no word."""

    costs: dict[str, int]
    longest: int
    unknown: int

    @classmethod
    def of(cls, counts: Iterable[tuple[str, int]]) -> Lexicon:
        """From words and their counts: floor(1000 ln(total / count)); an unknown character costs as a word seen once, and one more natural unit."""
        counts = [(w, int(n)) for w, n in counts if w and n and n > 0]
        total = sum(n for _, n in counts)
        costs = {w: math.floor(1000 * math.log(total / n)) for w, n in counts}
        return cls(costs, max(map(len, costs), default=0), math.floor(1000 * math.log(max(total, 1))) + 1000)

    def path(self, text: str) -> list[str]:
        """The words of the cheapest cut of a text; of equal ones the one whose last words are longest, from the end on."""
        best, last = [0], [0]
        for end in range(1, len(text) + 1):
            cost, length = best[end - 1] + self.costs.get(text[end - 1], self.unknown), 1
            for n in range(2, min(self.longest, end) + 1):
                word = self.costs.get(text[end - n : end])
                if word is not None and best[end - n] + word <= cost:
                    cost, length = best[end - n] + word, n
            best.append(cost)
            last.append(length)
        out, end = [], len(text)
        while end:
            out.append(text[end - last[end] : end])
            end -= last[end]
        return out[::-1]

    def cost(self, words: Iterable[str]) -> int:
        return sum(self.costs.get(w, self.unknown) for w in words)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, count`` of dictionary files with a word, its count and perhaps more on each line, parted by blanks; other lines are left out."""
    parts = F.split("value", r"\s+")
    rows = spark.read.text(path).select(parts[0].alias("word"), F.get(parts, 1).try_cast("long").alias("count"))
    return rows.where("word <> '' AND count > 0")


def lexicon(words: DataFrame, most: int = LEXICON) -> Lexicon:
    """The lexicon of a table ``word, count``, collected within the bound; counts of a repeated word are added."""
    summed = words.where("word <> ''").groupBy("word").agg(F.sum("count").alias("count"))
    return Lexicon.of(summed.orderBy(F.desc("count"), "word").limit(most).toLocalIterator())


def segmenter(spark: SparkSession, words: Lexicon, script: str = CONTINUOUS) -> Callable[[Column], Column]:
    """A function of columns for ``tokens``: each word of an array is cut where it is written in the scripts given; the rest of it stays whole.

    Only arrays that hold such characters go to Python, in Arrow batches; the lexicon is broadcast once.
    """
    import regex

    sent = spark.sparkContext.broadcast(words)
    kinds = script.replace(r"\p{Is", r"\p{")

    @F.pandas_udf("array<string>")
    def cut(arrays: pd.Series) -> pd.Series:
        runs = regex.compile(f"{kinds}+|(?:(?!{kinds}).)+", regex.DOTALL)
        continuous, known = regex.compile(kinds), sent.value
        parts = lambda w: [None] if w is None else [p for run in runs.findall(w) for p in (known.path(run) if continuous.match(run) else [run])]
        return pd.Series([None if a is None else [p for w in a for p in parts(w)] for a in arrays], dtype=object)

    def apply(array: Column) -> Column:
        return F.coalesce(cut(F.when(F.exists(array, lambda w: F.regexp_like(w, F.lit(script))), array)), array)

    return apply
