"""Pools of paper records: union, first-wins merge, venue ranks, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linkage import dedup_key, letpub_rank, local_rank, passes, rank_text, sjr_rank
from ..functions.text import missing

#: Fixed value: the fields that a later record may fill.
FILLED = ["pdf_url", "openalex_id", "arxiv_id", "venue", "issn"]


def unioned(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows, ``seq`` ordered by source before a row's own; fields that a source lacks are null."""
    rows = None
    for i, part in enumerate(sources):
        part = part.withColumn("seq", F.struct(F.lit(i).alias("source_no"), F.col("seq").alias("row_no")))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows


def deduplicated(papers: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each key: the first record, its empty FILLED fields from the first later record that has them.

    An aggregation by ``min_by``, so equal keys combine before the shuffle and no group is sorted.
    """
    keyed = papers.withColumn("dedup_key", dedup_key("doi", "arxiv_id", "title"))
    plain = [c for c in papers.columns if c not in FILLED and c != seq]
    first = [F.min_by(F.col(c), F.col(seq)).alias(c) for c in plain]
    filled = [F.min_by(missing(c), F.when(missing(c).isNotNull(), F.col(seq))).alias(c) for c in FILLED if c in papers.columns]
    return keyed.groupBy("dedup_key").agg(F.min(seq).alias(seq), F.count("*").alias("n_records"), *first, *filled)


def ranked_venues(papers: DataFrame, venue: str = "venue", letpub: str | None = None, sjr: str | None = None) -> DataFrame:
    """``papers`` with ``rank, rank_source, passed, rank_text``: from the table of venues, else the pages given; unknown never passes."""
    tries = [("local", local_rank(venue))]
    tries += [("letpub", letpub_rank(letpub))] if letpub else []
    tries += [("sjr", sjr_rank(sjr, venue))] if sjr else []
    source = F.lit("none")
    for name, rank in reversed(tries):
        source = F.when(rank.isNotNull(), F.lit(name)).otherwise(source)
    rows = papers.withColumn("rank", F.coalesce(*(r for _, r in tries))).withColumn("rank_source", source)
    return rows.withColumn("passed", passes("rank")).withColumn("rank_text", rank_text("rank"))


def reviewed(papers: DataFrame, least_year: int | None = None, ranked: bool = False) -> DataFrame:
    """``papers`` with ``failed`` (what speaks against them: year, rank, download) and ``decision``.

    With a least year an unknown year fails; a rank is asked for only if ``ranked``, and then an unknown one (``passed`` false or null) fails.
    A paper can be downloaded by its ``pdf_url`` or if it says so.
    """
    no = F.lit(False)
    bad = {
        "year": ~F.coalesce(F.col("year") >= least_year, no) if least_year is not None else no,
        "rank": ~F.coalesce(F.col("passed"), no) if ranked else no,
        "download": missing("pdf_url").isNull() & ~F.coalesce(F.col("downloadable"), no),
    }
    failed = F.array_compact(F.array(*(F.when(is_bad, F.lit(name)) for name, is_bad in bad.items())))
    return papers.withColumn("failed", failed).withColumn("decision", F.when(F.size("failed") == 0, "pass").otherwise("fail"))


def consistent_reviews(reviews: DataFrame, kind: str = "note") -> DataFrame:
    """``review_id, consistent``. A note passes just if nothing blocks; a download passes just if an item does, and may fail without items.

    ``reviews(review_id, verdict, severity)`` or ``(review_id, verdict, decision)`` has a row an issue or item, one of nulls if there is none.
    """
    mark = F.col("severity") == "blocking" if kind == "note" else F.col("decision") == "pass"
    some = F.coalesce(F.bool_or(F.coalesce(mark, F.lit(False))), F.lit(False))
    rows = reviews.groupBy("review_id").agg(F.first("verdict").alias("verdict"), some.alias("some"))
    good = ~F.col("some") if kind == "note" else F.col("some")
    return rows.select("review_id", ((F.col("verdict") == "pass") == good).alias("consistent"))
