"""Keys and lookups that link records: titles, papers, venues and their ranks, result pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, missing, py_strip

# Venue prefixes in the order of stripping, aliases, ranks and the values that pass.
NOISE = ["proceedingsoftheacm", "proceedingsofthe", "theacm", "internationalconferenceon", "conferenceon", "annualmeetingof", "the"]
ALIASES = {"webconference": "www", "tpami": "ieeetransactionsonpatternanalysisandmachineintelligence"}
VENUES = {
    "www": ("A", None, None), "kdd": ("A", None, None), "neurips": ("A", None, None), "icml": ("A", None, None), "iclr": ("A", None, None),
    "acl": ("A", None, None), "cvpr": ("A", None, None), "iccv": ("A", None, None), "nips": ("A", None, None), "aaai": ("B", None, None),
    "ijcai": ("B", None, None), "sigir": ("B", None, None), "emnlp": ("B", None, None), "naacl": ("B", None, None), "icde": ("A", None, None),
    "sigmod": ("A", None, None), "vldb": ("A", None, None),
    "ieeetransactionsonpatternanalysisandmachineintelligence": (None, "Q1", "一区"), "ieeetransactionsonknowledgeanddataengineering": (None, "Q1", "一区"),
    "acmtransactionsoninformationsystems": (None, "Q1", "二区"), "ieeetransactionsonneuralnetworksandlearningsystems": (None, "Q1", "一区"),
}
RANK = "struct<ccf:string,jcr:string,cas:string>"
SJR_WINDOW = 500


def norm_title(title: str | Column) -> Column:
    """Lower-cased without what is neither letter, digit nor underscore."""
    return F.lower(F.regexp_replace(F.coalesce(_c(title), F.lit("")), r"(?U)[^\w]", ""))


def dedup_key(doi: str | Column, arxiv_id: str | Column, title: str | Column) -> Column:
    """By DOI, else arXiv id, else title. A record with one and its double with the other keep different keys."""
    return F.coalesce(F.concat(F.lit("doi:"), missing(doi)), F.concat(F.lit("arxiv:"), missing(arxiv_id)), F.concat(F.lit("title:"), norm_title(title)))


def norm_venue(name: str | Column) -> Column:
    """ASCII letters and digits, each noise prefix stripped once in turn, aliases resolved."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(name), F.lit(""))), "[^a-z0-9]", "")
    for word in NOISE:
        s = F.regexp_replace(s, f"^{word}", "")
    aliases = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(aliases, s), s)


def local_rank(name: str | Column) -> Column:
    """The rank that the table of venues has, else null."""
    rank = lambda v: F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("ccf", "jcr", "cas"), v, strict=True)))
    table = F.create_map(*(x for k, v in VENUES.items() for x in (F.lit(k), rank(v))))
    return F.try_element_at(table, norm_venue(name))


def passes(rank: str | Column) -> Column:
    """JCR Q1 or Q2, CAS 一区 or 二区, or CCF A or B; unknown never passes."""
    rank = _c(rank)
    some = rank["jcr"].isin("Q1", "Q2"), rank["cas"].isin("一区", "二区"), rank["ccf"].isin("A", "B")
    return F.coalesce(some[0], F.lit(False)) | F.coalesce(some[1], F.lit(False)) | F.coalesce(some[2], F.lit(False))


def letpub_rank(html: str | Column) -> Column:
    """Of the first table row whose fourth cell has a zone, that zone; null if there is none."""
    rows = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda r: F.try_element_at(F.regexp_extract_all(r, F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), F.lit(4))
    zones = F.filter(F.transform(rows, lambda r: F.regexp_extract(F.coalesce(cell(r), F.lit("")), "([1-4]|[一二三四])区", 1)), lambda z: z != "")
    cas = F.concat(F.translate(F.try_element_at(zones, F.lit(1)), "1234", "一二三四"), F.lit("区"))
    return F.when(cas.isNotNull(), F.struct(F.lit(None).cast("string").alias("ccf"), F.lit(None).cast("string").alias("jcr"), cas.alias("cas")))


def sjr_rank(html: str | Column, venue: str | Column) -> Column:
    """The first quartile from the venue's name to 500 letters and digits after it; null without the name or a quartile."""
    norm = lambda x: F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]", "")
    page, name = norm(html), norm(venue)
    at = F.instr(page, name)
    found = F.regexp_extract(F.substr(page, at, F.length(name) + SJR_WINDOW), "q([1-4])", 1)
    jcr = F.when((name != "") & (at > 0) & (found != ""), F.concat(F.lit("Q"), found))
    return F.when(jcr.isNotNull(), F.struct(F.lit(None).cast("string").alias("ccf"), jcr.alias("jcr"), F.lit(None).cast("string").alias("cas")))


def title_of(search: str | Column, parsed: str | Column, embedded: str | Column, spans: str | Column) -> Column:
    """``(title, source)`` from the first that has one: search results, the parsed paper, its metadata, or the highest of the largest ``spans(text, size, y)``."""
    ordered = F.array_sort(F.transform(_c(spans), lambda s: F.struct((-s["size"]).alias("size"), s["y"].alias("y"), s["text"].alias("text"))))
    tries = {"search": missing(search), "grobid": missing(parsed), "pdftitle": missing(embedded), "pymupdf": missing(py_strip(F.try_element_at(ordered, F.lit(1))["text"]))}
    source = F.lit("")
    for name, title in reversed(tries.items()):
        source = F.when(title.isNotNull(), F.lit(name)).otherwise(source)
    return F.struct(F.coalesce(*tries.values(), F.lit("")).alias("title"), source.alias("source"))


def rank_text(rank: str | Column) -> Column:
    """``CCF-A；JCR-Q1`` of the values there are, 无 if there are none."""
    rank = _c(rank)
    shown = F.concat_ws("；", *(F.concat(F.lit(f"{n.upper()}-"), rank[n]) for n in ("ccf", "jcr", "cas")))
    return F.when(shown == "", F.lit("无")).otherwise(shown)
