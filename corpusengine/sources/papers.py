"""Paper records from feeds that were fetched elsewhere: Atom entries, works as JSON, TEI documents; routes from YAML."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeezed

#: The fields that are read of a work and of an entry, and where papers of the preprint server lie.
WORK = (
    "struct<id:string,doi:string,display_name:string,publication_year:int,cited_by_count:int,primary_location:struct<source:struct<display_name:string,"
    "issn:array<string>,type:string>>,best_oa_location:struct<pdf_url:string>,_malformed:string>"
)
ATOM = "struct<id:string,title:string,published:string,summary:string>"
PDF_AT = "https://arxiv.org/pdf/"
NAMESPACE = "{http://www.tei-c.org/ns/1.0}"
_PARSED = "struct<error:string,sections:array<struct<heading:string,body:string>>,tables:array<string>,figures:array<string>>"


def atom_papers(entries: DataFrame, xml: str = "xml") -> DataFrame:
    """``seq, title, arxiv_id, published, year, abstract, pdf_url, venue, issn, downloadable`` from one Atom entry a row.

    The id is what follows the last ``/abs/``, or all of it, and names the paper's address; all are downloadable. Fields that an entry lacks are empty,
    a year that can't be read is null. Malformed entries are left out.
    """
    rows = entries.select("seq", F.from_xml(F.col(xml), ATOM, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null and (e.id is not null or e.title is not null)")
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    paper = F.element_at(F.split(text("id"), "/abs/"), -1)
    year = F.when(F.length(text("published")) >= 4, F.substring(text("published"), 1, 4).try_cast("int"))
    none = F.lit(None).cast("string")
    return rows.select(
        "seq", squeezed(text("title")).alias("title"), paper.alias("arxiv_id"), text("published").alias("published"), year.alias("year"), squeezed(text("summary")).alias("abstract"),
        F.concat(F.lit(PDF_AT), paper).alias("pdf_url"), none.alias("venue"), none.alias("issn"), F.lit(True).alias("downloadable"),
    )


def work_papers(works: DataFrame, json: str = "json") -> DataFrame:
    """``seq, title, doi, openalex_id, year, venue, issn, venue_type, pdf_url, downloadable, cited_by_count`` from one work a row.

    A work is downloadable if its best open location has an address. The DOI stays as it is given. Malformed records are left out.
    """
    rows = works.select("seq", F.from_json(F.col(json), WORK, {"columnNameOfCorruptRecord": "_malformed"}).alias("w")).where("w is not null and w._malformed is null")
    pdf, source = F.col("w.best_oa_location.pdf_url"), "w.primary_location.source"
    return rows.select(
        "seq", F.coalesce("w.display_name", F.lit("")).alias("title"), F.col("w.doi").alias("doi"), F.coalesce("w.id", F.lit("")).alias("openalex_id"), F.col("w.publication_year").alias("year"),
        F.col(f"{source}.display_name").alias("venue"), F.try_element_at(f"{source}.issn", F.lit(1)).alias("issn"), F.col(f"{source}.type").alias("venue_type"),
        pdf.alias("pdf_url"), F.coalesce(pdf != "", F.lit(False)).alias("downloadable"), F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by_count"),
    )


def _parts_of(xml: str | None) -> dict | None:
    """Of a TEI document the sections, tables and figures of every division, in the order in which divisions begin; or what is wrong with it."""
    if xml is None:
        return None
    found: dict = {"error": None, "sections": [], "tables": [], "figures": []}
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return found | {"error": str(e)}
    for div in root.iter(f"{NAMESPACE}div"):
        own = {"head": [], "p": [], "table": [], "figure": []}
        for child in div:
            if child.tag.startswith(NAMESPACE) and child.tag.removeprefix(NAMESPACE) in own:
                own[child.tag.removeprefix(NAMESPACE)].append(child)
        if own["p"]:
            heading = own["head"][0].text if own["head"] and own["head"][0].text else div.get("type", "")
            found["sections"].append({"heading": heading, "body": "\n".join(p.text or "" for p in own["p"])})
        found["tables"] += ["".join(t.itertext()) for t in own["table"]]
        captions = (next(f.iter(f"{NAMESPACE}figDesc"), None) for f in own["figure"])
        found["figures"] += ["" if c is None else c.text or "" for c in captions]
    return found


def tei_parsed(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``key, error, sections, tables, figures`` of each document: a malformed one has the parser's message and no parts, a null one nothing."""

    @F.pandas_udf(_PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        found = [_parts_of(t) or {} for t in texts]
        return pd.DataFrame({c: pd.Series([f.get(c) for f in found], dtype=object) for c in ("error", "sections", "tables", "figures")})

    return docs.select(key, parsed(xml).alias("_p")).select(key, "_p.*")


def tei_sections(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``key, section, heading, body``: of each division that has paragraphs its head, else its type, and their leading texts joined by line feeds."""
    rows = tei_parsed(docs, key, xml).select(key, F.posexplode("sections").alias("section", "_s"))
    return rows.select(key, "section", F.coalesce("_s.heading", F.lit("")).alias("heading"), "_s.body")


def tei_parts(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``key, kind, part, text``: the whole text of divisions' tables, and the captions of their figures ("" if there is none)."""
    rows = tei_parsed(docs, key, xml).select(key, F.explode(F.array(F.struct(F.lit("table").alias("kind"), F.col("tables").alias("t")), F.struct(F.lit("figure").alias("kind"), F.col("figures").alias("t")))).alias("_k"))
    return rows.select(key, "_k.kind", F.posexplode("_k.t").alias("part", "text"))


def eval_set(spark: SparkSession, path: str, known: list[str] | None = None) -> DataFrame:
    """``query, intent, hard, seq`` from a YAML file of examples, which is small by its nature; ValueError where an intent is unknown."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)["eval"]
    for e in found:
        if known is not None and e["intent"] not in known:
            raise ValueError(f"intent {e['intent']!r} is unknown")
    return spark.createDataFrame([(e["query"], e["intent"], bool(e.get("hard", False)), i) for i, e in enumerate(found)], "query string, intent string, hard boolean, seq int")


def save_thresholds(path: str, thresholds: DataFrame) -> None:
    """Write ``thresholds(name, threshold)`` into the YAML file of routes that has them; nulls are left out, all else stays as it is."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    new = {r["name"]: r["threshold"] for r in thresholds.join(thresholds.sparkSession.createDataFrame([(r["name"],) for r in data["routes"]], "name string"), "name", "left_semi").collect()}
    for r in data["routes"]:
        r.pop("score_threshold", None) if r["name"] in new else None
        r |= {"score_threshold": new[r["name"]]} if new.get(r["name"]) is not None else {}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, allow_unicode=True, sort_keys=False)


def routes(spark: SparkSession, path: str, known: list[str] | None = None) -> DataFrame:
    """``name, utterance, seq, score_threshold`` from a YAML file of routes, which is small by its nature; ValueError where a name is unknown or has no utterances."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)["routes"]
    for r in found:
        if not r.get("utterances") or (known is not None and r["name"] not in known):
            raise ValueError(f"route {r.get('name')!r} is unknown or has no utterances")
    rows = [(r["name"], u, i, r.get("score_threshold")) for r in found for i, u in enumerate(r["utterances"])]
    return spark.createDataFrame(rows, "name string, utterance string, seq int, score_threshold double")


def year_in(year: Column, low: int | None, high: int | None) -> Column:
    """Whether a year lies in a range, ends included; an unknown year doesn't."""
    out = year.isNotNull()
    return (out & (year >= low) if low is not None else out) & (year <= high if high is not None else F.lit(True))
