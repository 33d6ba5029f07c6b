"""Queries of papers: feeds, parts of parsed papers, titles, ranks, reviews; and of patches, diffs, gates and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, linkage, rules
from ..operators import chunk, pool
from ..sources import papers
from ..streaming import state
from .edits import LINES, LINES_SQL
from .retrieval import table
from .rules import _RANKS, _VENUE, VENUE

#: Letters of a document, for feeds and papers made from it in Spark as in DuckDB (whose regexp_replace needs the flag g).
_LETTERS = "regexp_replace(substr(text, {0}, {1}), '[^A-Za-z .,&]', ''{2})"
_ESCAPED = "replace({0}, '&', '&amp;')"


def _made(flag: str) -> dict[str, str]:
    """Expressions of parts of a document: a heading, which may be empty, and three pieces; as they are and as XML."""
    parts = {"h": "CASE WHEN doc_id % 4 = 1 THEN '' ELSE " + _LETTERS.format(1, 30, flag) + " END", "b1": _LETTERS.format(31, 60, flag), "b2": _LETTERS.format(91, 200, flag), "t": _LETTERS.format(1, 90, flag)}
    return parts | {f"x{k}": _ESCAPED.format(v) for k, v in parts.items()}


_ID = "CASE WHEN doc_id % 5 = 2 THEN concat('cs/', cast(doc_id as string)) ELSE concat('http://arxiv.org/abs/24', lpad(cast(doc_id as string), 6, '0'), 'v1') END"
_SPARK = _made("")
ATOM = f"""CASE WHEN doc_id % 11 = 3 THEN concat('<entry><id>', {_ID}, '</id><title>cut') ELSE concat('<entry><id>', {_ID}, '</id><title> ', {_SPARK["xt"]}, char(10), '  x </title>',
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '<published>199</published>' ELSE concat('<published>20', lpad(cast(doc_id % 30 as string), 2, '0'), '-01-02T00:00:00Z</published>') END,
  '<summary> S', char(10), ' ', source, ' </summary><link title="pdf" href="http://x/', cast(doc_id as string), '.pdf"/></entry>') END"""
WORK = f"""CASE WHEN doc_id % 11 = 3 THEN '{{"id": "cut' ELSE to_json(named_struct('id', CASE WHEN doc_id % 9 <> 4 THEN concat('W', cast(doc_id as string)) END, 'title', 'not this', 'display_name', CASE WHEN doc_id % 8 <> 5 THEN {_SPARK["t"]} END,
  'doi', CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1/', cast(doc_id as string)) WHEN doc_id % 3 = 1 THEN concat('10.1/', cast(doc_id as string)) END, 'publication_year', 2000 + doc_id % 30, 'cited_by_count', CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 END,
  'primary_location', CASE WHEN doc_id % 6 <> 1 THEN named_struct('pdf_url', 'http://not/this', 'source', CASE WHEN doc_id % 6 <> 2 THEN named_struct('display_name', source, 'type', CASE WHEN doc_id % 4 = 0 THEN 'journal' END, 'issn', CASE doc_id % 5 WHEN 0 THEN array() WHEN 1 THEN array(concat('1-', cast(doc_id % 9 as string)), '2') END) END) END,
  'best_oa_location', CASE doc_id % 10 WHEN 0 THEN named_struct('pdf_url', '') WHEN 1 THEN named_struct('pdf_url', cast(null as string)) WHEN 2 THEN null ELSE named_struct('pdf_url', concat('http://x/', cast(doc_id as string))) END)) END"""
TEI = f"""concat('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>', CASE WHEN doc_id % 3 = 0 THEN concat('<abstract><div type="abstract"><p>', {_SPARK["xt"]}, '</p></div></abstract>') ELSE '' END, '</teiHeader><text><body><div><head>', {_SPARK["xh"]}, '</head><p>', {_SPARK["xb1"]}, '<ref>1</ref> tail</p><p>', {_SPARK["xb2"]},
  '</p><table><row><cell>a', cast(doc_id as string), '</cell><cell>b</cell></row></table><div type="sub"><p>nested ', cast(doc_id as string), '</p><figure><head>f</head><figDesc>cap ', cast(doc_id % 7 as string), '</figDesc></figure><figure/></div></div><div type="bare"><head>no paragraphs</head></div><div><p/></div><p>no division</p>',
  CASE WHEN doc_id % 13 = 5 THEN '<p>' ELSE '' END, '</body></text></TEI>')"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def atom_feed(spark: SparkSession, sf: str) -> DataFrame:
    return papers.atom_papers(_docs(spark, sf).select(F.col("doc_id").alias("seq"), F.expr(ATOM).alias("xml")))


def work_feed(spark: SparkSession, sf: str) -> DataFrame:
    return papers.work_papers(_docs(spark, sf).select(F.col("doc_id").alias("seq"), F.expr(WORK).alias("json")))


def pooled_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Both feeds' rows in one pool, in the order of the feeds."""
    return pool.unioned([atom_feed(spark, sf), work_feed(spark, sf)]).select("seq.source_no", "seq.row_no", "title", "arxiv_id", "doi")


def parsed_parts(spark: SparkSession, sf: str) -> DataFrame:
    return papers.tei_parts(_docs(spark, sf).select("doc_id", F.expr(TEI).alias("xml")), "doc_id")


def parsed_errors(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents could be read as papers, and how many sections these have."""
    rows = papers.tei_parsed(_docs(spark, sf).select("doc_id", F.expr(TEI).alias("xml")), "doc_id")
    return rows.groupBy(F.col("error").isNotNull().alias("malformed")).agg(F.count("*").alias("n"), F.sum(F.size("sections")).alias("n_sections"))


def parsed_sections(spark: SparkSession, sf: str) -> DataFrame:
    return papers.tei_sections(_docs(spark, sf).select("doc_id", F.expr(TEI).alias("xml")), "doc_id")


def font_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of pages, of sizes from 10 to 13."""
    lines = table(spark, sf, "conversations").select("conv_id", "turn", (10.0 + (F.col("turn") * F.col("turn") + F.col("conv_id")) % 4).alias("size"), F.concat("role", F.col("turn").cast("string")).alias("line"))
    return chunk.font_sections(lines, "conv_id", "turn", "size", "line")


def title_cascade(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda k, name: F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    spans = F.expr("CASE WHEN doc_id % 5 = 3 THEN array(named_struct('text', 'low', 'size', 10.0D, 'y', 1.0D), named_struct('text', 'big', 'size', 20.0D, 'y', 30.0D), named_struct('text', ' top ', 'size', 20.0D, 'y', 5.0D)) END")
    return _docs(spark, sf).select("doc_id", linkage.title_of(some(0, "s"), some(1, "g"), F.coalesce(some(2, "p"), F.lit("")), spans).alias("t")).select("doc_id", "t.*")


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of pages: what their address refers to, a heading or a title without references to characters, or the first of the largest lines."""
    own = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    line = lambda size, pattern, mark: F.struct(own("html", pattern).alias("text"), F.lit(size).alias("size"), F.instr("html", F.lit(mark)).cast("double").alias("y"))
    spans = F.array(line(12.0, "<title>([^<]*)", "<title>"), line(24.0, "<h1>([^<]*)", "<h1>"), line(24.0, '<div class="ad">([^<]*)', '<div class="ad">'))
    title = linkage.title_of(own("url", "[?&]ref=([^&#]*)"), own("html", "<h1>([^<&]*)</h1>"), own("html", "<title>([^<&]*)</title>"), spans)
    return table(spark, sf, "pages").select("page_id", title.alias("t")).select("page_id", "t.*")


def venue_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Venues that the table lacks, some with a page of zones and some with one of quartiles."""
    rows = table(spark, sf, "part").withColumnRenamed("p_partkey", "part_key").select(
        "part_key", F.expr(VENUE).alias("venue"), F.expr("CASE WHEN part_key % 12 = 5 THEN '<tr><td>a</td><td>b</td><td>c</td><td>2区</td></tr>' END").alias("zones"),
        F.expr("CASE WHEN part_key % 12 IN (5, 11) THEN concat('<td>', p_name, '</td><span>Q3</span>') END").alias("quartiles"),
    )
    return pool.ranked_venues(rows, letpub="zones", sjr="quartiles").select("part_key", "rank.ccf", "rank.jcr", "rank.cas", "rank_source", "passed", "rank_text")


def paper_review(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.expr("CASE WHEN doc_id % 7 <> 0 THEN 2000 + doc_id % 30 END").alias("year"), F.expr("CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("passed"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'u' ELSE '' END").alias("pdf_url"), (F.col("doc_id") % 5 == 1).alias("downloadable"))
    return pool.reviewed(rows, 2010, ranked=True).select("doc_id", F.array_join("failed", ",").alias("failed"), "decision")


def dispatch_gate(spark: SparkSession, sf: str) -> DataFrame:
    intent, steps = F.expr("CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'chat' END"), F.expr("CASE WHEN conv_id % 2 = 0 THEN array('search') ELSE array() END")
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.dispatch_denied(intent, steps, ["search", "write"]).alias("denied"))


def block_patch(spark: SparkSession, sf: str) -> DataFrame:
    """A patch of three lines; in every fifth turn its context is another line."""
    patch = f"concat('@@ -1,2 +1,2 @@', char(10), ' ', CASE WHEN turn % 5 = 0 THEN 'x' ELSE split({LINES}, char(10))[0] END, char(10), '-- b ', role, char(10), '+new')"
    return table(spark, sf, "conversations").select("conv_id", "turn", blocks.patched(F.expr(LINES), F.expr(patch)).alias("value"))


def block_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = blocks.unified_diff(F.expr(LINES), F.expr(f"replace({LINES}, concat('- b ', role), '- b R!')"))
    return table(spark, sf, "conversations").select("conv_id", "turn", diff.alias("diff")).select("conv_id", "turn", "diff", blocks.truncated_lines("diff", 5).alias("shown"))


def cursor_moves(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.expr("CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'invalid' END")
    moved = state.next_cursor("user_id", F.col("user_id") + 10, (F.col("event_id") % 4).cast("int"), outcome)
    return table(spark, sf, "events").select("event_id", moved.alias("m")).select("event_id", "m.cursor", "m.failures")


QUERIES = {f.__name__: f for f in (
    atom_feed, work_feed, pooled_feeds, parsed_parts, parsed_sections, parsed_errors, font_sections, title_cascade, page_titles, venue_cascade, paper_review, dispatch_gate, block_patch, block_diff, cursor_moves,
)}

_DUCK = _made(", 'g'")
_PAPER = "CASE WHEN doc_id % 5 = 2 THEN 'cs/' || doc_id ELSE '24' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || 'v1' END"
_ATOM = f"""SELECT doc_id AS seq, array_to_string(list_filter(string_split({_DUCK["t"]} || ' x', ' '), lambda w: w <> ''), ' ') AS title, {_PAPER} AS arxiv_id, published, CASE WHEN length(published) >= 4 THEN CAST(substr(published, 1, 4) AS INTEGER) END AS year,
  'S ' || source AS abstract, 'https://arxiv.org/pdf/' || {_PAPER} AS pdf_url, NULL AS venue, NULL AS issn, true AS downloadable
  FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '199' ELSE '20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '-01-02T00:00:00Z' END AS published FROM documents) WHERE doc_id % 11 <> 3"""
_WORK = f"""SELECT doc_id AS seq, CASE WHEN doc_id % 8 <> 5 THEN {_DUCK["t"]} ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1/' || doc_id WHEN 1 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 9 <> 4 THEN 'W' || doc_id ELSE '' END AS openalex_id,
  CAST(2000 + doc_id % 30 AS INTEGER) AS year, CASE WHEN placed THEN source END AS venue, CASE WHEN placed AND doc_id % 5 = 1 THEN '1-' || doc_id % 9 END AS issn, CASE WHEN placed AND doc_id % 4 = 0 THEN 'journal' END AS venue_type,
  CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'http://x/' || doc_id END AS pdf_url, doc_id % 10 > 2 AS downloadable, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 ELSE 0 END AS INTEGER) AS cited_by_count
  FROM (SELECT *, doc_id % 6 NOT IN (1, 2) AS placed FROM documents) WHERE doc_id % 11 <> 3"""
_SECTIONS = f"""SELECT doc_id, 0 AS k, 'abstract' AS heading, {_DUCK["t"]} AS body FROM documents WHERE doc_id % 3 = 0 AND doc_id % 13 <> 5
  UNION ALL SELECT doc_id, 1, {_DUCK["h"]}, {_DUCK["b1"]} || chr(10) || {_DUCK["b2"]} FROM documents WHERE doc_id % 13 <> 5
  UNION ALL SELECT doc_id, 2, 'sub', 'nested ' || doc_id FROM documents WHERE doc_id % 13 <> 5 UNION ALL SELECT doc_id, 3, '', '' FROM documents WHERE doc_id % 13 <> 5"""

SQL = {
    "atom_feed": _ATOM,
    "work_feed": _WORK,
    "pooled_feeds": f"SELECT 0 AS source_no, seq AS row_no, title, arxiv_id, NULL AS doi FROM ({_ATOM}) UNION ALL SELECT 1, seq, title, NULL, doi FROM ({_WORK})",
    "parsed_parts": "SELECT doc_id, 'table' AS kind, 0 AS part, 'a' || doc_id || 'b' AS text FROM documents WHERE doc_id % 13 <> 5 UNION ALL SELECT doc_id, 'figure', 0, 'cap ' || doc_id % 7 FROM documents WHERE doc_id % 13 <> 5 UNION ALL SELECT doc_id, 'figure', 1, '' FROM documents WHERE doc_id % 13 <> 5",
    "parsed_errors": f"SELECT doc_id % 13 = 5 AS malformed, count(DISTINCT doc_id) AS n, count(*) FILTER (k >= 0) AS n_sections FROM (SELECT doc_id, k FROM ({_SECTIONS}) UNION ALL SELECT doc_id, -1 FROM documents) GROUP BY 1",
    "parsed_sections": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS section, heading, body FROM ({_SECTIONS})",
    "font_sections": """WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (turn * turn + conv_id) % 4 >= 2 AS large, role || turn AS line FROM conversations),
r AS (SELECT conv_id, k, false AS opens, 0 AS section, line FROM l WHERE k = 1
  UNION ALL SELECT l.conv_id, l.k, l.large AND NOT r.opens, r.section + CAST(l.large AND NOT r.opens AS INTEGER), l.line FROM r JOIN l ON l.conv_id = r.conv_id AND l.k = r.k + 1)
SELECT conv_id, section, coalesce(max(line) FILTER (opens), '') AS heading, string_agg(line, chr(10) ORDER BY k) FILTER (NOT opens) || chr(10) AS body FROM r GROUP BY conv_id, section HAVING count(*) FILTER (NOT opens) > 0""",
    "title_cascade": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 's' || doc_id WHEN 1 THEN 'g' || doc_id WHEN 2 THEN 'p' || doc_id WHEN 3 THEN 'top' ELSE '' END AS title, ['search', 'grobid', 'pdftitle', 'pymupdf', ''][doc_id % 5 + 1] AS source FROM documents",
    "page_titles": """SELECT page_id, CASE source WHEN 'search' THEN s WHEN 'grobid' THEN g WHEN 'pdftitle' THEN p WHEN 'pymupdf' THEN f ELSE '' END AS title, source FROM (
  SELECT *, CASE WHEN s <> '' THEN 'search' WHEN g <> '' THEN 'grobid' WHEN p <> '' THEN 'pdftitle' WHEN f <> '' THEN 'pymupdf' ELSE '' END AS source FROM (
    SELECT page_id, coalesce(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS s, regexp_extract(html, '<h1>([^<&]*)</h1>', 1) AS g, regexp_extract(html, '<title>([^<&]*)</title>', 1) AS p,
      trim(CASE WHEN instr(html, '<div class="ad">') < instr(html, '<h1>') THEN regexp_extract(html, '<div class="ad">([^<]*)', 1) ELSE regexp_extract(html, '<h1>([^<]*)', 1) END) AS f FROM pages))""",
    "venue_cascade": f"""WITH r(venue_key, ccf, jcr, cas) AS (VALUES {_RANKS}),
j AS (SELECT part_key, CASE WHEN r.venue_key IS NOT NULL THEN 'local' WHEN part_key % 12 = 5 THEN 'letpub' WHEN part_key % 12 = 11 THEN 'sjr' ELSE 'none' END AS rank_source, ccf, jcr, cas FROM {_VENUE} v LEFT JOIN r USING (venue_key)),
k AS (SELECT part_key, rank_source, ccf, CASE rank_source WHEN 'sjr' THEN 'Q3' ELSE jcr END AS jcr, CASE rank_source WHEN 'letpub' THEN '二区' ELSE cas END AS cas FROM j)
SELECT *, coalesce(jcr IN ('Q1', 'Q2'), false) OR coalesce(cas IN ('一区', '二区'), false) OR coalesce(ccf IN ('A', 'B'), false) AS passed, coalesce(nullif(concat_ws('；', 'CCF-' || ccf, 'JCR-' || jcr, 'CAS-' || cas), ''), '无') AS rank_text FROM k""",
    "paper_review": """SELECT doc_id, concat_ws(',', y, r, d) AS failed, CASE WHEN y IS NULL AND r IS NULL AND d IS NULL THEN 'pass' ELSE 'fail' END AS decision FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 30 < 10 THEN 'year' END AS y, CASE WHEN doc_id % 3 <> 0 THEN 'rank' END AS r, CASE WHEN doc_id % 2 = 1 AND doc_id % 5 <> 1 THEN 'download' END AS d FROM documents)""",
    "dispatch_gate": "SELECT conv_id, turn, turn % 3 = 1 AND conv_id % 2 = 1 AS denied FROM conversations",
    "block_patch": f"SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN replace(v, '- b ' || role, 'new') END AS value FROM (SELECT conv_id, turn, role, {LINES_SQL} AS v FROM conversations)",
    "block_diff": """SELECT conv_id, turn, h || chr(10) || '+- b R!' || chr(10) || ' ' || chr(10) || ' - a' || turn % 2 || ' (y)' AS diff, h || chr(10) || '… +3 lines' AS shown FROM (
  SELECT conv_id, turn, '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1,4 +1,4 @@' || chr(10) || ' - a' || turn % 3 || ' (x)' || chr(10) || '-- b ' || role AS h FROM conversations)""",
    "cursor_moves": "SELECT event_id, CASE WHEN m THEN user_id + 10 ELSE user_id END AS cursor, CAST(CASE WHEN m THEN 0 WHEN o = 1 THEN f + 1 ELSE f END AS INTEGER) AS failures FROM (SELECT *, o = 0 OR (o = 1 AND f >= 2) AS m FROM (SELECT event_id, user_id, event_id % 3 AS o, event_id % 4 AS f FROM events))",
}
