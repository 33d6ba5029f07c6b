"""Queries of chunking, rules and record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, linkage, rules
from ..functions import text as t
from ..operators import chunk, pool, sync
from .retrieval import table

SIZE, OVERLAP = 64, 8
NOTICE = "[withheld]"
#: Utterances made from rows of conversations, so that every entity occurs.
UTTERANCE = "concat('see 24', lpad(cast(conv_id % 100 as string), 2, '0'), '.', lpad(cast(conv_id as string), 5, '0'), 'v', cast(turn + 1 as string), ', 10.1000/x', cast(conv_id as string), '. and Figure ', cast(turn as string), ' in /data/my notes/p', cast(conv_id as string), '.pdf')"
UTTERANCE_SQL = "concat('see 24', lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0'), '.', lpad(CAST(conv_id AS VARCHAR), 5, '0'), 'v', CAST(turn + 1 AS VARCHAR), ', 10.1000/x', CAST(conv_id AS VARCHAR), '. and Figure ', CAST(turn AS VARCHAR), ' in /data/my notes/p', CAST(conv_id AS VARCHAR), '.pdf')"
#: Names of venues made from part names.
VENUE = "CASE part_key % 6 WHEN 0 THEN 'Proceedings of the ACM SIGIR' WHEN 1 THEN 'The Web Conference' WHEN 2 THEN 'TPAMI' WHEN 3 THEN 'International Conference on ICML' WHEN 4 THEN 'ACM Transactions on Information Systems' ELSE p_name END"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("section"), F.lit("").alias("heading"), F.col("text").alias("body"))
    return chunk.chunked(docs, size=SIZE, overlap=OVERLAP)


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "path", "chunk_index", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("path").agg(F.count("*").alias("n_chunks"))


def section_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.html_sections(table(spark, sf, "pages"), "page_id").select("page_id", "section", "heading", F.md5(F.encode("body", "UTF-8")).alias("digest"))


def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Each first word of a line that ends in a stop is made a heading, as documents have none of their own."""
    marked = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^([^\n ]*\.)", "# $1").alias("text"))
    return chunk.markdown_sections(marked, "doc_id").select("doc_id", "section", "heading", F.md5(F.encode("body", "UTF-8")).alias("digest"))


def reference_section_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.expr("CASE page_id % 4 WHEN 0 THEN ' References' WHEN 1 THEN '参考文献列表' WHEN 2 THEN 'Preference' ELSE ' bibliography 2' END").alias("heading"))
    return chunk.without_references(rows)


def heading_missing(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "pages").select("page_id", F.expr("CASE page_id % 3 WHEN 0 THEN 'Method' WHEN 1 THEN ' Summary ' ELSE 'Other' END").alias("heading"))
    return chunk.missing_headings(notes, ["Summary", "Method", "Results"], "page_id").select("page_id", F.array_join("missing", "|").alias("missing"))


def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.grep(table(spark, sf, "documents"), "thing.*hath", "doc_id").select("doc_id", "line_no", F.md5(F.encode("line", "UTF-8")).alias("digest"))


def repetition_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(t.repetition_ratio("text"), 6).alias("ratio"))


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a leak added to some of them."""
    extra = F.expr("CASE doc_id % 5 WHEN 0 THEN ' `cat /etc/passwd` ' WHEN 1 THEN concat(' key sk-', repeat('aB3', 12)) WHEN 2 THEN ' (/home/u/x.txt) ' ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", F.concat("text", extra).alias("text"))


def scan_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scanned(spark, sf).select("doc_id", F.explode(rules.violations("text")).alias("v"))
    rows = rows.groupBy("doc_id", "v.rule_id", "v.severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.coalesce("v.snippet", F.lit("")))), "\n").alias("snippets"))
    return rows.select("doc_id", "rule_id", "severity", "n", F.md5(F.encode("snippets", "UTF-8")).alias("snippets"))


def scan_critical(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("doc_id", rules.has_critical("text").alias("critical"))


def content_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("doc_id", F.md5(F.encode(rules.gated("text", NOTICE), "UTF-8")).alias("digest"))


def _utterances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr(UTTERANCE).alias("q"))


def entities_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = rules.entities("q")
    return _utterances(spark, sf).select("conv_id", "turn", *(F.try_element_at(e, F.lit(k)).alias(k) for k in ("pdf_path", "arxiv_id", "doi", "note_path", "figure")))


def followup_detect(spark: SparkSession, sf: str) -> DataFrame:
    q = F.expr("CASE turn % 4 WHEN 0 THEN '那 Figure 3 呢？' WHEN 1 THEN '再下载一篇' WHEN 2 THEN '这篇呢？' ELSE text END")
    previous = F.expr("CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'ask_question' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.is_followup(q, previous).alias("followup"))


def risk_gate(spark: SparkSession, sf: str) -> DataFrame:
    risk = F.expr("CASE turn % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'odd' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.exceeds_risk(risk, "medium").alias("refused"))


def task_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", blocks.task_fingerprint("text", "role").alias("fingerprint"))


def task_has_path(spark: SparkSession, sf: str) -> DataFrame:
    task = F.expr("CASE turn % 3 WHEN 0 THEN concat(text, ' read：/tmp/x') WHEN 1 THEN concat(text, ' a/b 8/10') ELSE text END")
    return table(spark, sf, "conversations").select("conv_id", "turn", blocks.task_has_path(task).alias("has_path"))


def redact_params(spark: SparkSession, sf: str) -> DataFrame:
    params = F.create_map(F.lit("path"), F.col("role"), F.lit("API_Key"), F.col("text"), F.lit("full_text"), F.col("text"), F.lit("n"), F.col("turn").cast("string"))
    out = blocks.redacted(params)
    return table(spark, sf, "conversations").select("conv_id", "turn", *(F.element_at(out, k).alias(k.lower()) for k in ("path", "API_Key", "full_text", "n")))


def compact_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", blocks.compacted("text").alias("shown"))


def arxiv_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", blocks.arxiv_query("p_name").alias("q"), blocks.clamped("p_size").alias("max_results"))


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers: some have a DOI that two share, some an arXiv id, all a title from their text."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1/"), (F.col("doc_id") % 50).cast("string"))).alias("doi"), F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 70).cast("string"), 5, "0"))).alias("arxiv_id"),
        F.col("text").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("venue"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("issn"), F.lit(None).cast("string").alias("pdf_url"), F.lit(None).cast("string").alias("openalex_id"),
    )


def dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).select("seq", linkage.dedup_key("doi", "arxiv_id", "title").alias("dedup_key"))


def dedup_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pool.deduplicated(_papers(spark, sf)).select("dedup_key", "seq", "n_records", "title", "venue", "issn")


def venue_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumnRenamed("p_partkey", "part_key").select("part_key", linkage.norm_venue(F.expr(VENUE)).alias("venue_key"))


def venue_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumnRenamed("p_partkey", "part_key").select("part_key", F.expr(VENUE).alias("venue"))
    return pool.ranked_venues(rows).select("part_key", "rank.ccf", "rank.jcr", "rank.cas", "rank_source", "passed", "rank_text")


def sjr_parse(spark: SparkSession, sf: str) -> DataFrame:
    html = F.expr("concat(html, '<td>Journal of ', CAST(page_id % 9 AS STRING), 'x</td><span>Q', CAST(page_id % 6 AS STRING), '</span>')")
    rank = linkage.sjr_rank(html, F.expr("concat('Journal of ', CAST(page_id % 9 AS STRING), 'X')"))
    return table(spark, sf, "pages").select("page_id", rank["jcr"].alias("jcr"))


def letpub_parse(spark: SparkSession, sf: str) -> DataFrame:
    html = F.expr("concat(html, '<tr><td>a</td><td>b</td></tr><tr class=x><td>1</td><td>2</td><td>3</td><TD>', CAST(page_id % 6 AS STRING), '区</TD></tr>')")
    return table(spark, sf, "pages").select("page_id", linkage.letpub_rank(html)["cas"].alias("cas"))


def review_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("review_id"), F.expr("CASE conv_id % 2 WHEN 0 THEN 'pass' ELSE 'fail' END").alias("verdict"), F.expr("CASE WHEN turn % 4 = 3 THEN 'blocking' ELSE 'minor' END").alias("severity"))
    return pool.consistent_reviews(rows)


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    scan = docs.where("path % 7 <> 0").withColumn("mtime", F.expr("CASE WHEN path % 5 = 0 THEN mtime - 1 ELSE mtime END"))
    return sync.snapshot_diff(docs.where("path % 3 <> 0"), scan)


def sync_replace(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunks(spark, sf).select("chunk_id", "path", "chunk_index", F.lit("old").alias("generation"))
    changed = rows.where("path % 5 = 0")
    return sync.replaced(rows, changed.where("path % 10 = 0").withColumn("generation", F.lit("new")), changed)


def mtime_state(spark: SparkSession, sf: str) -> DataFrame:
    return sync.state_of(table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("n_chars").alias("mtime")))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_STEP = SIZE - OVERLAP
_CHUNKS = f"""ck AS (SELECT doc_id AS path, i AS chunk_index, substr(sha1(doc_id || ':' || i), 1, 16) AS chunk_id, array_to_string(w[i * {_STEP} + 1:i * {_STEP} + {SIZE}], ' ') AS text
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= {SIZE} THEN [0] ELSE range(0, CAST(ceil(len(w) / {_STEP}) AS BIGINT)) END) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) WHERE len(w) > 0)"""
_SCAN = "sc AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' `cat /etc/passwd` ' WHEN 1 THEN ' key sk-' || repeat('aB3', 12) WHEN 2 THEN ' (/home/u/x.txt) ' ELSE '' END AS text FROM documents)"
#: The rules' patterns as the other engine writes them: Unicode words are ASCII there, and its text has no bounds next to other letters.
_RULES = {r: p.replace("(?U)", "").replace("(?iU)", "(?i)").replace("'", "''") for r, _, p in rules.SCAN_RULES} | {"pii_email": r"[\w.-]+@[\w.-]+\.\w+"}
_SEVERITY = {r[0]: r[1] for r in rules.SCAN_RULES}
_RATIO = r"CASE WHEN length(text) < 100 OR len(l) = 0 THEN 0 ELSE 1 - len(list_distinct(l)) / len(l) END"
_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule_id, '{_SEVERITY[k]}' AS severity, regexp_extract_all(text, '{v}') AS m FROM sc" for k, v in _RULES.items())
_FOUND = f"{_SCAN}, fd AS (SELECT doc_id, rule_id, severity, len(m) AS n, md5(array_to_string(list_sort(list_transform(m, lambda x: substr(x, 1, 100))), chr(10))) AS snippets FROM ({_FOUND} UNION ALL SELECT doc_id, 'high_repetition', 'warning', [''] FROM (SELECT doc_id, {_RATIO} AS r FROM (SELECT doc_id, text, {_LINES} AS l FROM sc)) WHERE r > 0.8) WHERE n > 0)"
_PAPERS = "pp AS (SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN '10.1/' || (doc_id % 50) END AS doi, CASE WHEN doc_id % 5 = 1 THEN '2401.' || lpad(CAST(doc_id % 70 AS VARCHAR), 5, '0') END AS arxiv_id, text AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS venue, CASE WHEN doc_id % 3 <> 0 THEN lang END AS issn FROM documents), pk AS (SELECT *, coalesce('doi:' || doi, 'arxiv:' || arxiv_id, 'title:' || lower(regexp_replace(title, '[^\\p{L}\\p{N}_]', '', 'g'))) AS dedup_key FROM pp)"
_VENUE = "regexp_replace(lower(" + VENUE + "), '[^a-z0-9]', '', 'g')"
for _w in linkage.NOISE:
    _VENUE = f"regexp_replace({_VENUE}, '^{_w}', '')"
_VENUE = f"(SELECT part_key, CASE v WHEN 'webconference' THEN 'www' WHEN 'tpami' THEN 'ieeetransactionsonpatternanalysisandmachineintelligence' ELSE v END AS venue_key FROM (SELECT part_key, {_VENUE} AS v FROM (SELECT p_partkey AS part_key, p_name FROM part)))"
_RANKS = ", ".join(f"('{k}', " + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for k, v in linkage.VENUES.items())

QUERIES = {f.__name__: f for f in (
    chunk_documents, chunk_counts, section_bodies, markdown_sections, reference_section_filter, heading_missing, grep_lines, repetition_ratio, scan_violations, scan_critical, content_gate,
    entities_extract, followup_detect, risk_gate, task_fingerprint, task_has_path, redact_params, compact_values, arxiv_query, dedup_key, dedup_pool, venue_normalize, venue_rank, sjr_parse,
    letpub_parse, review_consistency, snapshot_diff, sync_replace, mtime_state,
)}

SQL = {
    "chunk_documents": f"WITH {_CHUNKS} SELECT chunk_id, path, chunk_index, md5(text) AS digest FROM ck",
    "chunk_counts": f"WITH {_CHUNKS} SELECT path, count(*) AS n_chunks FROM ck GROUP BY path",
    "section_bodies": r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<h[1-6][^>]*>', chr(1), 'g') AS h FROM pages),
s AS (SELECT page_id, i AS section, p[i + 1] AS part FROM (SELECT page_id, string_split(h, chr(1)) AS p, unnest(range(1, len(string_split(h, chr(1))))) AS i FROM c)),
x AS (SELECT page_id, section, regexp_extract(part, '(?is)^(.*?)</h[1-6]>', 1) AS heading, regexp_replace(part, '(?is)^.*?</h[1-6]>', '') AS body FROM s)
SELECT page_id, section, trim(regexp_replace(regexp_replace(heading, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS heading, md5(trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM x""",
    "markdown_sections": r"""WITH m AS (SELECT doc_id, regexp_replace(text, '(?m)^([^\n ]*\.)', '# \1', 'g') AS text FROM documents),
l AS (SELECT doc_id, pos, line, starts_with(line, '#') AS head FROM (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM m)) ),
s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(regexp_replace(line, '^[# ]+', '')) FILTER (head), '') AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM s GROUP BY ALL)
SELECT doc_id, section, heading, md5(body) AS digest FROM g WHERE heading <> '' OR body <> ''""",
    "reference_section_filter": "SELECT page_id, 'Preference' AS heading FROM pages WHERE page_id % 4 = 2",
    "heading_missing": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Summary|Results' WHEN 1 THEN 'Method|Results' ELSE 'Summary|Method|Results' END AS missing FROM pages",
    "grep_lines": r"SELECT doc_id, line_no, md5(line) AS digest FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE regexp_matches(line, 'thing.*hath') ORDER BY doc_id, line_no LIMIT 30",
    "repetition_ratio": f"SELECT doc_id, round({_RATIO}, 6) AS ratio FROM (SELECT doc_id, text, {_LINES} AS l FROM documents)",
    "scan_violations": f"WITH {_FOUND} SELECT doc_id, rule_id, severity, n, snippets FROM fd",
    "scan_critical": f"WITH {_FOUND} SELECT doc_id, doc_id IN (SELECT doc_id FROM fd WHERE severity = 'critical') AS critical FROM sc",
    "content_gate": f"WITH {_FOUND} SELECT doc_id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM fd WHERE severity = 'critical') THEN '{NOTICE}' ELSE text END) AS digest FROM sc",
    "entities_extract": rf"""WITH q AS (SELECT conv_id, turn, {UTTERANCE_SQL} AS q FROM conversations)
SELECT conv_id, turn, regexp_extract(q, '(/data/.*\.pdf)', 1) AS pdf_path, nullif(regexp_extract(q, '(\d{{4}}\.\d{{4,5}}v\d+)', 1), '') AS arxiv_id,
  regexp_replace(regexp_extract(q, '(10\.\d{{4,9}}/[^\s,;]+)', 1), '[.,;]+$', '') AS doi, NULL AS note_path, regexp_extract(q, '(?i)figure\s*(\d+)', 1) AS figure FROM q""",
    "followup_detect": f"""SELECT conv_id, turn, conv_id % 3 <> 0 AND (CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE regexp_matches(text, '{"|".join(rules.FOLLOWUP_MARKERS)}') AND NOT regexp_matches(text, '{"|".join(rules.ACTION_VERBS)}') END) AS followup FROM conversations""",
    "risk_gate": "SELECT conv_id, turn, turn % 5 >= 2 AS refused FROM conversations",
    "task_fingerprint": r"SELECT conv_id, turn, substr(sha256(role || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS fingerprint FROM conversations",
    "task_has_path": "SELECT conv_id, turn, turn % 3 = 0 OR regexp_matches(text, '(^|[^A-Za-z0-9_])/[^\\s，,;:。（）\"'']+') AS has_path FROM conversations",
    "redact_params": "SELECT conv_id, turn, role AS path, '***' AS api_key, 'HIDDEN' AS full_text, CAST(turn AS VARCHAR) AS n FROM conversations",
    "compact_values": "SELECT conv_id, turn, CASE WHEN length(s) <= 40 THEN s WHEN length(s) <= 120 THEN substr(s, 1, 35) || '…' || right(s, 10) ELSE substr(s, 1, 40) || '…(' || length(s) || ' chars)…' || right(s, 20) END AS shown FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS s FROM conversations)",
    "arxiv_query": r"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> ''), lambda w: 'all:' || w), ' AND ') AS q, least(greatest(3, p_size), 50) AS max_results FROM part",
    "dedup_key": f"WITH {_PAPERS} SELECT seq, dedup_key FROM pk",
    "dedup_pool": f"WITH {_PAPERS} SELECT dedup_key, min(seq) AS seq, count(*) AS n_records, arg_min(title, seq) AS title, arg_min(venue, seq) FILTER (venue <> '') AS venue, arg_min(issn, seq) FILTER (issn <> '') AS issn FROM pk GROUP BY dedup_key",
    "venue_normalize": f"SELECT part_key, venue_key FROM {_VENUE}",
    "venue_rank": f"""WITH r(venue_key, ccf, jcr, cas) AS (VALUES {_RANKS})
SELECT part_key, ccf, jcr, cas, CASE WHEN r.venue_key IS NULL THEN 'none' ELSE 'local' END AS rank_source, coalesce(jcr IN ('Q1', 'Q2'), false) OR coalesce(cas IN ('一区', '二区'), false) OR coalesce(ccf IN ('A', 'B'), false) AS passed,
  coalesce(nullif(concat_ws('；', 'CCF-' || ccf, 'JCR-' || jcr, 'CAS-' || cas), ''), '无') AS rank_text FROM {_VENUE} v LEFT JOIN r USING (venue_key)""",
    "sjr_parse": r"""SELECT page_id, CASE WHEN f <> '' THEN 'Q' || f END AS jcr FROM (SELECT page_id, regexp_extract(substr(p, instr(p, v), length(v) + 500), 'q([1-4])', 1) AS f FROM (
  SELECT page_id, regexp_replace(lower(html || '<td>Journal of ' || page_id % 9 || 'x</td><span>Q' || page_id % 6 || '</span>'), '[^a-z0-9]', '', 'g') AS p, 'journalof' || page_id % 9 || 'x' AS v FROM pages))""",
    "letpub_parse": "SELECT page_id, CASE WHEN page_id % 6 BETWEEN 1 AND 4 THEN ['一', '二', '三', '四'][page_id % 6] || '区' END AS cas FROM pages",
    "review_consistency": "SELECT conv_id AS review_id, (conv_id % 2 = 0) = (count(*) FILTER (turn % 4 = 3) = 0) AS consistent FROM conversations GROUP BY conv_id",
    "snapshot_diff": "SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 7 <> 0",
    "sync_replace": f"WITH {_CHUNKS} SELECT chunk_id, path, chunk_index, CASE WHEN path % 10 = 0 THEN 'new' ELSE 'old' END AS generation FROM ck WHERE path % 5 <> 0 OR path % 10 = 0",
    "mtime_state": "SELECT source AS path, max(n_chars) AS mtime FROM documents GROUP BY source",
}
