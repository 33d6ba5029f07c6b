"""Queries of gate chains, outcomes of calls, ids of tokens, and paths of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import sparse
from ..operators.gates import Chain, Gate
from ..streaming import calls
from .retrieval import table
from .rules import _FOUND, _scanned


def gate_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through three gates, with what each was blocked for; texts that pass are shortened."""
    chain = Chain(
        [Gate("empty", F.coalesce(F.length("text"), F.lit(0)) == 0), Gate("critical", rules.has_critical("text"), F.lit("a critical rule")), Gate("long", F.length("text") > 5000, F.concat(F.length("text").cast("string"), F.lit(" characters")))],
        before=[lambda d: d.where("doc_id % 50 <> 7"), lambda d: d.withColumn("text", F.when(F.col("doc_id") % 17 != 3, F.col("text")))],
        after=[("text", F.substring("text", 1, 100))],
        finish=lambda d: d.select("doc_id", "gate", "reason", F.when(F.col("gate").isNull(), F.md5(F.encode("text", "UTF-8"))).alias("digest")),
    )
    return chain.run(_scanned(spark, sf))


def call_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a user's events as starts and ends, of which every third end is of another kind."""
    kind = F.expr("CASE WHEN event_id % 2 = 0 THEN 'tool_started' WHEN event_id % 6 = 1 THEN 'other' ELSE 'tool_ended' END")
    events = table(spark, sf, "events").select(kind.alias("event_type"), F.floor(F.col("event_id") / 2).alias("span_id"), F.col("ts").alias("at"))
    return calls.outcomes(events, "2 hours").select("span_id", "finished")


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.token_ids(table(spark, sf, "documents"), "doc_id")


def note_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first path of a note in utterances made from documents: two folders, a blank in the name, capitals, none, and one that a word runs into."""
    made = F.expr("concat(substr(regexp_replace(text, '[^A-Za-z ]', ''), 1, 20), CASE doc_id % 5 WHEN 0 THEN concat(' /notes/', source, '/', cast(doc_id as string), '.md') WHEN 1 THEN concat(' /n/my  note ', cast(doc_id as string), '.MD, x') WHEN 2 THEN ' no.md' WHEN 3 THEN concat('x/', source, '.md') ELSE ' /a.md /b.md' END)")
    return table(spark, sf, "documents").select("doc_id", rules.entity(made, rules.NOTE_PATH).alias("note_path"))


QUERIES = {f.__name__: f for f in (gate_chain, call_outcomes, token_ids, note_paths)}
SQL = {
    "gate_chain": f"""WITH {_FOUND}, d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 3 THEN text ELSE '' END AS text, doc_id % 17 <> 3 AND doc_id IN (SELECT doc_id FROM fd WHERE severity = 'critical') AS critical FROM sc WHERE doc_id % 50 <> 7)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN critical THEN 'critical' WHEN length(text) > 5000 THEN 'long' END AS gate, CASE WHEN text = '' THEN NULL WHEN critical THEN 'a critical rule' WHEN length(text) > 5000 THEN length(text) || ' characters' END AS reason,
  CASE WHEN text <> '' AND NOT critical AND length(text) <= 5000 THEN md5(substr(text, 1, 100)) END AS digest FROM d""",
    "call_outcomes": """WITH e AS (SELECT event_id // 2 AS span_id, event_id % 2 = 0 AS starts, event_id % 6 = 1 AS other, ts FROM events)
SELECT s.span_id, t.ts IS NOT NULL AS finished FROM e s LEFT JOIN e t ON s.span_id = t.span_id AND NOT t.starts AND NOT t.other AND t.ts BETWEEN s.ts AND s.ts + INTERVAL 2 HOUR WHERE s.starts""",
    "token_ids": r"""WITH w AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS t FROM documents))
SELECT token, row_number() OVER (ORDER BY min(doc_id * 10000000 + place)) AS id FROM w GROUP BY token""",
    "note_paths": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/notes/' || source || '/' || doc_id || '.md' WHEN 1 THEN '/n/my  note ' || doc_id || '.MD' WHEN 4 THEN '/a.md' END AS note_path FROM documents""",
}
