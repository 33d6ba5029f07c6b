"""Queries of block edits, projections of blocks to files, paths, gates and the cascade of intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, rules
from ..functions import text as t
from ..operators import audit, dense, memory, route, sparse
from .memory import _at
from .retrieval import _COS, _HITS, _STATS, EVERY, _hits, _queries, _thresholds, table

ROOTS = ["/vault/papers", "/vault"]
#: A list of lines made from a turn of a conversation.
LINES = "concat('- a', cast(turn % 3 as string), ' (x)', char(10), '- b ', role, char(10), char(10), '- a', cast(turn % 2 as string), ' (y)')"
LINES_SQL = "'- a' || turn % 3 || ' (x)' || chr(10) || '- b ' || role || chr(10) || chr(10) || '- a' || turn % 2 || ' (y)'"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def block_replace_once(spark: SparkSession, sf: str) -> DataFrame:
    """Null where the old text isn't there just once."""
    return _turns(spark, sf).select("conv_id", "turn", blocks.replaced_once(F.expr(LINES), F.concat(F.lit("- a"), (F.col("turn") % 3).cast("string")), F.lit("+")).alias("value"))


def block_line_edits(spark: SparkSession, sf: str) -> DataFrame:
    value = F.expr(LINES)
    return _turns(spark, sf).select(
        "conv_id", "turn", blocks.line_inserted(value, F.lit("new"), (F.col("turn") % 4 - 1).cast("int")).alias("inserted"),
        blocks.line_appended(value, F.lit("new")).alias("appended"), blocks.lines_removed(value, F.concat(F.lit("a"), (F.col("turn") % 3).cast("string"))).alias("removed"),
    )


def list_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", blocks.history_line("ts", "event_type", F.col("user_id").cast("string")).alias("history"), blocks.unread_line("event_type", F.col("user_id").cast("string")).alias("unread"))


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as blocks and the files they are projected to; in every third conversation a file was edited since."""
    front = F.concat(F.lit("---\ndescription: "), F.col("role"), F.lit("\nmetadata: {}\n---\n"))
    edit = F.when(F.col("conv_id") % 3 == 0, F.lit(" edited")).otherwise(F.lit(""))
    return _turns(spark, sf).select("conv_id", "turn", F.lit("v").alias("value"), F.concat(front, F.lit("v"), edit, F.lit("\n")).alias("file_text"))


def projection_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose files say something else, with what they say."""
    body = blocks.front_matter_stripped("file_text")
    return _projected(spark, sf).select("conv_id", "turn", body.alias("new_value"), blocks.front_matter_field("file_text", "description").alias("description"), "value").where("new_value <> value").drop("value")


def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    said = F.expr("CASE turn % 3 WHEN 0 THEN concat('so ', char(10), '```json', char(10), '{\"r\": \"', role, '\"}', char(10), '``` {x}') WHEN 1 THEN concat('it is {\"r\": 1} and {', role, '} then') ELSE 'none' END")
    return _turns(spark, sf).select("conv_id", "turn", blocks.json_body(said).alias("body"))


def path_policy(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("concat(CASE conv_id % 3 WHEN 0 THEN '/vault/papers/' WHEN 1 THEN '/vault/' ELSE '/else/' END, CASE turn % 3 WHEN 0 THEN '.GIT/' ELSE 'notes/' END, role, '.md')")
    return _turns(spark, sf).select("conv_id", "turn", blocks.relative_path(path, ROOTS).alias("relative"), blocks.denied_path(path, [".git", ".claude"]).alias("denied"))


def clarified_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.md5(F.encode(blocks.clarified("text", "role"), "UTF-8")).alias("digest"))


def pending_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What users say as answers to questions about what they said before, of rounds from 0 to 3; in every third conversation nothing is asked."""
    said = memory.with_previous(_turns(spark, sf).where("role = 'user'"), "conv_id", "turn", {"text": "before"})
    asked = F.when(F.col("conv_id") % 3 != 0, F.col("before"))
    merged = said.select("conv_id", "turn", blocks.pending(asked, (F.col("turn") / 2).cast("int") % 4, "text").alias("p"))
    return merged.select("conv_id", "turn", F.md5(F.encode("p.query", "UTF-8")).alias("digest"), "p.forced")


def call_status(spark: SparkSession, sf: str) -> DataFrame:
    error = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PolicyDenied' WHEN 2 THEN 'SecurityBlocked' WHEN 3 THEN 'ConfirmRequired' ELSE 'Odd' END")
    return table(spark, sf, "events").select("event_id", audit.status(error).alias("status"))


def message_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each conversation after the first two."""
    return memory.after_cursor(_turns(spark, sf), "conv_id", "turn", 2).select("conv_id", "turn")


def hybrid_index_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine and weighted sparse product of the vectors and documents of one number, for every twentieth benchmark item."""
    items = _queries(spark, sf).where(f"query_id % {EVERY} = 0")
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding").join(items.select("query_id"), "query_id", "left_semi")
    weights, mean = sparse.router_weights(items, docs, "query_id")
    own = sparse.document_weights(docs.join(vectors.select("doc_id"), "doc_id", "left_semi"), "doc_id", mean=mean, wanted=weights)
    hits = sparse.sparse_dot(weights, own, "query_id", "doc_id").join(asked.select("query_id"), "query_id", "left_semi")
    near = route.hybrid_nearest(asked, vectors, hits, 5, "query_id", "doc_id")
    return near.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def intent_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The route of each query vector, r0 standing for the general one, with an utterance that every third query follows up by."""
    utterance = F.expr("CASE WHEN query_id % 60 = 0 THEN '那 Figure 3 呢？' ELSE concat('see 10.1000/x', cast(query_id as string)) END")
    turns = table(spark, sf, "embeddings").where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"))
    turns = turns.select("query_id", utterance.alias("text"), F.when(F.col("query_id") % 40 == 0, F.lit("r3")).alias("prev_intent"), F.lit("Figure 1 of 2401.00001").alias("prev_text"))
    choices = route.chosen(route.route_scores(_hits(spark, sf), "query_id"), _thresholds(spark, sf), "query_id", default=0.1)
    rows = route.cascade(turns, choices, "query_id", general="r0")
    of = lambda k: F.try_element_at("entities", F.lit(k)).alias(k)
    return rows.select("query_id", "intent", "source", F.round("confidence", 6).alias("confidence"), of("figure"), of("arxiv_id"), of("doi"))


def previous_turns(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn's user said before."""
    said = _turns(spark, sf).where("role = 'user'")
    return memory.with_previous(said, "conv_id", "turn", {"text": "previous"}).select("conv_id", "turn", F.md5(F.encode("previous", "UTF-8")).alias("previous"))


def line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(t.py_lines(F.coalesce("text", F.lit("")))).alias("n_lines"))


def span_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of events as seconds, from their starts and as many milliseconds as their users' numbers."""
    return table(spark, sf, "events").select("event_id", F.round(_at() + F.col("user_id") / 1000, 3).alias("ended_at"))


def clipped_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(rules.clipped(F.col("value") / 50 - 0.5), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    block_replace_once, block_line_edits, list_lines, projection_changes, json_bodies, path_policy, clarified_queries, pending_queries, call_status, message_cursor, hybrid_index_top5, intent_cascade, previous_turns,
    line_breaks, span_ends, clipped_scores,
)}

_L = f"l AS (SELECT conv_id, turn, role, {LINES_SQL} AS v FROM conversations)"
_KEPT = "list_filter(string_split(v, chr(10)), lambda x: x <> '')"

SQL = {
    "block_replace_once": f"WITH {_L} SELECT conv_id, turn, CASE WHEN turn % 3 <> turn % 2 THEN replace(v, '- a' || turn % 3, '+') END AS value FROM l",
    "block_line_edits": f"""WITH {_L} SELECT conv_id, turn,
  array_to_string(CASE turn % 4 WHEN 0 THEN list_append(string_split(v, chr(10)), 'new') ELSE string_split(v, chr(10))[:turn % 4 - 1] || ['new'] || string_split(v, chr(10))[turn % 4:] END, chr(10)) AS inserted,
  v || chr(10) || 'new' AS appended, array_to_string(list_filter({_KEPT}, lambda x: NOT starts_with(x, '- a' || turn % 3)), chr(10)) AS removed FROM l""",
    "list_lines": "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || '《' || user_id || '》' AS history, '- ' || event_type || ' (' || user_id || ')' AS unread FROM events",
    "projection_changes": "SELECT conv_id, turn, 'v edited' AS new_value, role AS description FROM conversations WHERE conv_id % 3 = 0",
    "json_bodies": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"r": "' || role || '"}' WHEN 1 THEN '{"r": 1} and {' || role || '}' END AS body FROM conversations""",
    "path_policy": "SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN CASE turn % 3 WHEN 0 THEN '.GIT/' ELSE 'notes/' END || role || '.md' END AS relative, turn % 3 = 0 AS denied FROM conversations",
    "clarified_queries": "SELECT conv_id, turn, md5(text || '（用户澄清：' || role || '）') AS digest FROM conversations",
    "pending_queries": """SELECT conv_id, turn, md5(CASE WHEN b IS NULL THEN text WHEN r >= 2 THEN b ELSE b || '（用户澄清：' || text || '）' END) AS digest, b IS NOT NULL AND r >= 2 AS forced FROM (
  SELECT conv_id, turn, text, turn // 2 % 4 AS r, CASE WHEN conv_id % 3 <> 0 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS b FROM conversations WHERE role = 'user')""",
    "call_status": "SELECT event_id, ['success', 'policy_blocked', 'security_blocked', 'user_denied', 'error'][event_id % 5 + 1] AS status FROM events",
    "message_cursor": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k > 2",
    "hybrid_index_top5": f"""WITH {_STATS}, sp AS (SELECT query_id, doc_id, sum(qw.weight * dw.weight) AS s FROM qw JOIN dw USING (token) GROUP BY ALL),
c AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_COS.format(a="q.embedding", b="v.embedding")} AS c FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % {EVERY} = 0)),
h AS (SELECT query_id, doc_id, c + (1 - {route.ALPHA}::DOUBLE) * (1 - {route.ALPHA}::DOUBLE) * coalesce(s, 0) AS score FROM c LEFT JOIN sp USING (query_id, doc_id))
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h) WHERE rank <= 5""",
    "intent_cascade": f"""WITH {_HITS}, t AS (SELECT vec_id AS query_id, vec_id % 60 = 0 AS f, vec_id % 120 = 0 AS kept FROM embeddings WHERE vec_id % {EVERY} = 0)
SELECT query_id, CASE WHEN kept THEN 'r3' ELSE coalesce(route, 'r0') END AS intent, CASE WHEN kept THEN 'followup' WHEN coalesce(route, 'r0') <> 'r0' THEN 'router' ELSE 'llm' END AS source,
  CASE WHEN kept THEN 1.0 WHEN coalesce(route, 'r0') <> 'r0' THEN round(greatest(0.0, least(1.0, score)), 6) ELSE 0.0 END AS confidence, CASE WHEN f THEN '3' END AS figure,
  CASE WHEN kept THEN '2401.00001' END AS arxiv_id, CASE WHEN NOT f THEN '10.1000/x' || query_id END AS doi FROM t LEFT JOIN pick USING (query_id)""",
    "previous_turns": "SELECT conv_id, turn, md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS previous FROM conversations WHERE role = 'user'",
    "line_breaks": r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '(\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')) END AS n_lines FROM documents",
    "span_ends": "SELECT event_id, round(epoch_us(ts) / 1e6 + user_id / 1000, 3) AS ended_at FROM events",
    "clipped_scores": "SELECT event_id, round(greatest(0.0, least(1.0, value / 50 - 0.5)), 6) AS confidence FROM events",
}
