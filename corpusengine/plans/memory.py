"""Queries of memory, compaction, audit and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, compaction, memory, sync
from ..streaming import index_sync, state
from .retrieval import table

BUDGET, CONTEXT, LIMIT = 60, 1000, 40

def _at() -> Column:
    """Seconds of an event's time, which has no zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as passages tagged with language and source, with the vectors of the same number; every eleventh is deleted."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags"), F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))).alias("created_at"), (F.col("doc_id") % 11 == 0).alias("is_deleted"))
    return docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def passage_search(spark: SparkSession, sf: str) -> DataFrame:
    query = [1.0 if i % 2 else -1.0 for i in range(64)]
    rows = memory.passages(_passages(spark, sf), "id", ["en"], start="2024-01-05", end="2024-01-25", query=query, k=20)
    return rows.select("id", F.round("score", 6).alias("score"))


def unique_tags(spark: SparkSession, sf: str) -> DataFrame:
    return memory.unique_tags(_passages(spark, sf))


def passage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).where("not is_deleted").groupBy(F.element_at("tags", 1).alias("lang")).agg(F.count("*").alias("n"))


def conversation_search(spark: SparkSession, sf: str) -> DataFrame:
    return memory.conversation_search(table(spark, sf, "conversations"), "th", ["conv_id", "turn"]).select("conv_id", "turn", "role")


def in_context_replay(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    messages = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("agent_id"), F.col("turn").alias("seq"), "role")
    ids = F.when(F.col("agent_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("-", "agent_id", F.lit(1)), F.concat_ws("-", "agent_id", F.lit(0))))
    return memory.replayed(messages, messages.select("agent_id").distinct().withColumn("message_ids", ids)).select("agent_id", "pos", "id")


def compaction_tail(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.recent_tail(table(spark, sf, "conversations"), "conv_id", "turn", BUDGET).select("conv_id", "turn")


def compaction_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Of three turns in a row the first is an assistant with two calls and the others their results, but for conversations whose results name no call."""
    role = F.expr("CASE turn % 3 WHEN 0 THEN 'assistant' ELSE 'tool' END")
    calls = F.when(F.col("turn") % 3 == 0, F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat_ws("-", "conv_id", F.col("turn") + i).alias("id"))))
    called = F.when(F.col("turn") % 3 != 0, F.concat_ws("-", F.when(F.col("conv_id") % 5 == 0, F.lit("x")).otherwise(F.col("conv_id").cast("string")), "turn"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), "text", calls.alias("tool_calls"), called.alias("tool_call_id"))
    return compaction.recent_tail(rows, "conv_id", "turn", BUDGET).select("conv_id", "turn", "role")


def should_compress(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.should_compress(table(spark, sf, "conversations"), "conv_id", 300)


def compacted_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    said = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.concat(F.lit("summary of "), F.col("n").cast("string")).alias("summary"))
    return compaction.compacted(rows, said, "conv_id", "turn", BUDGET).select("conv_id", "part", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("block_id"), F.col("event_id").alias("seq"), "props", F.concat("event_type", F.lit(":"), "props").alias("value"), (F.col("user_id") % 17 == 0).alias("read_only"))


def block_versions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.block_versions(_edits(spark, sf), LIMIT)


def block_restore(spark: SparkSession, sf: str) -> DataFrame:
    history = memory.block_versions(_edits(spark, sf), LIMIT).withColumn("history_id", F.concat_ws("-", "block_id", "version"))
    blocks = memory.latest(history, "block_id", "version").select("block_id", "value", "version")
    return memory.restored(blocks, history, blocks.where("block_id % 2 = 0").select(F.concat_ws("-", "block_id", F.lit(1)).alias("history_id")))


def latest_agents(spark: SparkSession, sf: str) -> DataFrame:
    return memory.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = _passages(spark, sf).select("id", "is_deleted")
    return memory.soft_deleted(rows, rows.where("id % 4 = 1").select("id"), "id")


def archive_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lists = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("archive_id"), F.array(F.col("doc_id") + 1, F.col("doc_id") + 2, F.col("doc_id") + 1).alias("passage_ids"))
    return memory.archived(lists, docs.select(F.col("doc_id").alias("id"), "lang"))


def archive_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents go into the archive of their tens' number, every third of which there is."""
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("archive_id"))
    archives = docs.where("archive_id % 3 = 0").select("archive_id").distinct().withColumn("passage_ids", F.when(F.col("archive_id") % 2 == 0, F.array(F.lit(7).cast("long"))))
    more = docs.select("archive_id", F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"))
    rows = memory.archive_added(archives, more).select("archive_id", F.array_join("passage_ids", ",").alias("ids"))
    lost = memory.unknown_archives(archives, more).select("archive_id", F.concat(F.lit("unknown "), F.col("id").cast("string")).alias("ids"))
    return rows.unionByName(lost)


def block_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth block is to go, and some that there aren't."""
    blocks = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 6 == 0).alias("read_only"))
    gone = blocks.where("doc_id % 4 = 0").select("doc_id").unionByName(blocks.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id")))
    kept = memory.deleted(blocks, gone, "doc_id").select("doc_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(memory.deletions(blocks, gone, "doc_id"))


def encoded_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array("role", F.col("turn").cast("string")).alias("calls"), F.struct(F.col("turn").alias("n"), "role").alias("meta"))
    return memory.encoded(rows)


def message_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))


def compress_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with a context of their own, or half the window of their model."""
    rows = table(spark, sf, "conversations")
    models = rows.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.lit(200)).otherwise(F.lit(0)).alias("context_size"), (F.col("conv_id") % 5 * 151 + 301).alias("model_window"))
    return compaction.should_compress_by(rows, models, "conv_id")


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("text"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("path"), F.when(F.col("doc_id") % 2 > 0, F.col("n_chars").cast("double")).alias("mtime"))
    return sync.all_documents(rows, "doc_id")


def parse_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the files is cached, of which half have changed since; parsing fails for some."""
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), F.lit(1).alias("length"), "source")
    cache = files.where("path % 3 = 0").select("path", (F.col("mtime") - F.col("path") % 2).alias("mtime"), "length", F.lit("old").alias("parsed"))
    parsed = sync.parsed_once(files, cache, lambda f: f.withColumn("parsed", F.when(F.col("path") % 10 != 1, F.upper("source"))))
    return parsed.select("path", "parsed", "fresh").join(sync.cacheable(parsed).select("path", F.lit(True).alias("cached")), "path", "left")


def memory_compile(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.expr("CASE turn % 3 WHEN 0 THEN 'persona' WHEN 1 THEN 'human' ELSE 'notes' END").alias("label"), F.col("text").alias("value"))
    return memory.compiled(blocks, "conv_id").select("conv_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def edit_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("batch_id"), "turn", F.expr("CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 'system/human.md' ELSE concat('notes/', role, '.md') END").alias("file"), F.expr("CASE WHEN turn = 1 THEN 'delete' ELSE 'append' END").alias("action"))
    return memory.valid_batches(rows).select("batch_id", "turn", "accepted")


def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    fresh = rows.where("doc_id % 4 = 0").selectExpr("doc_id", "-n_chars AS n_chars").unionByName(rows.where("doc_id % 9 = 0 AND doc_id % 4 <> 0").selectExpr("doc_id + 1000000000 AS doc_id", "n_chars"))
    return sync.upserted(rows, fresh, "doc_id")


def span_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as spans of a binary heap: each one's parent is the one at half its number."""
    numbered = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)")
    rows = table(spark, sf, "events").select("user_id", numbered.alias("n"))
    spans = rows.select(F.concat_ws("-", "user_id", "n").alias("span_id"), F.when(F.col("n") > 1, F.concat_ws("-", "user_id", F.floor(F.col("n") / 2))).alias("parent_id"))
    return audit.span_depths(spans)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("span_id"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'tool_started' WHEN event_id % 6 = 1 THEN 'other' ELSE 'tool_ended' END").alias("event_type"))


def unfinished_spans(spark: SparkSession, sf: str) -> DataFrame:
    return audit.unfinished(_log(spark, sf)).select("span_id")


def approval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("span_id"), F.col("event_id").alias("started_at"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'approval_requested' WHEN event_id % 6 = 1 THEN 'other' ELSE 'approval_decided' END").alias("event_type"), F.floor(F.col("event_id") / 2).alias("causation_id"), F.col("event_type").alias("approval_outcome"))
    return audit.approvals(rows)


def tool_latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.usage(table(spark, sf, "events"), "event_type")
    return rows.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("total", "mean", "p95")))


def stream_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("call_id"), (F.col("turn") % 2).alias("index"), F.col("turn").alias("seq"), F.col("role").alias("piece"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("stop"), F.col("turn").cast("string"))).alias("finish_reason"))
    return audit.joined_deltas(rows)


def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A source a user: views ask, clicks fail, anything else succeeds."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'call' WHEN 'click' THEN 'failure' ELSE 'success' END")
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), _at().alias("at"), kind.alias("kind"))
    return state.breaker_replay(rows)


def task_dedup_replay(spark: SparkSession, sf: str) -> DataFrame:
    at = _at()
    rows = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("session"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("seq"), at.alias("at"), (at + 5).alias("done_at"), (F.col("event_type") == "click").alias("has_path"))
    return state.task_decisions(rows)


def consolidation_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), _at().alias("at"))
    return state.consolidation_batches(rows, "user_id", "seq", "at", least=5)


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = index_sync.windowed(table(spark, sf, "events"), "ts", "event_type", "1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = index_sync.windowed(table(spark, sf, "events"), "ts", "event_type", "2 hours", slide="1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = index_sync.sessions(table(spark, sf, "events"), "ts", "user_id", "2 hours")
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n")


_TOKENS = r"CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 4 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) + 4 END"
_TAIL = f"tail AS (SELECT * FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {{0}} WHERE role <> 'system') WHERE spent <= {BUDGET} OR k = 1)"
_EDITS = f"v AS (SELECT user_id AS block_id, row_number() OVER w AS version, event_type || ':' || props AS value, lag(event_type || ':' || props) OVER w AS previous FROM events WHERE user_id % 17 <> 0 AND length(event_type || ':' || props) <= {LIMIT} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_PASS = "ps AS (SELECT doc_id AS id, lang, source, CASE WHEN doc_id % 13 <> 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS created_at, doc_id % 11 = 0 AS is_deleted, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"

QUERIES = {f.__name__: f for f in (
    passage_search, unique_tags, passage_counts, conversation_search, in_context_replay, compaction_tail, compaction_tools, should_compress, compacted_window, block_versions, block_restore,
    latest_agents, soft_delete, archive_passages, memory_compile, edit_batches, chunk_upsert, span_tree, unfinished_spans, approval_outcomes, tool_latency, stream_deltas, breaker_replay,
    task_dedup_replay, consolidation_batches, event_windows, event_sessions, event_sliding_windows,
    archive_additions, block_deletes, encoded_messages, message_counts, compress_by_model, stored_documents, parse_cache,
)}

SQL = {
    "passage_search": f"""WITH {_PASS}, q AS (SELECT [CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE FOR i IN range(64)] AS q)
SELECT id, round(s, 6) AS score FROM (SELECT id, coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 8), 0) AS s FROM ps, q
WHERE NOT is_deleted AND lang = 'en' AND coalesce(created_at, '') BETWEEN '2024-01-05' AND '2024-01-25') ORDER BY round(s, 9) DESC, id LIMIT 20""",
    "unique_tags": f"WITH {_PASS} SELECT lang AS tag FROM ps WHERE NOT is_deleted UNION SELECT source FROM ps WHERE NOT is_deleted",
    "passage_counts": f"WITH {_PASS} SELECT lang, count(*) AS n FROM ps WHERE NOT is_deleted GROUP BY lang",
    "conversation_search": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th%' ORDER BY conv_id DESC, turn DESC LIMIT 20",
    "in_context_replay": "SELECT conv_id AS agent_id, turn AS pos, conv_id || '-' || turn AS id FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, 1 - turn, conv_id || '-' || turn FROM conversations WHERE conv_id % 3 <> 0 AND turn <= 1",
    "compaction_tail": f"WITH {_TAIL.format('conversations')} SELECT conv_id, turn FROM tail",
    "compaction_tools": f"""WITH m AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'assistant' ELSE 'tool' END AS role FROM conversations), {_TAIL.format("m")},
b AS (SELECT conv_id, turn, role FROM tail UNION SELECT m.conv_id, m.turn, m.role FROM m JOIN tail t ON m.conv_id = t.conv_id AND t.role = 'tool' AND m.turn = t.turn - t.turn % 3)
SELECT * FROM b WHERE role = 'assistant' OR conv_id % 5 <> 0""",
    "should_compress": f"SELECT conv_id, sum({_TOKENS})::BIGINT AS estimate, sum({_TOKENS}) * 1.1::DOUBLE > 240.0 AS compress FROM conversations GROUP BY conv_id",
    "compacted_window": f"""WITH {_TAIL.format("conversations")},
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 AND role = 'system')
SELECT conv_id, 0 AS part, turn, role, md5(text) AS digest FROM h WHERE f = 1 UNION ALL SELECT conv_id, 1, NULL, 'system', md5('summary of ' || count(*)) FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 2, turn, role, md5(text) FROM tail""",
    "block_versions": f"WITH {_EDITS} SELECT * FROM v",
    "block_restore": f"WITH {_EDITS} SELECT block_id, CASE WHEN block_id % 2 = 0 THEN arg_min(value, version) ELSE arg_max(value, version) END AS value, CASE WHEN block_id % 2 = 0 THEN 1 ELSE max(version) END AS version FROM v GROUP BY block_id",
    "latest_agents": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "soft_delete": "SELECT doc_id AS id, doc_id % 11 = 0 OR doc_id % 4 = 1 AS is_deleted FROM documents",
    "archive_passages": "SELECT d.doc_id AS archive_id, p.doc_id AS id, p.lang FROM (SELECT doc_id, unnest([1, 2, 1]) AS i FROM documents WHERE doc_id % 10 = 0) d JOIN documents p ON p.doc_id = d.doc_id + i",
    "memory_compile": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE turn % 3 < 2 GROUP BY conv_id",
    "edit_batches": "SELECT conv_id AS batch_id, turn, NOT (conv_id % 4 = 0 AND count(*) FILTER (turn = 1) OVER (PARTITION BY conv_id) > 0) AS accepted FROM conversations",
    "chunk_upsert": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, n_chars FROM documents WHERE doc_id % 9 = 0 AND doc_id % 4 <> 0",
    "span_tree": "SELECT user_id || '-' || n AS span_id, user_id || '-1' AS root_id, CAST(floor(log2(n)) AS INTEGER) AS depth FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)",
    "unfinished_spans": "WITH l AS (SELECT event_id // 2 AS span_id, event_id % 2 = 0 AS started, event_id % 2 = 1 AND event_id % 6 <> 1 AS ended FROM events) SELECT span_id FROM l WHERE started AND span_id NOT IN (SELECT span_id FROM l WHERE ended)",
    "approval_outcomes": "SELECT a.event_id // 2 AS span_id, a.event_id AS requested_at, d.event_id AS decided_at, d.event_type AS outcome FROM events a LEFT JOIN events d ON d.event_id // 2 = a.event_id // 2 AND d.event_id % 2 = 1 AND d.event_id % 6 <> 1 WHERE a.event_id % 2 = 0",
    "tool_latency": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(quantile_disc(value, 0.95), 4) AS p95 FROM events GROUP BY event_type",
    "stream_deltas": "SELECT conv_id AS call_id, turn % 2 AS index, string_agg(role, '' ORDER BY turn) AS text, arg_max('stop' || turn, turn) FILTER (turn % 3 = 0) AS finish_reason FROM conversations GROUP BY ALL",
    "task_dedup_replay": """WITH RECURSIVE e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS session, event_type, event_id AS seq, epoch_us(ts) / 1e6 AS secs, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT session, event_type, n, seq, 'run' AS decision, secs AS began FROM e WHERE n = 1 UNION ALL
  SELECT e.session, e.event_type, e.n, e.seq, CASE WHEN e.secs < r.began + 5 THEN 'wait' WHEN e.event_type <> 'click' AND e.secs - r.began <= 300 THEN 'reuse' ELSE 'run' END,
    CASE WHEN e.secs < r.began + 5 OR (e.event_type <> 'click' AND e.secs - r.began <= 300) THEN r.began ELSE e.secs END
  FROM r JOIN e ON e.session = r.session AND e.event_type = r.event_type AND e.n = r.n + 1) SELECT session, seq, decision FROM r""",
    "event_sliding_windows": "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(unnest([0, 1])) AS w, event_type, value FROM events) GROUP BY ALL",
    "archive_additions": """WITH d AS (SELECT doc_id, doc_id // 10 AS a FROM documents)
SELECT a AS archive_id, CASE WHEN a % 2 = 0 THEN '7,' ELSE '' END || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM d WHERE a % 3 = 0 GROUP BY a UNION ALL SELECT a, 'unknown ' || doc_id FROM d WHERE a % 3 <> 0""",
    "block_deletes": """SELECT doc_id, 'kept' AS outcome FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 6 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'read_only' ELSE 'deleted' END FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT -doc_id - 1, 'missing' FROM documents WHERE doc_id % 50 = 0""",
    "encoded_messages": "SELECT conv_id, turn, '[\"' || role || '\",\"' || turn || '\"]' AS calls, '{\"n\":' || turn || ',\"role\":\"' || role || '\"}' AS meta FROM conversations",
    "message_counts": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id",
    "compress_by_model": f"""SELECT conv_id, estimate, context, estimate * 1.1::DOUBLE > context * 0.8::DOUBLE AS compress FROM (
  SELECT conv_id, sum({_TOKENS})::BIGINT AS estimate, CAST(CASE WHEN conv_id % 3 = 0 THEN 200 ELSE (conv_id % 5 * 151 + 301) // 2 END AS BIGINT) AS context FROM conversations GROUP BY conv_id)""",
    "stored_documents": "SELECT doc_id, source AS text, CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END AS path, CASE WHEN doc_id % 2 > 0 THEN CAST(n_chars AS DOUBLE) ELSE 0.0::DOUBLE END AS mtime FROM documents",
    "parse_cache": "SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'old' WHEN doc_id % 10 <> 1 THEN upper(source) END AS parsed, doc_id % 6 <> 0 AS fresh, CASE WHEN doc_id % 6 <> 0 AND doc_id % 10 <> 1 THEN true END AS cached FROM documents",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
