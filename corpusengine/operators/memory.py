"""Memory tables: block versions, passage and conversation search, replay, tags."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import cosine


def block_versions(edits: DataFrame, limit: int = 2000) -> DataFrame:
    """``block_id, version, value, previous``: the accepted edits of ``edits(block_id, seq, value, read_only)`` in order.

    An edit of a read-only block or of more characters than the limit is refused and leaves no version.
    """
    good = edits.where(~F.coalesce("read_only", F.lit(False)) & (F.length("value") <= limit))
    order = Window.partitionBy("block_id").orderBy("seq")
    return good.select("block_id", F.row_number().over(order).alias("version"), "value", F.lag("value").over(order).alias("previous"))


def restored(blocks: DataFrame, history: DataFrame, picks: DataFrame) -> DataFrame:
    """Blocks with value and version of the picked history rows; the version may go back, and nothing new is recorded."""
    rows = history.join(picks.select("history_id"), "history_id").select("block_id", F.col("value").alias("_value"), F.col("version").alias("_version"))
    joined = blocks.join(rows, "block_id", "left")
    return joined.withColumn("value", F.coalesce("_value", "value")).withColumn("version", F.coalesce("_version", "version")).drop("_value", "_version")


def soft_deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``is_deleted`` set where the key is listed."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marks, key, "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).drop("_gone")


def deletions(blocks: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``key, outcome`` of each key listed: deleted, read_only (refused) or missing."""
    had = blocks.groupBy(key).agg(F.bool_or(F.coalesce("read_only", F.lit(False))).alias("_held"))
    outcome = F.when(F.col("_held").isNull(), "missing").when(F.col("_held"), "read_only").otherwise("deleted")
    return gone.select(key).distinct().join(had, key, "left").select(key, outcome.alias("outcome"))


def deleted(blocks: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The blocks that are left: those not listed, and read-only ones, which can't be deleted."""
    held = F.coalesce("read_only", F.lit(False))
    return blocks.where(held).unionByName(blocks.where(~held).join(gone.select(key).distinct(), key, "left_anti"))


def encoded(rows: DataFrame) -> DataFrame:
    """Rows as tables without nested columns hold them: arrays, maps and structs as JSON."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return rows.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else rows


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key, the last by ``seq``: insert or replace."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("row"))
    return packed.select("row.*")


def has_tags(tags: str, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.coalesce(F.col(tags), F.array().cast("array<string>")))) == 0


def passages(rows: DataFrame, key: str, tags: list[str] | None = None, start: str | None = None, end: str | None = None, query: list[float] | None = None, k: int = 10, deleted: bool = False) -> DataFrame:
    """``key, score`` of the k best passages by cosine; one without a vector scores 0, above opposite ones. Without a query, in order of key.

    Times are ISO texts, both ends included; a null fails a start and passes an end.
    """
    if not deleted:
        rows = rows.where(~F.coalesce("is_deleted", F.lit(False)))
    if tags:
        rows = rows.where(has_tags("tags", tags))
    at = F.coalesce("created_at", F.lit(""))
    if start:
        rows = rows.where(at >= start)
    if end:
        rows = rows.where(at <= end)
    if query is None:
        return rows.select(key, F.lit(0.0).alias("score")).orderBy(key).limit(k)
    score = F.coalesce(cosine("embedding", F.array(*map(F.lit, query))), F.lit(0.0))
    return rows.select(key, score.alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def unique_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """``tag``: distinct tags of rows that aren't deleted, a row each."""
    return rows.where(~F.coalesce("is_deleted", F.lit(False))).select(F.explode(tags).alias("tag")).distinct()


def conversation_search(messages: DataFrame, pattern: str, order: list[str], roles: tuple[str, ...] = ("user", "assistant"), limit: int = 20, text: str = "text") -> DataFrame:
    """Messages of these roles that contain the pattern in any case (% and _ are wild), the latest first; only ASCII letters fold."""
    plain = str.maketrans(ascii_uppercase, ascii_lowercase)
    return messages.where(F.col("role").isin(*roles) & F.translate(F.col(text), ascii_uppercase, ascii_lowercase).like(f"%{pattern.translate(plain)}%")).orderBy(*(F.desc(c) for c in order)).limit(limit)


def replayed(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """``agent_id, pos, id, ...``: each agent's messages in the order of its ``message_ids``, all of them by ``seq`` if it lists none."""
    listed = agents.where(F.size(F.coalesce("message_ids", F.array().cast("array<string>"))) > 0)
    picked = listed.select("agent_id", F.posexplode("message_ids").alias("pos", "id")).join(messages.drop("agent_id"), "id")
    rest = messages.join(listed.select("agent_id"), "agent_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy("seq")) - 1
    return picked.unionByName(rest.withColumn("pos", place.cast("int")))


def after_cursor(messages: DataFrame, by: str, seq: str, cursor: int) -> DataFrame:
    """The messages of each group beyond its first ``cursor``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    return messages.withColumn("_place", place).where(F.col("_place") > cursor).drop("_place")


def with_previous(messages: DataFrame, by: str, seq: str, names: dict[str, str]) -> DataFrame:
    """``messages`` with what each named column held one message earlier in the group, under its new name."""
    order = Window.partitionBy(by).orderBy(seq)
    return messages.withColumns({new: F.lag(old).over(order) for old, new in names.items()})


def archive_added(archives: DataFrame, additions: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """``archives`` with the ids of ``additions(archive_id, seq, id)`` put behind their ``passage_ids`` in order, repeats kept.

    A null list counts as empty. Additions to an archive that there isn't change nothing; ``unknown_archives`` names them.
    """
    more = additions.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct(seq, key))).alias("_more"))
    had = F.coalesce("passage_ids", F.array().cast(archives.schema["passage_ids"].dataType))
    joined = archives.join(more, "archive_id", "left")
    return joined.withColumn("passage_ids", F.when(F.col("_more").isNull(), had).otherwise(F.concat(had, F.col(f"_more.{key}")))).drop("_more")


def unknown_archives(archives: DataFrame, additions: DataFrame) -> DataFrame:
    """The additions whose archive there isn't."""
    return additions.join(archives.select("archive_id"), "archive_id", "left_anti")


def archived(archives: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``archive_id, key, ...``: the passages that an archive lists, once for each time."""
    return archives.select("archive_id", F.explode("passage_ids").alias(key)).join(rows, key)


def compiled(blocks: DataFrame, by: str, labels: tuple[str, ...] = ("persona", "human")) -> DataFrame:
    """``by, text``: values of the blocks with these labels, joined in their order by line feeds."""
    rows = blocks.where(F.col("label").isin(*labels)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("v"))
    return rows.select(by, F.array_join(F.col("v.value"), "\n").alias("text"))


def valid_batches(edits: DataFrame, allowed: str = r"^[A-Za-z0-9_/-]+\.md$") -> DataFrame:
    """``edits`` with ``accepted``: a batch stands or falls whole. A file must match, and nothing below system/ may be deleted."""
    good = F.col("file").rlike(allowed) & ~((F.col("action") == "delete") & F.startswith("file", F.lit("system/")))
    return edits.withColumn("accepted", F.bool_and(F.coalesce(good, F.lit(False))).over(Window.partitionBy("batch_id")))
