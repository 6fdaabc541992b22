"""Taking documents in: the rule for equal names, chunks with durable ids, cascading deletion, previews, sessions' tools and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import tables

#: Answers to an upload, and the file types that are shown as text.
TAKEN, DUPLICATE = 1, 2
TEXT_TYPES = ("txt", "md", "text", "java", "csv", "html", "doc", "docx", "xls", "xlsx")


def upload_codes(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """uploads (user_id, file_name, overwrite, ...) with ``code`` and ``duplicate_id``: DUPLICATE where the user has a file of that name and doesn't overwrite it.

    known: (user_id, file_name, id); of several files of one name the highest id counts.
    """
    latest = known.groupBy("user_id", "file_name").agg(F.max("id").alias("duplicate_id"))
    joined = uploads.join(latest, ["user_id", "file_name"], "left")
    return joined.withColumn("code", F.when(F.col("duplicate_id").isNotNull() & ~F.coalesce("overwrite", F.lit(False)), DUPLICATE).otherwise(TAKEN))


def taken_in(known: DataFrame, uploads: DataFrame) -> DataFrame:
    """The file table after uploads: those taken are added under new ids, and the files they replace are gone."""
    judged = upload_codes(uploads, known).where(F.col("code") == TAKEN)
    kept = tables.deleted(known, judged.where("duplicate_id is not null").select(F.col("duplicate_id").alias("id")), "id")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))  # one row
    number = F.row_number().over(Window.orderBy("user_id", "file_name"))  # the uploads of one batch
    return kept.unionByName(judged.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + number).select(*known.columns))


def chunk_ids(chunks: DataFrame, key: str = "doc_id", base: int = 0) -> DataFrame:
    """chunks (key, sort_order, chunk_level, parent_order) with ``id`` and ``parent_id``: parents are numbered first, and children name their parent's id.

    Ids follow key and order, so a second run gives the same. They are the document's first id, from counts by document, plus a rank within it.
    """
    counts = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    first = counts.select(key, (F.coalesce(F.sum("_n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + base).alias("_first"))  # one narrow row a document
    rank = F.row_number().over(Window.partitionBy(key).orderBy("chunk_level", "sort_order"))
    numbered = chunks.join(first, key).withColumn("id", F.col("_first") + rank).drop("_first")
    parents = numbered.where("chunk_level = 1").select(key, F.col("sort_order").alias("parent_order"), F.col("id").alias("parent_id"))
    return numbered.join(parents, [key, "parent_order"], "left")


def preview(file_type: Column, path: Column, content: Column) -> Column:
    """(type, text) of a file's preview: not ready without a path, text for known types, else unsupported. Pages of a pdf are rows of their own."""
    kind = F.lower(file_type)
    shape = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    ready = F.when(kind == "pdf", shape("pdf", content)).when(kind.isin(*TEXT_TYPES), shape("text", content)).otherwise(shape("unsupported", F.lit("not shown")))
    return F.when(F.coalesce(T.trimmed(path), F.lit("")) == "", shape("unsupported", F.lit("not ready"))).otherwise(ready)


def activated(resolved: DataFrame, skills: DataFrame, tools: DataFrame) -> DataFrame:
    """(session, tool), distinct: registered tools that a session resolved by name, and for a resolved skill its registered tools.

    resolved: (session, name); skills: (name, tool); tools: (tool).
    """
    by_skill = resolved.join(skills, "name").select("session", "tool")
    named = resolved.join(skills.select("name").distinct(), "name", "left_anti").select("session", F.col("name").alias("tool"))
    return by_skill.unionAll(named).join(tools.select("tool").distinct(), "tool", "left_semi").distinct()


def cache_entries(accesses: DataFrame, now: Column, idle: str = "12 hours", most: int = 500, key: str = "session", ts: str = "ts") -> DataFrame:
    """(key, last): what a cache holds at a time: entries accessed within the idle time, of those the most recently accessed."""
    last = accesses.where(F.col(ts) <= now).groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") + F.expr(f"interval {idle}") > now).orderBy(F.desc("last"), key).limit(most)


def gated(contexts: DataFrame, rules: DataFrame, budget: int, key: str = "conv_id") -> DataFrame:
    """What a context build does, contexts being (key, tokens, turns, saved) and rules the keys that have rules.

    A first assembly tells the policy by tokens against the budget. Where it asks for projection, there
    are turns and no rules yet, rules are made at once and the assembly is repeated without the
    ``saved`` tokens (action ``sync``). Else rules are renewed later (``async``), unless the policy is FULL or SUMMARY (``none``).
    """

    def policy(tokens: Column) -> Column:
        share = tokens / budget
        return F.when(share >= 0.9, "SUMMARY").when(share >= 0.8, "SNIP").when(share >= 0.6, "REWRITE").otherwise("FULL")

    joined = contexts.join(rules.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    first = joined.withColumn("policy_before", policy(F.col("tokens")))
    wanted = F.col("policy_before") != "FULL"
    sync = wanted & (F.col("turns") > 0) & F.col("_known").isNull()
    after = first.withColumn("_sync", sync).withColumn("tokens", F.col("tokens") - F.when(F.col("_sync"), F.col("saved")).otherwise(0))
    done = after.withColumn("policy", policy(F.col("tokens")))
    action = F.when(F.col("_sync"), "sync").when((F.col("policy") != "FULL") & (F.col("policy") != "SUMMARY"), "async").otherwise("none")
    return done.select(key, "policy_before", "tokens", "policy", action.alias("action"))
