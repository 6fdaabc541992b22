"""Step logs: tool calls with their results, the latest search, rewrite rules and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

MISSING, LEAST_TOKENS = "[no result]", 200
#: The parts of the note that stands for a ruled result, around its call and its reason.
NOTE, NOTE_REASON, NOTE_END = "[此工具结果已被 Projection 精简：toolCallId=", ", reason=", "]"


def paired(steps: DataFrame) -> DataFrame:
    """(session, call_id, call_order, content): each tool call with its last result, or a placeholder."""
    results = steps.where("step_type = 'tool_result'").groupBy("session", "call_id").agg(F.max_by("content", "step_order").alias("content"))
    calls = steps.where("step_type = 'tool_call'").select("session", "call_id", F.col("step_order").alias("call_order"))
    return calls.join(results, ["session", "call_id"], "left").withColumn("content", F.coalesce("content", F.lit(MISSING)))


def latest(steps: DataFrame, tool: str) -> DataFrame:
    """(session, content): the last result of a tool, with no fallback to an older one."""
    return steps.where((F.col("step_type") == "tool_result") & (F.col("tool") == tool)).groupBy("session").agg(F.max_by("content", "step_order").alias("content"))


def rewrite_rules(steps: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """(session, call_id, tokens): results of read-only tools of at least 200 estimated tokens, the first of each call."""
    first = F.row_number().over(Window.partitionBy("session", "call_id").orderBy("step_order"))
    long = steps.where((F.col("step_type") == "tool_result") & F.col("tool").isin(*tools)).withColumn("tokens", T.estimated_tokens(F.col("content"))).where(F.col("tokens") >= LEAST_TOKENS)
    return long.withColumn("_r", first).where("_r = 1").select("session", "call_id", "tokens")


def rewritten(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Steps whose tool results are replaced by a note, where a rule names their call; without a call id they go by their tool's name.

    rules: (session, call_id, place, reason); of several for a call the first place counts. The note holds the call and, if
    there is one, the reason.
    """
    first = rules.where("call_id is not null").groupBy("session", F.col("call_id").alias("_call")).agg(F.min_by(F.coalesce("reason", F.lit("")), "place").alias("_reason"))
    called = steps.withColumn("_call", F.coalesce("call_id", "tool"))
    note = F.concat(F.lit(NOTE), "_call", F.when(F.trim("_reason") != "", F.concat(F.lit(NOTE_REASON), "_reason")).otherwise(""), F.lit(NOTE_END))
    ruled = called.join(first, ["session", "_call"], "left")
    return ruled.withColumn("content", F.when(F.col("_reason").isNotNull() & (F.col("step_type") == "tool_result"), note).otherwise(F.col("content"))).select(*steps.columns)
