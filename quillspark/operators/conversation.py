"""Message trees: paths, subtrees, turns, context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.reach import reached


def paths_to_root(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, id, depth): each anchor (id) and all its ancestors; depth 0 is the anchor. A missing ancestor ends the path."""
    up = reached(anchors, messages.select("id", F.col("parent_id").alias("to")))
    return up.join(messages.select("id"), "id").select(F.col("start").alias("anchor"), "id", "depth")


def since_summary(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Paths cut before their nearest summary; whole where there is none."""
    typed = paths.join(messages.select("id", "type"), "id")
    nearest = F.min(F.when(F.col("type") == "summary", F.col("depth"))).over(Window.partitionBy("anchor"))
    return typed.withColumn("_near", nearest).where("_near is null or depth <= _near").select("anchor", "id", "depth", "type")


def subtrees(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth): each root and all its descendants."""
    return reached(roots, messages.select(F.col("parent_id").alias("id"), F.col("id").alias("to"))).withColumnRenamed("start", "root")


def turns(messages: DataFrame) -> DataFrame:
    """Adds turn_no: a turn begins at each user or summary message; messages before the first begin are dropped."""
    begins = F.sum(F.col("type").isin("user", "summary").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("turn_no", begins).where("turn_no > 0")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    return messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)


def budget_policy(messages: DataFrame, window: int) -> DataFrame:
    """(conv_id, tokens, policy): how a history is projected by its share of the context window."""
    ratio = F.col("tokens") / window
    policy = F.when(ratio >= 0.9, "SUMMARY").when(ratio >= 0.8, "SNIP").when(ratio >= 0.6, "REWRITE").otherwise("FULL")
    return messages.groupBy("conv_id").agg(F.sum(F.coalesce(T.estimated_tokens(F.col("text")), F.lit(0))).cast("long").alias("tokens")).withColumn("policy", policy)
