"""Message and step trees: inheritance of summaries, descendants, deletion of subtrees, expansion, dialogue text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import conversation

#: Prefixes of a dialogue's lines by kind of message.
PREFIXES = {"user": "用户：", "assistant": "助手：", "tool_result": "工具结果："}


def nearest_summaries(messages: DataFrame) -> DataFrame:
    """(id, summary_id): the closest summary strictly above each message; null if none."""
    up = conversation.paths_to_root(messages, messages).where("depth > 0")
    kinds = messages.where("type = 'summary'").select("id")
    best = up.join(kinds, "id", "left_semi").groupBy("anchor").agg(F.min_by("id", "depth").alias("summary_id"))
    return messages.select("id").join(best.withColumnRenamed("anchor", "id"), "id", "left")


def children(messages: DataFrame) -> DataFrame:
    """(parent_id, children): ordered ids. One array a parent: a message's answers. Roots have no parent and are no row, being as many as conversations."""
    return messages.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list("id")).alias("children"))


def without_subtrees(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """Messages that are neither a root nor below one."""
    gone = conversation.subtrees(messages, roots).select("id").distinct()
    return messages.join(gone, "id", "left_anti")


def last_leaves(messages: DataFrame) -> DataFrame:
    """(root, leaf): where the walk from each message ends that always takes the last child."""
    last = messages.where("parent_id is not null").groupBy("parent_id").agg(F.max("id").alias("next"))
    # Turned round, the walk is a forest of parents: each message's parent is the one whose last child it is.
    chain = messages.select("id").join(last.select(F.col("next").alias("id"), F.col("parent_id")), "id", "left")
    ends = messages.select("id").join(last.select(F.col("parent_id").alias("id")), "id", "left_anti")
    return conversation.paths_to_root(chain, ends).select(F.col("id").alias("root"), F.col("anchor").alias("leaf"))


def dialogue(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, dialogue): a line for each message with text, with its prefix, in order."""
    known = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    line = F.concat(F.coalesce(F.try_element_at(known, F.col("type")), F.lit("")), "text", F.lit("\n"))
    lines = messages.where(F.trim("text") != "").select(key, F.struct(order, line.alias("line")).alias("x"))
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "").alias("dialogue"))


def expanded(messages: DataFrame, steps: DataFrame, missing: str = "[no result]") -> DataFrame:
    """(id, part, kind, text): what a model is shown for each message.

    A summary is marked as one; an assistant's message is preceded by its calls, in order, each with
    its last result or the placeholder. steps: (id, step_order, step_type, call_id, content).
    """
    results = steps.where("step_type = 'tool_result'").groupBy("id", "call_id").agg(F.max_by("content", "step_order").alias("result"))
    calls = steps.where("step_type = 'tool_call'").join(results, ["id", "call_id"], "left")
    pair = F.array(F.struct(F.lit("tool_call").alias("kind"), F.col("content").alias("text")), F.struct(F.lit("tool_result").alias("kind"), F.coalesce("result", F.lit(missing)).alias("text")))
    before = calls.select("id", "step_order", F.posexplode(pair).alias("half", "x")).select("id", "step_order", "half", "x.*")
    own = messages.select("id", F.lit(None).cast("long").alias("step_order"), F.lit(0).alias("half"), F.col("type").alias("kind"), F.when(F.col("type") == "summary", F.concat(F.lit("[summary] "), "text")).otherwise(F.col("text")).alias("text"))
    shown = before.join(messages.where("type = 'assistant'").select("id"), "id", "left_semi").withColumn("step_order", F.col("step_order").cast("long")).unionByName(own)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("step_order"), "half")) - 1
    return shown.select("id", place.alias("part"), "kind", "text")


def step_parents(steps: DataFrame) -> DataFrame:
    """(session, step_order, node, parent): steps as a tree.

    A result is merged into the first call of its id, a sub-agent's end into its start: their node is
    that step's. Others are their own node. parent is the node's parent step, null at the top.
    """
    opened = F.col("step_type").isin("tool_call", "agent_start")
    role = F.when(F.col("step_type").isin("tool_call", "tool_result"), F.concat(F.lit("t"), "call_id")).when(F.col("step_type").isin("agent_start", "agent_end"), F.concat(F.lit("a"), "agent_id"))
    keyed = steps.withColumn("_role", role)
    starts = keyed.where(opened & F.col("_role").isNotNull()).groupBy("session", "_role").agg(F.min("step_order").alias("_start"), F.min_by("parent_step", "step_order").alias("_above"))
    merged = keyed.join(starts, ["session", "_role"], "left")
    closes = F.col("step_type").isin("tool_result", "agent_end") & F.col("_start").isNotNull()
    return merged.select("session", "step_order", F.when(closes, F.col("_start")).otherwise(F.col("step_order")).alias("node"), F.when(closes, F.col("_above")).otherwise(F.col("parent_step")).alias("parent"))


def without_turns(turns: DataFrame, rules: DataFrame) -> DataFrame:
    """Turns whose first message isn't named by a rule. turns: with conv_id, turn_no, id."""
    first = turns.groupBy("conv_id", "turn_no").agg(F.min("id").alias("first_id"))
    return turns.join(first.join(rules, "first_id", "left_semi").select("conv_id", "turn_no"), ["conv_id", "turn_no"], "left_anti")


def latest_rules(ops: DataFrame) -> DataFrame:
    """(session, rule, content) in force after a log of ADD, REPLACE and REMOVE in ``at`` order; a replacement of an absent rule adds it."""
    last = ops.groupBy("session", "rule").agg(F.max_by(F.struct("op", "content"), "at").alias("x"))
    return last.where("x.op <> 'REMOVE'").select("session", "rule", "x.content")


def evicted(topics: DataFrame, keep: int = 3, by: str = "user_id") -> DataFrame:
    """Topics beyond the newest ``keep`` of a user; those without a start go first."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("started_at"), F.desc("topic")))
    return topics.withColumn("_r", rank).where(F.col("_r") > keep).drop("_r")


def archive(topic: Column, plan: Column, goal: Column, started: Column, ended: Column) -> Column:
    """The text of a finished topic; ``(无)`` for blank parts."""
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(无)"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    begun = F.coalesce(F.concat(F.lit("## 开始时间\n"), stamp(started), F.lit("\n\n")), F.lit(""))
    return F.concat(F.lit("# History: "), topic, F.lit("\n\n## 学习主题\n"), topic, F.lit("\n\n## 学习成果\n"), some(plan), F.lit("\n\n## 学习总结\n"), some(goal), F.lit("\n\n"), begun, F.lit("## 完成时间\n"), stamp(ended), F.lit("\n"))


def history_search(files: DataFrame, word: str | None, limit: int) -> DataFrame:
    """(path, snippet): archived files, newest path first, that hold the word; the newest of all for a blank word. Hidden folders are left out."""
    from quillspark.functions import text as T

    parts = F.split("path", "/")
    seen = files.where(F.startswith(F.col("path"), F.lit("History/")) & F.endswith(F.col("path"), F.lit(".md")) & ~F.array_contains(parts, ".raw") & ~F.array_contains(parts, ".trash"))
    hit = T.snippet(F.col("content"), word.strip()) if word and word.strip() else F.lit(None).cast("string")
    found = seen.select("path", hit.alias("snippet"))
    return (found.where("snippet is not null") if word and word.strip() else found).orderBy(F.desc("path")).limit(limit)


def active_path(leaves: DataFrame, messages: DataFrame) -> DataFrame:
    """leaves (id, ...) with one row for each message up to the root: id, and depth from the leaf."""
    up = conversation.paths_to_root(messages, leaves.select("id"))
    return up.join(leaves.withColumnRenamed("id", "anchor"), "anchor").drop("anchor")


def is_descendant(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """pairs (id, ancestor) with ``below``: whether the one stands anywhere below the other."""
    up = conversation.paths_to_root(messages, pairs.select("id").distinct()).where("depth > 0").select(F.col("anchor").alias("id"), F.col("id").alias("ancestor"))
    found = up.withColumn("below", F.lit(True))
    return pairs.join(found, ["id", "ancestor"], "left").withColumn("below", F.coalesce("below", F.lit(False)))


def directory(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent, name, folder, rank): all folders and files of some paths; within a folder the folders come first, then names."""
    parts = paths.select(F.split(path, "/").alias("s")).distinct()
    steps = parts.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d"))
    joined = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    entries = steps.select(joined(F.col("d")).alias("path"), joined(F.col("d") - 1).alias("parent"), F.expr("s[d - 1]").alias("name"), (F.col("d") < F.size("s")).alias("folder"))
    whole = entries.groupBy("path", "parent", "name").agg(F.max("folder").alias("folder"))
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("folder"), "name")))
