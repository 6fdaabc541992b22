"""Queries over sessions: message trees, step trees, rules, topics, archives, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import conversation, learning, trees
from quillspark.plans.registry import query
from quillspark.sources.tables import messages, table

_MSG = """m AS (SELECT conv_id, conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn >= 4 AND turn % 4 = 0 THEN conv_id * 1000 + 1 ELSE conv_id * 1000 + turn - 1 END AS parent_id,
  turn, CASE WHEN role = 'system' THEN 'summary' ELSE role END AS type, text FROM conversations)"""


@query(f"WITH RECURSIVE {_MSG}, up AS (SELECT id AS anchor, parent_id AS pos, 1 AS depth FROM m UNION ALL SELECT anchor, m.parent_id, depth + 1 FROM up JOIN m ON m.id = pos), s AS (SELECT anchor, arg_min(pos, depth) AS summary_id FROM up JOIN m ON m.id = pos WHERE type = 'summary' GROUP BY anchor) SELECT id, summary_id FROM m LEFT JOIN s ON anchor = id")
def nearest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.nearest_summaries(messages(spark, sf_dir))


@query(f"WITH {_MSG} SELECT parent_id, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS children FROM m WHERE parent_id IS NOT NULL GROUP BY parent_id")
def children_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.children(messages(spark, sf_dir)).select("parent_id", F.size("children").cast("long").alias("n"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


_BELOW = f"{_MSG}, down AS (SELECT id FROM m WHERE turn = 3 UNION ALL SELECT m.id FROM down d JOIN m ON m.parent_id = d.id)"


@query(f"WITH RECURSIVE {_BELOW} SELECT conv_id, max(id) AS last_id, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM down) GROUP BY conv_id")
def subtree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return trees.without_subtrees(m, m.where("turn = 3")).groupBy("conv_id").agg(F.max("id").alias("last_id"), F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_MSG}, l AS (SELECT parent_id, max(id) AS next FROM m WHERE parent_id IS NOT NULL GROUP BY parent_id), walk AS (SELECT id AS root, id AS pos FROM m UNION ALL SELECT root, next FROM walk JOIN l ON parent_id = pos) SELECT root, pos AS leaf FROM walk WHERE pos NOT IN (SELECT parent_id FROM l)")
def last_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.last_leaves(messages(spark, sf_dir))


@query(f"WITH {_MSG} SELECT conv_id, string_agg(CASE type WHEN 'user' THEN '用户：' WHEN 'assistant' THEN '助手：' ELSE '' END || text || chr(10), '' ORDER BY turn) AS dialogue FROM m WHERE trim(text) <> '' GROUP BY conv_id")
def dialogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.dialogue(messages(spark, sf_dir))


# Steps of a message: a call for the turn before it and, for all but every third, its result.
_STEPS = f"""{_MSG}, steps AS (SELECT m.id, s AS step_order, CASE s % 2 WHEN 1 THEN 'tool_call' ELSE 'tool_result' END AS step_type, 'c' || ((s + 1) // 2) AS call_id, 'k' || s AS content FROM m, LATERAL (SELECT unnest(range(1, 4)) AS s) WHERE NOT (s = 2 AND id % 3 = 0))"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = messages(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("s")).where(~((s == 2) & (F.col("id") % 3 == 0)))
    return rows.select("id", s.alias("step_order"), F.when(s % 2 == 1, "tool_call").otherwise("tool_result").alias("step_type"), F.concat(F.lit("c"), F.expr("(s + 1) div 2").cast("string")).alias("call_id"), F.concat(F.lit("k"), s.cast("string")).alias("content"))


@query(f"""WITH {_STEPS}, r AS (SELECT id, call_id, arg_max(content, step_order) AS result FROM steps WHERE step_type = 'tool_result' GROUP BY ALL),
c AS (SELECT id, step_order, content, coalesce(result, '[no result]') AS result FROM steps LEFT JOIN r USING (id, call_id) WHERE step_type = 'tool_call' AND id IN (SELECT id FROM m WHERE type = 'assistant')),
a AS (SELECT id, step_order, 0 AS half, 'tool_call' AS kind, content AS text FROM c UNION ALL SELECT id, step_order, 1, 'tool_result', result FROM c UNION ALL SELECT id, NULL, 0, type, CASE type WHEN 'summary' THEN '[summary] ' || text ELSE text END FROM m)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY step_order NULLS LAST, half) - 1)::INT AS part, kind, text FROM a""")
def message_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.expanded(messages(spark, sf_dir), _steps(spark, sf_dir))


_TREE = """s AS (SELECT user_id AS session, event_id AS step_order, CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' WHEN 'signup' THEN 'agent_start' WHEN 'error' THEN 'agent_end' ELSE 'note' END AS step_type,
  (json_extract_string(props, '$.k')::INT % 3)::VARCHAR AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_step FROM events), r AS (SELECT *, CASE WHEN step_type LIKE 'tool%' THEN 't' || k WHEN step_type LIKE 'agent%' THEN 'a' || k END AS role FROM s),
o AS (SELECT session, role, min(step_order) AS start, arg_min_null(parent_step, step_order) AS above FROM r WHERE step_type IN ('tool_call', 'agent_start') GROUP BY ALL)"""


@query(f"WITH {_TREE} SELECT session, step_order, CASE WHEN c THEN start ELSE step_order END AS node, CASE WHEN c THEN above ELSE parent_step END AS parent FROM (SELECT r.*, start, above, step_type IN ('tool_result', 'agent_end') AND start IS NOT NULL AS c FROM r LEFT JOIN o USING (session, role))")
def step_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.expr("case event_type when 'view' then 'tool_call' when 'click' then 'tool_result' when 'signup' then 'agent_start' when 'error' then 'agent_end' else 'note' end")
    k = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    above = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return trees.step_parents(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step_order"), kind.alias("step_type"), k.alias("call_id"), k.alias("agent_id"), above.alias("parent_step")))


@query(f"WITH {_MSG}, t AS (SELECT *, sum((type IN ('user', 'summary'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM m), f AS (SELECT conv_id, no, min(id) AS first_id FROM t WHERE no > 0 GROUP BY ALL) SELECT id FROM t JOIN f USING (conv_id, no) WHERE first_id NOT IN (SELECT conv_id * 1000 FROM m)")
def projected_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    rules = m.select((F.col("conv_id") * 1000).alias("first_id")).distinct()
    return trees.without_turns(conversation.turns(m), rules).select("id")


@query("SELECT user_id AS session, event_id % 7 AS rule, arg_max(value, event_id) AS content FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error'")
def rule_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.expr("case event_type when 'error' then 'REMOVE' when 'view' then 'ADD' else 'REPLACE' end")
    return trees.latest_rules(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 7).alias("rule"), op.alias("op"), F.col("value").alias("content"), F.col("event_id").alias("at")))


@query("SELECT user_id, topic, started_at FROM (SELECT user_id, event_id % 11 AS topic, min(ts) AS started_at FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC NULLS LAST, topic DESC) > 3")
def topic_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 11).alias("topic")).agg(F.min("ts").alias("started_at"))
    return trees.evicted(topics)


@query("""SELECT o_orderkey, 'History/' || strftime(o_orderdate, '%Y-%m') AS folder, md5('# History: ' || p || chr(10) || chr(10) || '## 学习主题' || chr(10) || p || chr(10) || chr(10) || '## 学习成果' || chr(10) || '(无)' || chr(10) || chr(10) || '## 学习总结' || chr(10) || o_orderstatus || chr(10) || chr(10)
  || CASE o_orderstatus WHEN 'O' THEN '' ELSE '## 开始时间' || chr(10) || d || chr(10) || chr(10) END || '## 完成时间' || chr(10) || d || chr(10)) AS digest FROM (SELECT *, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d FROM orders)""")
def archive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    text = trees.archive(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"), begun, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("History/"), F.date_format("o_orderdate", "yyyy-MM")).alias("folder"), F.md5(text).alias("digest"))


_FILES = "f AS (SELECT 'History/2024-0' || (doc_id % 3 + 1) || CASE doc_id % 5 WHEN 0 THEN '/.raw/' ELSE '/' END || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, text FROM documents)"


@query(f"WITH {_FILES} SELECT path FROM f WHERE NOT contains(path, '/.raw/') AND contains(lower(text), 'er') ORDER BY path DESC LIMIT 5")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("History/2024-0"), (F.col("doc_id") % 3 + 1).cast("string"), F.when(F.col("doc_id") % 5 == 0, "/.raw/").otherwise("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    return trees.history_search(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), " ER ", 5).select("path")


@query("SELECT event_type, count(*) AS searches, count(*) FILTER (value >= 35) AS hits, round(max(value), 6) AS best, array_to_string(list(event_id ORDER BY value DESC, event_id)[:10], ',') AS top FROM events GROUP BY event_type")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event stands for a search, its value for the score."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return learning.search_stats(rows, "event_type", "event_id", "value", 35)
