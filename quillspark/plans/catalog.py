"""Registry of the engine's named queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import containers, conversation, learning, retrieval, steps, tables
from quillspark.plans import parser_twins
from quillspark.plans.registry import oracle_sql, queries, query
from quillspark.sources import html
from quillspark.sources.tables import messages, table
from quillspark.streaming import requests

__all__ = ["oracle_sql", "queries"]

def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _query_words(spark: SparkSession, sf_dir: str) -> list[str]:
    text = table(spark, sf_dir, "benchmark").where("item_id = 0").select(T.keywords(F.col("text"))).first()[0]
    return list(text)


_TOKENS = r"regexp_extract_all(lower(text), '([\p{L}0-9]+)', 1)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_DENSE = """q AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20)"""
_WORDS = rf"""toks AS (SELECT unnest({_TOKENS}) t, generate_subscripts({_TOKENS}, 1) i FROM benchmark WHERE item_id = 0),
firsts AS (SELECT t, min(i) i FROM toks WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY t)"""
_RANKED = r"""asked AS (SELECT count(*) AS k FROM firsts),
counts AS (SELECT id, t, count(*) AS n FROM dtok WHERE t IN (SELECT t FROM firsts) GROUP BY ALL),
anys AS (SELECT id, count(*) = (SELECT k FROM asked) AS every, sum(list_sum([1.0::DOUBLE / (j * j) FOR j IN range(1, n + 1)])) * 0.1 / 1.64493406685 / (SELECT k FROM asked) AS score FROM counts GROUP BY id),
full_ AS (SELECT d.* FROM dtok d JOIN anys USING (id) WHERE every AND t IN (SELECT t FROM firsts)),
everys AS (SELECT x.id, 1 - product(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(x.i - y.i) / 1.5 - 2)))) AS score FROM full_ x JOIN full_ y ON x.id = y.id AND y.t < x.t AND abs(x.i - y.i) <= 100 GROUP BY x.id),
hits AS (SELECT a.id, every, round(CASE WHEN every AND (SELECT k FROM asked) > 1 THEN coalesce(e.score, 0) ELSE a.score END, 6) AS score FROM anys a LEFT JOIN everys e USING (id))"""
_SPARSE = rf"""{_WORDS},
dtok AS (SELECT doc_id AS id, unnest({_TOKENS}) t, generate_subscripts({_TOKENS}, 1) i FROM documents), {_RANKED},
sparse AS (SELECT id, score FROM hits WHERE every OR NOT (SELECT bool_or(every) FROM hits) ORDER BY score DESC, id LIMIT 20)"""
_FUSED = f"""{_DENSE}, {_SPARSE},
parts AS (SELECT id, score AS d, NULL AS s, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM dense
  UNION ALL SELECT id, NULL, score, 0.3 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM sparse),
fused AS (SELECT id, coalesce(max(d), max(s)) AS score, round(sum(part::DOUBLE), 9) AS rrf FROM parts GROUP BY id)"""


@query(f"WITH {_DENSE} SELECT * FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_recall(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) <= 20""")
def dense_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_recall_many(vectors, vectors.where("vec_id % 50 = 0"))


@query(f"WITH {_DENSE} SELECT id, score, lang, source FROM dense LEFT JOIN documents ON doc_id = id")
def dense_join_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return retrieval.looked_up(dense_topk(spark, sf_dir), docs, "id")


@query(f"WITH {_SPARSE} SELECT * FROM sparse")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_recall(table(spark, sf_dir, "documents"), _query_words(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT * FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(dense_topk(spark, sf_dir), keyword_topk(spark, sf_dir))


@query(f"WITH {_FUSED}, top AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 5) SELECT t.*, lang, source FROM top t LEFT JOIN documents ON doc_id = id")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return retrieval.looked_up(retrieval.top_k(rrf_fuse(spark, sf_dir)), docs, "id")


@query(f"WITH {_FUSED}, top AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 5) SELECT * FROM top WHERE score >= 0.35")
def hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(rrf_fuse(spark, sf_dir), threshold=0.35)


@query(f"WITH {_FUSED}, r AS (SELECT *, id // 4 AS parent, row_number() OVER (PARTITION BY id // 4 ORDER BY score DESC, rrf DESC, id) rn FROM fused) SELECT id, score, rrf, parent FROM r WHERE rn = 1")
def parent_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.collapse_to_parents(rrf_fuse(spark, sf_dir).withColumn("parent", F.expr("id div 4")))


@query(rf"SELECT item_id, array_to_string(list_distinct_first, ' & ') AS query FROM (SELECT item_id, (SELECT list(t ORDER BY i) FROM (SELECT t, min(i) i FROM (SELECT unnest(x) t, generate_subscripts(x, 1) i) WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY t)) AS list_distinct_first FROM (SELECT item_id, {_TOKENS} AS x FROM benchmark))")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " & ").alias("query"))


@query("SELECT doc_id, regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS cleaned FROM documents")
def strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in every kind of wrapper: pairs of tags, brackets and dashes, several at once, one left open, none."""
    text = F.col("text")
    made = [
        F.concat(F.lit("<think>plan</think>"), text, F.lit("\n[thinking] left open")), F.concat(F.lit("[REASONING]a\nb[/Reasoning] "), text), F.concat(text, F.lit(" ---thought---x---/thought---")),
        F.concat(F.lit("<thought>a</thought>[think]b[/think]"), text, F.lit("<Thinking>c")), text,
    ]
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_reasoning(F.coalesce(*(F.when(F.col("doc_id") % 5 == i, m) for i, m in enumerate(made)))).alias("cleaned"))


@query("SELECT conv_id, turn, CASE WHEN length(text) < 50 OR (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 15 AND NOT contains(text, '.')) THEN 'weak' ELSE 'general' END AS chunk_type FROM conversations")
def chunk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chunk_type(F.col("text")).alias("chunk_type"))


@query("WITH s AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: length(regexp_replace(x, '\\s+', '', 'g')) > 0)) x FROM documents) SELECT doc_id, count(*) AS sentences, max(length(x)) AS longest FROM s GROUP BY doc_id")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("x")).cast("long").alias("longest"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$'), lambda x: length(regexp_replace(x, '\s+', '', 'g')) > 0) AS l FROM documents),
r AS (SELECT doc_id, 1 AS i, 0 AS bin, length(l[1]) AS used FROM s WHERE len(l) > 0 UNION ALL
  SELECT doc_id, i + 1, CASE WHEN used + length(l[i + 1]) + 2 > 300 THEN bin + 1 ELSE bin END, CASE WHEN used + length(l[i + 1]) + 2 > 300 THEN length(l[i + 1]) ELSE used + length(l[i + 1]) + 2 END FROM r JOIN s USING (doc_id) WHERE i < len(l))
SELECT doc_id, bin AS sort_order, string_agg(l[i], chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN s USING (doc_id) GROUP BY doc_id, bin""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", T.packed(T.sentences(F.col("text")), 300, 2).alias("chunks"))
    return parts.select("doc_id", F.posexplode("chunks").alias("sort_order", "text"))


_MSG = """m AS (SELECT conv_id, conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn >= 4 AND turn % 4 = 0 THEN conv_id * 1000 + 1 ELSE conv_id * 1000 + turn - 1 END AS parent_id,
  turn, CASE WHEN role = 'system' THEN 'summary' ELSE role END AS type, text FROM conversations)"""
_UP = f"{_MSG}, up AS (SELECT id AS anchor, id, parent_id, 0 AS depth FROM m UNION ALL SELECT u.anchor, m.id, m.parent_id, u.depth + 1 FROM up u JOIN m ON m.id = u.parent_id)"


@query(f"WITH RECURSIVE {_UP} SELECT anchor, id, depth FROM up")
def path_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return conversation.paths_to_root(m, m)


@query(f"WITH RECURSIVE {_UP}, t AS (SELECT u.anchor, u.id, depth, type, min(CASE WHEN type = 'summary' THEN depth END) OVER (PARTITION BY u.anchor) near FROM up u JOIN m USING (id)) SELECT anchor, id, depth, type FROM t WHERE near IS NULL OR depth <= near")
def summary_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return conversation.since_summary(conversation.paths_to_root(m, m), m)


@query(f"WITH RECURSIVE {_MSG}, down AS (SELECT id AS root, id, 0 AS depth FROM m WHERE turn = 1 UNION ALL SELECT d.root, m.id, d.depth + 1 FROM down d JOIN m ON m.parent_id = d.id) SELECT * FROM down")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return conversation.subtrees(m, m.where("turn = 1"))


@query(f"WITH {_MSG}, t AS (SELECT *, sum((type IN ('user', 'summary'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM m) SELECT conv_id, turn_no, min(id) AS first_id, count(*) AS messages FROM t WHERE turn_no > 0 GROUP BY ALL")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turns(messages(spark, sf_dir)).groupBy("conv_id", "turn_no").agg(F.min("id").alias("first_id"), F.count("*").alias("messages"))


@query(f"WITH {_MSG} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m QUALIFY back <= 3")
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_messages(messages(spark, sf_dir), 3).select("conv_id", "id", "back")


@query("WITH t AS (SELECT conv_id, sum(coalesce(floor(length(text) * 1.5), 0))::BIGINT AS tokens FROM conversations GROUP BY 1) SELECT conv_id, tokens, CASE WHEN tokens / 4000 >= 0.9 THEN 'SUMMARY' WHEN tokens / 4000 >= 0.8 THEN 'SNIP' WHEN tokens / 4000 >= 0.6 THEN 'REWRITE' ELSE 'FULL' END AS policy FROM t")
def token_budget_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.budget_policy(messages(spark, sf_dir), 4000)


_PLAN = "CASE o_orderstatus WHEN 'O' THEN 'not_started' WHEN 'F' THEN 'completed' ELSE 'in_progress' END"


@query(f"SELECT o_custkey, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'in_progress') AS in_progress, count(*) FILTER (s = 'not_started') AS not_started, floor(100.0 * count(*) FILTER (s = 'completed') / count(*) + 0.5)::INT AS percent, CASE WHEN bool_and(s = 'completed') THEN 'completed' WHEN bool_and(s = 'not_started') THEN 'not_started' ELSE 'in_progress' END AS plan_status FROM (SELECT o_custkey, {_PLAN} AS s FROM orders) GROUP BY 1")
def progress_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.progress(table(spark, sf_dir, "orders").select("o_custkey", F.expr(_PLAN).alias("status")), "o_custkey", "status")


@query("SELECT quality AS answer, count(*) AS total, count(*) FILTER (quality = toxic) AS correct FROM labels GROUP BY 1")
def exam_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = table(spark, sf_dir, "labels").withColumn("ok", learning.answer_matches(F.lit("single_choice"), F.concat(F.lit(" "), F.col("quality").cast("string")), F.col("toxic").cast("string")))
    return graded.groupBy(F.col("quality").alias("answer")).agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def docs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.page(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 2, 0)


@query("SELECT source, count(*) AS documents, count(*) FILTER (n_chars >= 1000) AS long_documents FROM documents GROUP BY 1")
def docs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") >= 1000).alias("long_documents"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY ALL")
def activity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.activity(table(spark, sf_dir, "events"), "click", "2024-01-05", "2024-01-12")


@query(f"WITH {_MSG} SELECT id, lag(text, 1) OVER w AS before, lead(text, 1) OVER w AS after FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages(spark, sf_dir).select("id", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def retry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.error_windows(table(spark, sf_dir, "events"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, k")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.idle_sessions(table(spark, sf_dir, "events"))


_STEPS = """steps AS (SELECT user_id AS session, event_id AS step_order, CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' ELSE 'note' END AS step_type,
  CASE WHEN value > 50 THEN 'search' ELSE 'read' END AS tool, (json_extract_string(props, '$.k')::INT % 3)::VARCHAR AS call_id, repeat('x', floor(value)::INT * 4) AS content FROM events)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "tool_call").when(F.col("event_type") == "click", "tool_result").otherwise("note")
    call = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    content = F.repeat(F.lit("x"), F.floor("value").cast("int") * 4)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step_order"), kind.alias("step_type"), F.when(F.col("value") > 50, "search").otherwise("read").alias("tool"), call.alias("call_id"), content.alias("content"))


@query(f"WITH {_STEPS}, r AS (SELECT session, call_id, arg_max(content, step_order) AS c FROM steps WHERE step_type = 'tool_result' GROUP BY ALL) SELECT session, call_id, step_order AS call_order, md5(coalesce(c, '[no result]')) AS digest FROM steps LEFT JOIN r USING (session, call_id) WHERE step_type = 'tool_call'")
def tool_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.paired(_steps(spark, sf_dir)).select("session", "call_id", "call_order", F.md5("content").alias("digest"))


@query(f"WITH {_STEPS} SELECT session, md5(arg_max(content, step_order)) AS digest FROM steps WHERE step_type = 'tool_result' AND tool = 'search' GROUP BY session")
def latest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.latest(_steps(spark, sf_dir), "search").select("session", F.md5("content").alias("digest"))


@query(f"WITH {_STEPS} SELECT session, call_id, floor(length(content) * 1.5)::INT AS tokens FROM steps WHERE step_type = 'tool_result' AND tool = 'read' AND floor(length(content) * 1.5) >= 200 QUALIFY row_number() OVER (PARTITION BY session, call_id ORDER BY step_order) = 1")
def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.rewrite_rules(_steps(spark, sf_dir), ("read",))


@query("SELECT doc_id, list_concat([x FOR x IN l IF x <> 2], [9]) AS items FROM (SELECT doc_id, [1, 2, quality] AS l FROM labels WHERE quality <> 2)")
def container_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.lit(1), F.lit(2), F.col("quality"))
    return table(spark, sf_dir, "labels").where("quality <> 2").select("doc_id", containers.appended(containers.removed(items, 1), F.array(F.lit(9))).alias("items"))


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'done' ELSE url END AS url FROM pages WHERE page_id % 7 <> 0")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    kept = tables.deleted(pages, pages.where("page_id % 7 = 0"), "page_id")
    return tables.updated(kept, F.col("page_id") % 10 == 0, url=F.lit("done"))


@query(parser_twins.HTML_SQL)
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_nodes(table(spark, sf_dir, "pages"))


from quillspark.plans import documents, layouts, mutations, records, search, sessions, statements  # noqa: E402, F401  they register their queries after these
