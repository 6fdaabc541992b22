"""Queries over nodes, uploads, containers, exams, plans and small texts; given tables stand for them as each view says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks, containers, ingest, learning, steps, tables, trees
from quillspark.operators import nodes as N
from quillspark.plans import parser_twins
from quillspark.plans.registry import query
from quillspark.sources import workspace
from quillspark.sources.tables import messages, table
from quillspark.streaming import machines, requests

_LF = "chr(10)"


def _view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A stand-in table, by expressions that Spark and DuckDB read alike."""
    return table(spark, sf_dir, name).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def _cte(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


# Events stand for nodes.
_NODE = {
    "doc": "user_id", "pos": "event_id", "raw": "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'chart' ELSE CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'code' WHEN 'signup' THEN 'Table' WHEN 'purchase' THEN 'IMAGE' ELSE 'formula' END END",
    "content": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END", "language": "CASE WHEN event_id % 2 = 0 THEN 'python' ELSE NULL END", "caption": "CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'seen' ELSE NULL END", "semantic": "CASE WHEN event_id % 5 = 0 THEN 'described' ELSE NULL END",
}
_KIND = "CASE WHEN upper(raw) IN ('TEXT', 'HEADING', 'IMAGE', 'CODE', 'TABLE', 'FORMULA') THEN upper(raw) ELSE 'TEXT' END"
_KINDS = f"{_cte('raw_nodes', 'events', _NODE)}, n AS (SELECT *, {_KIND} AS kind FROM raw_nodes)"
_BACK = f"""CASE kind WHEN 'CODE' THEN '[代码语言: ' || coalesce(language, '未知语言') || ']' || {_LF} || coalesce(content, '无代码内容') WHEN 'TABLE' THEN coalesce(content, '无表格内容') WHEN 'FORMULA' THEN coalesce(content, '无公式内容')
  WHEN 'IMAGE' THEN coalesce(nullif(trim(caption), ''), '[图片]') ELSE coalesce(content, '') END"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", _NODE).withColumn("kind", N.kind_of(F.col("raw")))


@query(f"""WITH {_KINDS} SELECT doc, pos, kind, CASE WHEN kind = 'TEXT' THEN coalesce(content, '') ELSE '[[NODE:' || kind || ':' || pos || ']]' END AS shown,
  CASE WHEN kind = 'TEXT' THEN coalesce(content, '') WHEN semantic IS NOT NULL THEN semantic WHEN kind = 'CODE' THEN '[代码块(' || coalesce(language, '未知语言') || '): ' || pos || ']' WHEN kind = 'TABLE' THEN '[表格: ' || pos || ']'
    WHEN kind = 'IMAGE' THEN '[图片: ' || coalesce(nullif(trim(caption), ''), pos::VARCHAR) || ']' ELSE '[公式: ' || coalesce(content, pos::VARCHAR) || ']' END AS indexed, {_BACK} AS background FROM n""")
def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, node, content, language, caption = F.col("kind"), F.col("pos").cast("string"), F.col("content"), F.col("language"), F.col("caption")
    return _nodes(spark, sf_dir).select(
        "doc", "pos", "kind", N.shown(kind, node, content).alias("shown"), N.indexed(kind, node, content, language, caption, F.col("semantic")).alias("indexed"), N.background(kind, content, language, caption).alias("background")
    )


@query(f"""WITH {_KINDS} SELECT doc, pos // 100 AS chunk, coalesce(list('id=' || pos || ';type=' || lower(kind) || CASE kind WHEN 'CODE' THEN coalesce(';language=' || language, '') || coalesce(';code=' || content, '') WHEN 'TABLE' THEN coalesce(';html=' || content, '')
  WHEN 'FORMULA' THEN coalesce(';formula=' || content, '') ELSE ';imagePath=p' || pos || coalesce(';caption=' || caption, '') END ORDER BY pos) FILTER (kind <> 'TEXT'), []) AS metadata FROM n GROUP BY ALL""")
def node_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct("pos", F.col("pos").cast("string").alias("id"), "kind", "content", "language", "caption", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("image"))
    made = _nodes(spark, sf_dir).groupBy("doc", F.expr("pos div 100").alias("chunk")).agg(F.array_sort(F.collect_list(node)).alias("n"))
    flat = F.transform(N.metadata_of(F.col("n")), lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))
    return made.select("doc", "chunk", flat.alias("metadata"))


@query(f"WITH {_KINDS} SELECT doc, md5(string_agg({_BACK}, {_LF} || {_LF} ORDER BY pos)) AS digest FROM n GROUP BY doc")
def node_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.full_background(_nodes(spark, sf_dir)).select("doc", F.md5("background").alias("digest"))


_TYPE = "CASE page_id % 5 WHEN 0 THEN ' .JAVA' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' WHEN 3 THEN '' ELSE NULL END"


@query(f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 2) THEN 'whole' ELSE 'near' END AS context FROM pages")  # noqa: F541
def context_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.context_of(F.expr(_TYPE), F.lit("whole"), F.lit("near")).alias("context"))


@query("""WITH b AS (SELECT user_id AS doc, event_id AS pos, CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'list' WHEN 'signup' THEN 'equation' WHEN 'purchase' THEN 'code' ELSE 'footer' END AS type, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE ' import ' || props END AS text, event_id % 9 AS level FROM events)
SELECT doc, pos, CASE type WHEN 'title' THEN 'heading' WHEN 'list' THEN 'text' WHEN 'equation' THEN 'formula' ELSE type END AS type, CASE WHEN type = 'list' THEN 'a' || chr(10) || 'b' ELSE trim(text) END AS text, CASE WHEN type = 'title' THEN greatest(least(level, 6), 1)::BIGINT END AS level, CASE WHEN type = 'code' THEN 'python' END AS language
FROM b WHERE type <> 'footer' AND (type = 'list' OR trim(text) <> '')""")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_type when 'view' then 'title' when 'click' then 'list' when 'signup' then 'equation' when 'purchase' then 'code' else 'footer' end")
    text = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit(" import "), "props"))
    blocks = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), kind.alias("type"), text.alias("text"), (F.col("event_id") % 9).alias("level"), F.lit(" ").alias("code"), F.array(F.lit(" a"), F.lit(" "), F.lit("b ")).alias("items"))
    return N.from_blocks(blocks)


@query("SELECT l_orderkey AS doc, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 2, CASE WHEN l_partkey % 3 > 0 THEN l_quantity END NULLS LAST, l_linenumber)::INT AS rank FROM lineitem")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 2).alias("page"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity")).alias("top"))
    return N.page_order(items).select("doc", "pos", "rank")


# Pages stand for known files, every third of them for an upload under the same name, with or without the wish to overwrite.
_FILE = {"user_id": "page_id % 5", "file_name": "concat('f', CAST(page_id % 40 AS VARCHAR(9)))", "id": "page_id"}
_UPLOAD = {"user_id": "page_id % 7", "file_name": "concat('f', CAST(page_id % 45 AS VARCHAR(9)))", "overwrite": "CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END"}
_UPLOADS = f"{_cte('known', 'pages', _FILE)}, {_cte('uploads', '(SELECT * FROM pages WHERE page_id < 40)', _UPLOAD)}, judged AS (SELECT u.*, k.id AS duplicate_id, (CASE WHEN k.id IS NOT NULL AND NOT coalesce(overwrite, false) THEN 2 ELSE 1 END)::INT AS code FROM uploads u LEFT JOIN (SELECT user_id, file_name, max(id) AS id FROM known GROUP BY ALL) k USING (user_id, file_name))"


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _view(spark, sf_dir, "pages", _FILE)
    new = table(spark, sf_dir, "pages").where("page_id < 40").select(*(F.expr(e).alias(c) for c, e in _UPLOAD.items()))
    return known, new


@query(f"WITH {_UPLOADS} SELECT * FROM judged")
def upload_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = _uploads(spark, sf_dir)
    return ingest.upload_codes(new, known)


@query(f"WITH {_UPLOADS} SELECT * FROM known WHERE id NOT IN (SELECT duplicate_id FROM judged WHERE code = 1 AND duplicate_id IS NOT NULL) UNION ALL SELECT user_id, file_name, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY user_id, file_name) FROM judged WHERE code = 1")
def uploads_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.taken_in(*_uploads(spark, sf_dir))


_CHUNK = {"doc_id": "l_orderkey", "sort_order": "l_linenumber - 1", "chunk_level": "CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END", "parent_order": "CASE WHEN l_linenumber > 1 AND l_linenumber < 5 THEN 0 ELSE NULL END"}


@query(f"WITH {_cte('r', 'lineitem', _CHUNK)}, c AS (SELECT DISTINCT * FROM r), n AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_level, sort_order) AS id FROM c) SELECT n.doc_id, n.sort_order, n.id, p.id AS parent_id FROM n LEFT JOIN n p ON p.doc_id = n.doc_id AND p.chunk_level = 1 AND p.sort_order = n.parent_order")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _view(spark, sf_dir, "lineitem", _CHUNK).distinct()
    return ingest.chunk_ids(made).select("doc_id", "sort_order", "id", "parent_id")


_SMALL = {"doc_id": "l_orderkey", "sort_order": "l_linenumber - 1", "chunk_level": "CASE WHEN l_linenumber = 3 THEN 1 ELSE 2 END", "parent_order": "CASE WHEN l_linenumber > 3 THEN 2 ELSE NULL END"}


@query(f"""WITH RECURSIVE {_cte('c', '(SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)', _SMALL | {'text': "repeat('x', CAST(q AS INT))"})},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sort_order) AS i, chunk_level <> 1 AND length(text) BETWEEN 1 AND 39 AS small FROM c),
w AS (SELECT doc_id, i, i AS head, length(text) AS used, small, parent_order FROM n WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN n.small AND w.small AND n.parent_order IS NOT DISTINCT FROM w.parent_order AND w.used + 2 + length(n.text) <= 60 THEN w.head ELSE n.i END,
    CASE WHEN n.small AND w.small AND n.parent_order IS NOT DISTINCT FROM w.parent_order AND w.used + 2 + length(n.text) <= 60 THEN w.used + 2 + length(n.text) ELSE length(n.text) END, n.small, n.parent_order FROM w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
g AS (SELECT doc_id, head, string_agg(text, {_LF} || {_LF} ORDER BY i) AS text FROM w JOIN n USING (doc_id, i) GROUP BY ALL),
o AS (SELECT g.*, n.sort_order AS old, n.chunk_level, n.parent_order AS parent, (row_number() OVER (PARTITION BY g.doc_id ORDER BY head) - 1)::INT AS sort_order FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.head)
SELECT o.doc_id, o.sort_order, o.chunk_level, p.sort_order AS parent_order, o.text FROM o LEFT JOIN o p ON p.doc_id = o.doc_id AND p.old = o.parent""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    made = rows.select(*(F.expr(e).alias(c) for c, e in (_SMALL | {"text": "repeat('x', CAST(q AS INT))"}).items()))
    return chunks.merged_small(made, 40, 60)


# Line items stand for the nodes of an order, some of them over the budget alone, some of a group.
_SIZED = {"doc_id": "l_orderkey", "pos": "l_linenumber", "text": "repeat('x', CAST(q * 8 AS INT))", "title_path": "concat('t', CAST(l_linenumber AS VARCHAR(9)))", "group_id": "CASE WHEN f = 'N' THEN NULL ELSE f END"}
_CHUNKED = parser_twins.chunked(_cte('r', '(SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)', _SIZED))


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    return chunks.chunks(rows.select(*(F.expr(e).alias(c) for c, e in _SIZED.items())))


@query(f"WITH RECURSIVE {_CHUNKED} SELECT doc_id, sort_order, chunk_level, parent_order, chunk_level = 2 AS searchable, title_path, nodes, md5(text) AS digest FROM made")
def node_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).withColumn("digest", F.md5("text")).drop("text")


@query(f"WITH RECURSIVE {_CHUNKED}, {parser_twins.CONTEXT} SELECT doc_id, sort_order, md5(context) AS digest FROM context")
def node_chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.with_context(_chunked(spark, sf_dir)).select("doc_id", "sort_order", F.md5("context").alias("digest"))


_HANDLED = {"id": "doc_id", "text": "CASE WHEN doc_id % 3 = 0 THEN concat('# T', CAST(doc_id AS VARCHAR(9)), '\n', text) ELSE left(text, doc_id % 90) END", "title_path": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END", "chunk_type": "CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'node_based' END",
            "context_prefix": "CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE NULL END", "chunk_level": "CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 2 END", "searchable": "CASE WHEN doc_id % 11 = 0 THEN false ELSE NULL END"}


_HANDLED_SQL = rf"""WITH {_cte('c', 'documents', {k: v.replace(chr(92) + 'n', "' || chr(10) || '") for k, v in _HANDLED.items()})},
t AS (SELECT *, CASE WHEN chunk_type = 'table' THEN 'table' WHEN contains(x, '```') THEN 'code' WHEN regexp_matches(x, '(?m)^\|.*\|') THEN 'table' WHEN regexp_matches(x, '(?m)^(Q|A)[:：]') THEN 'qa' WHEN regexp_matches(x, '(?m)^#{{1,6}}\s') THEN 'heading'
  WHEN length(x) < 50 OR (len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) < 15 AND NOT contains(x, '.')) THEN 'weak' ELSE 'general' END AS kind, coalesce(nullif(title_path, ''), CASE WHEN id % 3 = 0 AND text IS NOT NULL THEN 'T' || id END) AS title FROM (SELECT *, coalesce(text, '') AS x FROM c)),
p AS (SELECT *, CASE WHEN kind = 'weak' AND context_prefix IS NULL THEN CASE WHEN id % 2 = 0 THEN 'near ' || id END ELSE context_prefix END AS prefix, coalesce(searchable, coalesce(chunk_level = 2, false)) AS flag FROM t)"""


@query(rf"""{_HANDLED_SQL}
SELECT id, kind AS chunk_type, title AS title_path, prefix AS context_prefix, flag AS searchable, array_to_string(regexp_extract_all(lower(concat_ws(' ', prefix, title, text)), '[\p{{L}}0-9]+'), ' ') AS ts_content,
  CASE WHEN flag THEN regexp_replace(coalesce(nullif(prefix, '') || ' ', '') || coalesce(nullif(title, '') || ' ', '') || x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') END AS embedding_text FROM p""")
def handled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through all handlers: kind, title, prefix, search text, flag, embedded text."""
    made = _view(spark, sf_dir, "documents", _HANDLED)
    prefixes = made.where("id % 2 = 0").select("id", F.concat(F.lit("near "), F.col("id").cast("string")).alias("prefix"))
    steps_ = [(5, chunks.embedded), (0, chunks.classified), (2, chunks.prefixed(prefixes)), (1, chunks.titled), (4, chunks.flagged), (3, chunks.indexed)]
    return chunks.handled(made, steps_).drop("text", "chunk_level")


@query(rf"""{_HANDLED_SQL}
SELECT id, kind AS chunk_type, title AS title_path, CASE WHEN kind = 'table' THEN context_prefix ELSE prefix END AS context_prefix, CASE WHEN kind = 'table' THEN searchable ELSE flag END AS searchable,
  CASE WHEN kind <> 'table' THEN array_to_string(regexp_extract_all(lower(concat_ws(' ', prefix, title, text)), '[\p{{L}}0-9]+'), ' ') END AS ts_content,
  CASE WHEN flag AND kind <> 'table' THEN regexp_replace(coalesce(nullif(prefix, '') || ' ', '') || coalesce(nullif(title, '') || ' ', '') || x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') END AS embedding_text FROM p""")
def stopped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chain, which ends for tables once they have a title."""
    made = _view(spark, sf_dir, "documents", _HANDLED)
    prefixes = made.where("id % 2 = 0").select("id", F.concat(F.lit("near "), F.col("id").cast("string")).alias("prefix"))
    stop = chunks.stopping(F.col("chunk_type") == "table")
    steps_ = [(5, chunks.embedded), (0, chunks.classified), (2, chunks.prefixed(prefixes)), (1, chunks.titled), (1.5, stop), (4, chunks.flagged), (3, chunks.indexed)]
    return chunks.handled(made, steps_).drop("text", "chunk_level")


@query("SELECT 'files' AS what, count(*) AS n FROM pages WHERE page_id % 9 <> 2 UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id % 300 NOT IN (SELECT page_id FROM pages WHERE page_id % 9 = 2) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id % 300 NOT IN (SELECT page_id FROM pages WHERE page_id % 9 = 2)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after files are deleted with their chunks and vectors."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    chunks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("document_id"))
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 300).alias("document_id"))
    left = tables.cascade(files, [(chunks, "document_id"), (vectors, "document_id")], files.where("id % 9 = 2"), "id")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in zip(("files", "chunks", "vectors"), left, strict=True)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'unsupported' WHEN page_id % 5 = 1 THEN 'pdf' WHEN page_id % 5 = 2 THEN 'text' ELSE 'unsupported' END AS type, md5(CASE WHEN page_id % 6 = 0 THEN 'not ready' WHEN page_id % 5 IN (1, 2) THEN html ELSE 'not shown' END) AS digest FROM pages")  # noqa: F541
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 6 == 0, " ").otherwise(F.col("url"))
    seen = table(spark, sf_dir, "pages").select("page_id", ingest.preview(F.expr(_TYPE), path, F.col("html")).alias("p"))
    return seen.select("page_id", "p.type", F.md5("p.text").alias("digest"))


@query("""WITH r AS (SELECT user_id AS session, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 't' || (event_id % 5) END AS name FROM events), s AS (SELECT unnest(['view', 'view', 'click']) AS name, unnest(['t7', 't1', 't8']) AS tool), t AS (SELECT unnest(['t1', 't2', 't7']) AS tool)
SELECT DISTINCT session, tool FROM (SELECT session, tool FROM r JOIN s USING (name) UNION ALL SELECT session, name FROM r WHERE name NOT IN (SELECT name FROM s)) JOIN t USING (tool)""")
def activated_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")))
    resolved = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), name.alias("name"))
    skills = spark.createDataFrame([("view", "t7"), ("view", "t1"), ("click", "t8")], "name string, tool string")
    return ingest.activated(resolved, skills, spark.createDataFrame([("t1",), ("t2",), ("t7",)], "tool string"))


@query("SELECT user_id AS session, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR > TIMESTAMP '2024-01-15 12:00:00' ORDER BY last DESC, session LIMIT 20")
def cached_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts")
    return ingest.cache_entries(accesses, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), most=20)


_SHARE = "CASE WHEN {0} / 4000 >= 0.9 THEN 'SUMMARY' WHEN {0} / 4000 >= 0.8 THEN 'SNIP' WHEN {0} / 4000 >= 0.6 THEN 'REWRITE' ELSE 'FULL' END"


@query(f"""WITH c AS (SELECT conv_id, sum(coalesce(floor(length(text) * 1.5), 0))::BIGINT AS tokens, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY 1), a AS (SELECT *, {_SHARE.format('tokens')} AS policy_before, tokens // 3 AS saved FROM c),
b AS (SELECT conv_id, policy_before, policy_before <> 'FULL' AND turns > 0 AND conv_id % 3 > 0 AS sync, tokens - CASE WHEN policy_before <> 'FULL' AND turns > 0 AND conv_id % 3 > 0 THEN saved ELSE 0 END AS tokens FROM a)
SELECT conv_id, policy_before, tokens, {_SHARE.format('tokens')} AS policy, CASE WHEN sync THEN 'sync' WHEN {_SHARE.format('tokens')} IN ('SNIP', 'REWRITE') THEN 'async' ELSE 'none' END AS action FROM b""")
def context_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    sizes = m.groupBy("conv_id").agg(F.sum(F.coalesce(T.estimated_tokens(F.col("text")), F.lit(0))).cast("long").alias("tokens"), F.count_if(F.col("type") == "user").alias("turns"))
    return ingest.gated(sizes.withColumn("saved", F.expr("tokens div 3")), m.where("conv_id % 3 = 0").select("conv_id"), 4000)


@query("SELECT doc_id, 'exam_' || md5(doc_id::VARCHAR)[:6] AS id, ['questions', 'refs'] AS paths, doc_id % 2 = 0 AS declared, CASE WHEN doc_id % 2 = 0 THEN ['q' || doc_id] END AS items FROM labels")
def container_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "labels").select("doc_id", containers.created(F.lit("exam"), F.col("doc_id"), F.array(F.lit("questions"), F.lit("refs"), F.lit("refs"))).alias("c"))
    path = F.when(F.col("doc_id") % 2 == 0, "questions").otherwise("other")
    put = made.withColumn("a", containers.appended_at(F.col("c.arrays"), path, F.array(F.concat(F.lit("q"), F.col("doc_id").cast("string")))))
    return put.select("doc_id", "c.id", F.map_keys("c.arrays").alias("paths"), F.col("a").isNotNull().alias("declared"), F.try_element_at("a", F.lit("questions")).alias("items"))


@query("""SELECT doc_id, '{"goal":"g","questions":["' || quality || '","x"],"title":"' || doc_id || '"}' AS json FROM labels WHERE quality IS NOT NULL""")
def container_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    metadata = F.create_map(F.lit("title"), text(F.col("doc_id").cast("string")), F.lit("goal"), F.lit('"g"'), F.lit("questions"), F.lit('"lost"'))
    arrays = F.create_map(F.lit("questions"), F.array(F.col("quality").cast("string"), F.lit("x")))
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", containers.assembled(metadata, arrays).alias("json"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN [CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 1 END, CASE WHEN doc_id % 3 = 1 THEN 9 ELSE 2 END]::INT[] END AS items, ['goal=new', 'more=1', 'title=t'] AS metadata FROM labels")
def container_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.lit(1), F.lit(2))
    put = F.coalesce(*(F.when(F.col("doc_id") % 3 == at, containers.replaced(items, at, F.lit(9))) for at in range(3)))
    merged = containers.merged(F.create_map(F.lit("title"), F.lit("t"), F.lit("goal"), F.lit("old")), F.create_map(F.lit("goal"), F.lit("new"), F.lit("more"), F.lit("1")))
    return table(spark, sf_dir, "labels").select("doc_id", put.alias("items"), F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("metadata"))


# Line items stand for questions of all kinds, with answers as texts, lists and JSON arrays; a fourth has no answer given.
_QUESTION = {"exam": "l_orderkey", "question": "l_linenumber", "type": "CASE l_linenumber % 6 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'multi_choice' WHEN 2 THEN 'true_false' WHEN 3 THEN 'fill_blank' WHEN 4 THEN 'short_answer' ELSE 'essay' END",
             "answer": "CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '[\"A\",\" b\"]' WHEN 2 THEN 'b, A' ELSE '[]' END"}
_GIVEN = {"exam": "l_orderkey", "question": "l_linenumber", "given": "CASE l_suppkey % 6 WHEN 0 THEN ' a ' WHEN 1 THEN 'B，a' WHEN 2 THEN '[\"b\",\"a\",\"A\"]' WHEN 3 THEN 'a,,A' WHEN 4 THEN '  ' ELSE '[\"a\"' END"}
_SET = "list_sort(list_distinct([lower(trim(x)) FOR x IN CASE WHEN regexp_matches(trim({0}), '^\\[.*\\]$') AND json_valid({0}) THEN from_json(CASE WHEN json_valid({0}) THEN {0} END, '[\"VARCHAR\"]') ELSE list_filter(regexp_split_to_array({0}, '[,，]'), lambda y: trim(y) <> '') END]))"
_GRADED = f"""{_cte('questions', 'lineitem', _QUESTION)}, {_cte('answers', '(SELECT * FROM lineitem WHERE l_suppkey % 4 <> 2)', _GIVEN)},
graded AS (SELECT q.*, coalesce(given, '') AS given, trim(coalesce(given, '')) <> '' AND CASE WHEN type = 'multi_choice' THEN {_SET.format('given')} = {_SET.format('answer')} WHEN type IN ('single_choice', 'true_false', 'fill_blank') THEN lower(trim(given)) = lower(trim(answer)) ELSE false END AS correct FROM questions q LEFT JOIN answers USING (exam, question))"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 <> 2").select(*(F.expr(e).alias(c) for c, e in _GIVEN.items()))
    return learning.graded(_view(spark, sf_dir, "lineitem", _QUESTION), answers, ["exam", "question"])


@query(f"WITH {_GRADED} SELECT exam, question, type, given, answer, correct FROM graded")
def exam_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("exam", "question", "type", "given", "answer", "correct")


@query(f"WITH {_GRADED} SELECT exam, count(*) FILTER (correct) AS score, count(*) AS total FROM graded GROUP BY exam")
def exam_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).groupBy("exam").agg(F.count_if("correct").alias("score"), F.count("*").alias("total"))


@query(f"WITH {_cte('q', 'lineitem', _QUESTION)} SELECT DISTINCT answer, {_SET.format('answer')} AS items FROM q")
def answer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", _QUESTION).select("answer", learning.answer_set(F.col("answer")).alias("items")).distinct()


@query("""SELECT o_custkey, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'in_progress') AS in_progress, count(*) FILTER (s = 'not_started') AS not_started, floor(100.0 * count(*) FILTER (s = 'completed') / count(*) + 0.5)::INT AS percent,
  CASE WHEN bool_and(s = 'completed') THEN 'completed' WHEN bool_and(s = 'not_started') THEN 'not_started' ELSE 'in_progress' END AS plan_status
FROM (SELECT o_custkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'in_progress' END END, 'not_started') AS s FROM orders) GROUP BY 1""")
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases joined to progress rows, which a third of them lacks."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("phase_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress").alias("status"))
    phases = learning.phase_status(orders.drop("status"), orders.where("phase_id % 3 > 0"), "phase_id")
    return learning.progress(phases, "o_custkey", "status")


_EXAM = {"exam": "l_orderkey", "index": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_linenumber - 1 END", "title": "CASE WHEN l_orderkey % 4 = 0 THEN ' ' ELSE 't' END", "type": _QUESTION["type"], "stem": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 's' END", "answer": _QUESTION["answer"]}
_FAULTS = f"""{_cte('e', 'lineitem', _EXAM | {'has': 'l_partkey % 2 = 0'})}, k AS (SELECT *, regexp_matches(trim(answer), '^\\[.*\\]$') AS listed, type IN ('single_choice', 'multi_choice') AS choice FROM e),
f AS (SELECT exam, unnest(list_filter([
  CASE WHEN index IS NOT NULL AND type = 'essay' THEN {{index: index, field: 'type', message: 'unknown type'}} END, CASE WHEN index IS NOT NULL AND stem = '' THEN {{index: index, field: 'stem', message: 'missing'}} END,
  CASE WHEN index IS NOT NULL AND answer = '[]' THEN {{index: index, field: 'answer', message: 'missing'}} END, CASE WHEN index IS NOT NULL AND type = 'multi_choice' AND NOT listed THEN {{index: index, field: 'answer', message: 'not a list'}} END,
  CASE WHEN index IS NOT NULL AND type NOT IN ('multi_choice', 'fill_blank') AND listed THEN {{index: index, field: 'answer', message: 'a list'}} END, CASE WHEN index IS NOT NULL AND choice AND NOT has THEN {{index: index, field: 'options', message: 'missing'}} END,
  CASE WHEN index IS NOT NULL AND choice AND has AND answer NOT IN ('A', '[]') THEN {{index: index, field: 'answer', message: 'not an option'}} END, CASE WHEN index IS NOT NULL AND type = 'true_false' THEN {{index: index, field: 'answer', message: 'not a truth value'}} END,
  CASE WHEN coalesce(index, 0) = 0 AND trim(title) = '' THEN {{index: -1, field: 'title', message: 'missing'}} END, CASE WHEN index IS NULL THEN {{index: -1, field: 'questions', message: 'missing'}} END], lambda x: x IS NOT NULL), recursive := true) FROM k)"""


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(c) for c, e in _EXAM.items()), F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("A"), F.lit("b"))).alias("options"))
    return learning.validate_exam(rows)


@query(f"WITH {_FAULTS} SELECT exam, index, field, message FROM f")
def exam_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faults(spark, sf_dir)


@query(f"WITH {_FAULTS} SELECT exam, index, field, message FROM f QUALIFY row_number() OVER (PARTITION BY exam ORDER BY index, field, message) = 1")
def exam_first_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.first_fault(_faults(spark, sf_dir), "exam")


@query("""WITH p AS (SELECT c_custkey AS plan, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'g' END AS goal, c_custkey % 5 AS n FROM customer)
SELECT plan, -1 AS index, 'title' AS field, 'missing' AS message FROM p WHERE trim(title) = '' UNION ALL SELECT plan, -1, 'goal', 'missing' FROM p WHERE goal IS NULL UNION ALL SELECT plan, -1, 'phases', 'missing' FROM p WHERE n = 0 UNION ALL SELECT plan, i::INT, 'title', 'missing' FROM p, range(5) r(i) WHERE i < n AND i % 2 = 1""")
def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("t").alias("title"), F.when(F.col("c_custkey") % 3 > 0, "g").alias("goal"), F.lit("s").alias("source_type"), F.expr("slice(array(named_struct('title', 'a'), named_struct('title', ''), named_struct('title', 'c'), named_struct('title', cast(null as string))), 1, cast(c_custkey % 5 as int))").alias("phases"))
    return learning.validate_plan(plans)


# Orders stand for phases, with notes, durations and lists by their keys.
_PHASE = {"plan": "o_custkey", "phase_order": "o_orderkey", "title": "concat(o_orderpriority, '<&>')", "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'not_started' END", "duration": "CASE WHEN o_orderkey % 2 = 0 THEN '2d' ELSE ' ' END", "objective": "CASE WHEN o_orderkey % 3 = 0 THEN 'aim' ELSE NULL END", "notes": "CASE WHEN o_orderkey % 5 = 0 THEN 'note' ELSE '' END",
          "plan_title": "concat('plan ', CAST(o_custkey AS VARCHAR(9)))", "goal": "'g'", "description": "CASE WHEN o_custkey % 2 = 0 THEN 'about' ELSE NULL END", "plan_duration": "CASE WHEN o_custkey % 3 = 0 THEN '4w' ELSE '' END"}
_PERCENT = "count(*) FILTER (status = 'completed') || '/' || count(*) || ' 阶段已完成（' || floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5)::INT || '%）'"


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"key_topics": "array('a', 'b<')", "resources": "case when o_orderkey % 4 = 0 then array('r') else array() end", "practice_tasks": "cast(array() as array<string>)", "milestones": "cast(null as array<string>)"}
    return _view(spark, sf_dir, "orders", _PHASE | {k: f"cast({v} as array<string>)" for k, v in lists.items()})


@query(f"""WITH {_cte('p', 'orders', _PHASE)} SELECT plan, md5('# ' || first(plan_title) || {_LF} || {_LF} || '> **学习目标**：g' || {_LF} || {_LF} || CASE WHEN plan % 2 = 0 THEN '**描述**：about' || {_LF} || {_LF} ELSE '' END || CASE WHEN plan % 3 = 0 THEN '**总时长**：4w' || {_LF} || {_LF} ELSE '' END
  || '**进度**：' || {_PERCENT} || {_LF} || {_LF} || '---' || {_LF} || {_LF}
  || string_agg('## ' || CASE status WHEN 'completed' THEN '[x]' WHEN 'in_progress' THEN '[~]' ELSE '[ ]' END || ' 阶段 ' || phase_order || '：' || title || {_LF} || {_LF} || CASE WHEN phase_order % 2 = 0 THEN '- **时长**：2d' || {_LF} ELSE '' END || CASE WHEN phase_order % 3 = 0 THEN '- **目标**：aim' || {_LF} ELSE '' END
  || '- **关键知识点**：' || {_LF} || '  - a' || {_LF} || '  - b<' || {_LF} || CASE WHEN phase_order % 4 = 0 THEN '- **学习资源**：' || {_LF} || '  - r' || {_LF} ELSE '' END || CASE WHEN phase_order % 5 = 0 THEN {_LF} || '**学习笔记**：' || {_LF} || {_LF} || '> note' || {_LF} ELSE '' END || {_LF}, '' ORDER BY phase_order)) AS digest FROM p GROUP BY plan""")
def plan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.plan_markdown(_phases(spark, sf_dir), "plan").select("plan", F.md5("markdown").alias("digest"))


_ROW = lambda name, c: f"'<p><strong>{name}</strong>：{c}</p>' || {_LF}"


@query(f"""WITH {_cte('p', 'orders', _PHASE)} SELECT plan, md5('<!DOCTYPE html>' || {_LF} || '<html>' || {_LF} || '<body>' || {_LF} || '<h1>' || first(plan_title) || '</h1>' || {_LF} || {_ROW('学习目标', 'g')} || CASE WHEN plan % 2 = 0 THEN {_ROW('描述', 'about')} ELSE '' END || CASE WHEN plan % 3 = 0 THEN {_ROW('总时长', '4w')} ELSE '' END
  || '<p><strong>进度</strong>：' || {_PERCENT} || '</p>' || {_LF}
  || string_agg('<div class="phase">' || {_LF} || '<h2>阶段 ' || phase_order || '：' || replace(title, '<&>', '&lt;&amp;&gt;') || '<span class="status-' || status || '">' || CASE status WHEN 'completed' THEN '已完成' WHEN 'in_progress' THEN '进行中' ELSE '未开始' END || '</span></h2>' || {_LF}
  || CASE WHEN phase_order % 2 = 0 THEN {_ROW('时长', '2d')} ELSE '' END || CASE WHEN phase_order % 3 = 0 THEN {_ROW('目标', 'aim')} ELSE '' END || '<p><strong>关键知识点</strong></p>' || {_LF} || '<ul><li>a</li><li>b&lt;</li></ul>' || {_LF} || CASE WHEN phase_order % 4 = 0 THEN '<p><strong>学习资源</strong></p>' || {_LF} || '<ul><li>r</li></ul>' || {_LF} ELSE '' END
  || CASE WHEN phase_order % 5 = 0 THEN {_ROW('学习笔记', 'note')} ELSE '' END || '</div>' || {_LF}, '' ORDER BY phase_order) || '</body>' || {_LF} || '</html>' || {_LF}) AS digest FROM p GROUP BY plan""")
def plan_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.plan_html(_phases(spark, sf_dir), "plan").select("plan", F.md5("html").alias("digest"))


# Vowels turned into Chinese characters give texts of both kinds of words.
@query(r"""WITH r AS (SELECT item_id, unnest(regexp_extract_all(lower(translate(text, 'aeiou', '一二三四五')), '[\x{4e00}-\x{9fff}]+|[a-zß-ÿ0-9]+')) AS r, generate_subscripts(regexp_extract_all(lower(translate(text, 'aeiou', '一二三四五')), '[\x{4e00}-\x{9fff}]+|[a-zß-ÿ0-9]+'), 1) AS i FROM benchmark),
w AS (SELECT item_id, i, unnest(CASE WHEN regexp_matches(r, '^[\x{4e00}-\x{9fff}]{2,}$') THEN [substr(r, j, 2) FOR j IN range(1, length(r))] ELSE [r] END) AS t, generate_subscripts(CASE WHEN regexp_matches(r, '^[\x{4e00}-\x{9fff}]{2,}$') THEN [substr(r, j, 2) FOR j IN range(1, length(r))] ELSE [r] END, 1) AS j FROM r)
SELECT item_id, string_agg(t, ' ' ORDER BY i, j) AS segments FROM w GROUP BY item_id""")
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.segments(F.translate("text", "aeiou", "一二三四五")), " ").alias("segments"))


_CURRENT = "concat('---\n title : a:b \nplain\ntitle: ', url, '\n---\n# x\n\n## Topic\n\n<!-- c -->\n ', url, ' \nmore\n## Plan\n', html)"


@query(f"""WITH c AS (SELECT page_id, url, {_CURRENT.replace(chr(10), "' || chr(10) || '")} AS t FROM pages) SELECT page_id, trim(url) AS topic, trim(url) AS title, 1::BIGINT AS fields,
  md5(CASE WHEN length(s) > 600 THEN s[:600] || '…(已截断)' ELSE s END) AS summary FROM (SELECT *, 'Topic' || chr(10) || chr(10) || '<!-- c -->' || chr(10) || ' ' || url || ' ' || chr(10) || 'more' AS s FROM c)""")
def current_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, topic and head summary of notes made from pages."""
    text = F.expr(_CURRENT.replace("\n", "\\n"))
    head = T.front_matter(text)
    return table(spark, sf_dir, "pages").select("page_id", T.topic_of(text).alias("topic"), F.try_element_at(head, F.lit("title")).alias("title"), F.size(head).cast("long").alias("fields"), F.md5(T.head_summary(text)).alias("summary"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok ' || props WHEN 1 THEN props WHEN 2 THEN props ELSE '{"a":"}{"' END AS json FROM events""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' answers around an object: prose before it, a fence, prose after it, and an object that never ends."""
    props = F.col("props")
    made = [F.concat(F.lit(" ok "), props, F.lit(" } {")), F.concat(F.lit("```json\n"), props, F.lit("\n```")), F.concat(props, F.lit(" and so on")), F.lit('{"a":"}{" ')]
    return table(spark, sf_dir, "events").select("event_id", T.json_object(F.coalesce(*(F.when(F.col("event_id") % 4 == i, m) for i, m in enumerate(made)))).alias("json"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'RATE_LIMIT' WHEN 'click' THEN 'DNS' WHEN 'signup' THEN 'NETWORK' ELSE 'OTHER' END AS label FROM events")
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.expr("case event_type when 'view' then 'RateLimitException' when 'click' then 'UnresolvedAddressException' when 'signup' then 'IOException' else 'Odd' end")
    return table(spark, sf_dir, "events").select("event_id", T.error_label(F.array(F.lit("RuntimeException"), inner, F.lit("None"))).alias("label"))


@query("SELECT event_id, floor(value * 10000 + 0.5) / 10000 AS rounded, CASE WHEN length(props) > 8 THEN props[:8] || '...' ELSE props END AS cut, event_type || CASE WHEN event_id % 2 = 0 THEN ' > t' ELSE '' END AS label, event_id % 3 <> 1 AS searchable FROM events")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding to four places, cut texts, source labels and the searchable flag: level 2 or none."""
    level = F.expr("case event_id % 3 when 0 then 2 when 1 then 1 end")
    title = F.when(F.col("event_id") % 2 == 0, "t").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", T.rounded4(F.col("value")).alias("rounded"), T.truncated(F.col("props"), 8).alias("cut"), T.source_label(F.col("event_type"), title).alias("label"), F.coalesce(level == 2, F.lit(True)).alias("searchable"))


_CODE = "CASE page_id % 8 WHEN 0 THEN 'public class A' WHEN 1 THEN 'import os' WHEN 2 THEN 'class B; const x = 1' WHEN 3 THEN 'select a from b; class' WHEN 4 THEN 'class; delete from b' WHEN 5 THEN 'func main()' WHEN 6 THEN 'fn main() class' ELSE 'text' END"


@query(f"""WITH c AS (SELECT page_id, {_CODE} AS t FROM pages) SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'sql' WHEN 5 THEN 'go' WHEN 6 THEN 'rust' END AS marked,
  CASE WHEN page_id % 3 = 0 THEN 'kotlin' ELSE CASE page_id % 8 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'sql' WHEN 4 THEN 'sql' WHEN 5 THEN 'go' WHEN 6 THEN 'rust' END END AS file FROM c""")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 3 == 0, "a/b.KT").otherwise("a.b/c")
    return table(spark, sf_dir, "pages").select("page_id", T.language_of(F.expr(_CODE)).alias("marked"), T.file_language(path, F.expr(_CODE)).alias("file"))


@query("SELECT page_id, page_id % 4 = 0 AND page_id * 1000 + 500 >= 60000 AS valid, md5(html) AS hash FROM pages")
def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed paths, three of four with something wrong, and the hash of a file's bytes."""
    key, expires = F.concat(F.col("page_id").cast("string"), F.lit(".png")), F.col("page_id") * 1000
    sig = F.regexp_extract(T.signed_image(key, "kkk", expires), "&sig=(.*)$", 1)
    at = F.expr("case page_id % 4 when 1 then 'soon' when 2 then cast(page_id * 1000 + 1 as string) else cast(page_id * 1000 as string) end")
    given = F.when(F.col("page_id") % 4 == 3, F.reverse(sig)).otherwise(sig)
    return table(spark, sf_dir, "pages").select("page_id", T.verified_image(key, at, given, "kkk", F.lit(60000), 500).alias("valid"), F.md5(F.col("html").cast("binary")).alias("hash"))


@query(r"SELECT doc_id, doc_id % 5 >= 3 AS gaps FROM documents WHERE text IS NOT NULL")
def gap_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("x\n\n\n"), (F.col("doc_id") % 5).cast("int")), F.lit("y\n\n\n"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.frequent_gaps(text).alias("gaps"))


_STEPS = {"session": "user_id", "call_id": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 3 AS VARCHAR(9)) END", "tool": "event_type", "step_type": "CASE event_type WHEN 'view' THEN 'note' ELSE 'tool_result' END", "step_order": "event_id", "content": "props"}
# Calls 1 have two rules each, of which the first counts; the tool's name stands for calls without an id.
_RULES = {"session": "user_id", "call_id": "CASE WHEN event_id % 5 = 0 THEN 'click' ELSE '1' END", "place": "event_id", "reason": "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('why ', CAST(event_id AS VARCHAR(9))) END"}


@query(f"""WITH {_cte('s', 'events', _STEPS)}, {_cte('every', 'events', _RULES)}, f AS (SELECT session, call_id AS c, arg_min(coalesce(reason, ''), place) AS reason FROM every WHERE session % 2 = 0 AND place % 2 = 0 GROUP BY ALL)
SELECT s.session, step_order, CASE WHEN step_type = 'tool_result' AND reason IS NOT NULL THEN '[此工具结果已被 Projection 精简：toolCallId=' || c || CASE WHEN trim(reason) <> '' THEN ', reason=' || reason ELSE '' END || ']' ELSE content END AS content FROM s LEFT JOIN f ON f.session = s.session AND c = coalesce(call_id, tool)""")
def rewritten_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _view(spark, sf_dir, "events", _RULES).where("session % 2 = 0 and place % 2 = 0")
    return steps.rewritten(_view(spark, sf_dir, "events", _STEPS), rules).select("session", "step_order", "content")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def kept_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.kept_steps(table(spark, sf_dir, "events").select("event_id", "event_type"), unkept=("view", "click"))


_ARCHIVES = """CASE doc_id % 7 WHEN 0 THEN '.raw/' WHEN 1 THEN '.trash/' WHEN 2 THEN 'sub/' ELSE '' END || CASE WHEN doc_id % 50 = 3 THEN '_merged' ELSE lpad(doc_id::VARCHAR, 9, '0') END || CASE WHEN doc_id % 11 = 5 THEN '.txt' ELSE '.md' END"""


_SHELVES = """CASE doc_id % 7 WHEN 2 THEN 'sub/' ELSE '' END || lpad(doc_id::VARCHAR, 9, '0') || '.md'"""


@query(f"""WITH named AS (SELECT (doc_id % 10)::VARCHAR AS "user", {_SHELVES} AS name, doc_id, text FROM documents UNION ALL SELECT (doc_id % 10)::VARCHAR, {_ARCHIVES}, doc_id, text FROM documents WHERE doc_id % 7 < 2 OR doc_id % 50 = 3 OR doc_id % 11 = 5),
f AS (SELECT "user", 'History/2024-0' || (doc_id % 3 + 1) || '/' || name AS path, text FROM named),
parts AS (SELECT "user", path, '=== ' || path || ' ===' || chr(10) || text || chr(10) || chr(10) AS part FROM f
  WHERE prefix(path, 'History/2024-02/') AND suffix(path, '.md') AND NOT suffix(path, '/_merged.md') AND NOT contains(path, '/.raw/') AND NOT contains(path, '/.trash/') AND regexp_matches(text, '\\S'))
SELECT "user", 'History/2024-02' AS folder, path, md5(part) AS digest, row_number() OVER o - 1 AS pos, (sum(strlen(part)) OVER (o ROWS UNBOUNDED PRECEDING) - strlen(part))::BIGINT AS start FROM parts WINDOW o AS (PARTITION BY "user" ORDER BY path, md5(part))""")
def monthly_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every user's merge of a month, in their places; other copies of some files are elsewhere, merged before, hidden or of another type."""
    doc = F.col("doc_id")
    number = F.lpad(doc.cast("string"), 9, "0")
    shelf = F.concat(F.when(doc % 7 == 2, "sub/").otherwise(""), number, F.lit(".md"))
    folder = F.when(doc % 7 == 0, ".raw/").when(doc % 7 == 1, ".trash/").when(doc % 7 == 2, "sub/").otherwise("")
    name = F.when(doc % 50 == 3, "_merged").otherwise(number)
    other = F.when((doc % 7 < 2) | (doc % 50 == 3) | (doc % 11 == 5), F.concat(folder, name, F.when(doc % 11 == 5, ".txt").otherwise(".md")))
    path = F.concat(F.lit("History/2024-0"), (doc % 3 + 1).cast("string"), F.lit("/"), F.col("name"))
    named = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array_compact(F.array(shelf, other))).alias("name"))
    files = named.select((doc % 10).cast("string").alias("user"), path.alias("path"), F.col("text").alias("content"))
    return workspace.placed(workspace.monthly_archives(files, "2024-02"))


# Events close together as requests, so that they meet running, finished, failed and expired ones.
_REQUESTS = """o AS (SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE user_id::VARCHAR END AS request_id, event_id, (epoch_ms(ts) // 50000) * 1000 AS w, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'request' END AS kind, 'r' || event_id AS reply FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY w, event_id) AS i FROM o WHERE request_id <> '')"""


@query(f"""WITH RECURSIVE {_REQUESTS},
run AS (SELECT request_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS w, NULL::VARCHAR AS action, NULL::VARCHAR AS said, 'none' AS state, 0::BIGINT AS since, NULL::VARCHAR AS kept FROM (SELECT DISTINCT request_id FROM n)
  UNION ALL SELECT request_id, i, event_id, w,
    CASE WHEN kind <> 'request' THEN NULL WHEN now = 'none' THEN 'run' WHEN now = 'running' THEN 'processing' ELSE 'replay' END, CASE WHEN kind = 'request' AND now = 'finished' THEN kept END,
    CASE WHEN kind = 'finished' THEN 'finished' WHEN kind = 'failed' AND now <> 'finished' THEN 'none' WHEN kind = 'request' AND now = 'none' THEN 'running' ELSE now END,
    CASE WHEN kind = 'finished' OR (kind = 'request' AND now = 'none') THEN w ELSE since END, CASE WHEN kind = 'finished' THEN reply ELSE kept END
  FROM (SELECT n.*, since, kept, CASE WHEN state <> 'none' AND n.w >= since + 2100000 THEN 'none' ELSE state END AS now FROM run JOIN n ON n.request_id = run.request_id AND n.i = run.i + 1))
SELECT request_id, event_id, w AS "at", action, said AS reply FROM run WHERE action IS NOT NULL UNION ALL SELECT request_id, event_id, w, 'run', NULL FROM o WHERE request_id = '' AND kind = 'request'""")
def request_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request is answered: run, processing, or the finished reply again."""
    kind = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise("request")
    key = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string"))
    micros = "unix_micros(cast(ts AS timestamp))"
    ts = F.timestamp_seconds(F.expr(f"({micros} + if({micros} < 0, -500, 500)) div 1000 div 50000"))  # to the nearest millisecond first
    return machines.replies(table(spark, sf_dir, "events").select(key.alias("request_id"), "event_id", ts.alias("ts"), kind.alias("kind"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reply")))


@query("""WITH o AS (SELECT user_id, event_id, (epoch_ms(ts) // 86400000) AS batch, CASE event_type WHEN 'purchase' THEN 'REMOVE' ELSE 'REPLACE' END AS op, CASE WHEN value > 50 THEN 'skip' ELSE 'rewrite' END AS kind, 'k' || (event_id % 4) AS rule_id, 't' || event_id AS target, event_type IN ('view', 'click', 'purchase') AS acts FROM events),
v AS (SELECT user_id, count(DISTINCT batch) AS version FROM o GROUP BY user_id),
k AS (SELECT o.*, k.kind AS of_kind FROM o, (VALUES ('skip'), ('rewrite')) k(kind) WHERE acts AND (op = 'REMOVE' OR o.kind = k.kind)),
last AS (SELECT user_id, of_kind, rule_id, arg_max(op, event_id) AS op, arg_max(target, event_id) AS target, max(event_id) AS e FROM k GROUP BY ALL)
SELECT user_id::VARCHAR AS session, version, coalesce((SELECT string_agg(of_kind || ':' || rule_id || ':' || target, ',' ORDER BY of_kind, e) FROM last l WHERE l.user_id = v.user_id AND op <> 'REMOVE'), '') AS rules FROM v""")
def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's rules after its batches, one a day, of replacements and removals; a day without any is an empty batch. Days stand for hours, so nothing expires."""
    acts = F.col("event_type").isin("view", "click", "purchase")
    op = F.struct(F.when(F.col("event_type") == "purchase", "REMOVE").otherwise("REPLACE").alias("op"), F.when(F.col("value") > 50, "skip").otherwise("rewrite").alias("kind"), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("rule_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("target"), F.lit(None).cast("string").alias("reason"))
    day = F.expr("unix_seconds(cast(ts AS timestamp)) div 86400")
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("session"), day.alias("batch")).agg(F.array_sort(F.collect_list(F.when(acts, F.struct("event_id", op.alias("op")))))["op"].alias("ops"))
    found = machines.rules_in_force(machines.rule_sets(days.withColumn("ts", F.timestamp_seconds(F.col("batch") * 3600))))
    return found.select("session", "version", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["kind"], r["rule_id"], r["target"])), ",").alias("rules"))



_UP = "m AS (SELECT conv_id, conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn >= 4 AND turn % 4 = 0 THEN conv_id * 1000 + 1 ELSE conv_id * 1000 + turn - 1 END AS parent_id, turn FROM conversations), up AS (SELECT id AS leaf, id, parent_id, 0 AS depth FROM m UNION ALL SELECT u.leaf, m.id, m.parent_id, u.depth + 1 FROM up u JOIN m ON m.id = u.parent_id)"


@query(f"WITH RECURSIVE {_UP}, last AS (SELECT conv_id, max(id) AS leaf FROM m GROUP BY conv_id) SELECT conv_id, up.id, up.depth FROM last JOIN up USING (leaf)")
def active_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from the root to the last message of each conversation."""
    m = messages(spark, sf_dir)
    last = m.groupBy("conv_id").agg(F.max("id").alias("id"))
    return trees.active_path(last, m).select("conv_id", "id", "depth")


@query(f"WITH RECURSIVE {_UP} SELECT m.id, count(up.id) > 0 AS below FROM m LEFT JOIN up ON up.leaf = m.id AND up.depth > 0 AND up.id = m.conv_id * 1000 + 2 GROUP BY m.id")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each message stands below the third one of its conversation."""
    m = messages(spark, sf_dir)
    pairs = m.select("id", (F.col("conv_id") * 1000 + 2).alias("ancestor"))
    return trees.is_descendant(pairs, m).select("id", "below")


@query("""WITH s AS (SELECT DISTINCT array_to_string(p[:d], '/') AS path, array_to_string(p[:d - 1], '/') AS parent, p[d] AS name, d < len(p) AS folder FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS d)),
t AS (SELECT path, parent, name, bool_or(folder) AS folder FROM s GROUP BY ALL) SELECT path, folder, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, name)::INT AS rank FROM t""")
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's entries, folders first, then by name."""
    return trees.directory(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))).select("path", "folder", "rank")


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'refused' WHEN page_id % 4 = 1 THEN 'stale' ELSE 'written' END AS result, md5(CASE WHEN page_id % 4 > 1 THEN 'new' ELSE html END) AS digest FROM pages")
def workspace_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to workspace files: refused outside the folder, stale where time or size differ from what was read."""
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a/../../"), "url")).otherwise(F.concat(F.lit("a/"), F.col("page_id").cast("string")))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), F.col("page_id").alias("mtime"), F.octet_length("html").alias("size"), F.col("html").alias("content"))
    writes = files.select("path", (F.col("mtime") + F.when(F.col("id") % 4 == 1, 1).otherwise(0)).alias("seen_mtime"), F.col("size").alias("seen_size"), F.lit("new").alias("new"))
    return tables.guarded_writes(files, writes).select("id", "result", F.md5("content").alias("digest"))
