"""Queries over layout rows; events and line items stand for nodes and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_SPANS = "spans AS (SELECT l_suppkey AS doc, l_orderkey AS block, l_linenumber AS pos, l_quantity AS size, l_returnflag = 'R' AS bold, l_linestatus = 'F' AS mono, l_partkey::VARCHAR AS text FROM lineitem)"
_BODY = "ranked AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM spans), body AS (SELECT doc, size AS body FROM ranked WHERE i = n // 2)"
_BLOCKS = """sized AS (SELECT doc, block, size, sum(length(text)) AS c, min(pos) AS p, sum(CASE WHEN bold THEN length(text) ELSE 0 END) AS b, sum(CASE WHEN mono THEN length(text) ELSE 0 END) AS m FROM spans GROUP BY ALL),
blocks AS (SELECT doc, block, first(size ORDER BY c DESC, p, size) AS size, sum(b) * 2 >= sum(c) AS bold, sum(m) * 2 >= sum(c) AS mono FROM sized GROUP BY ALL)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, v: (F.col(c) == v)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("size"), flag("l_returnflag", "R").alias("bold"), flag("l_linestatus", "F").alias("mono"), F.col("l_partkey").cast("string").alias("text"))


@query(f"WITH {_SPANS}, {_BLOCKS} SELECT * FROM blocks")
def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_features(_spans(spark, sf_dir))


@query(f"WITH {_SPANS}, {_BODY}, {_BLOCKS} SELECT doc, block, CASE WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.5 THEN 2 WHEN size / body >= 1.3 OR (bold AND size / body >= 1.15) THEN 3 END AS level FROM blocks JOIN body USING (doc)")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    blocks = layout.block_features(spans).join(layout.body_sizes(spans), "doc")
    return blocks.select("doc", "block", layout.heading_level(F.col("size"), F.col("bold"), F.col("body")).alias("level"))


_NODES = """n AS (SELECT user_id AS doc, event_id AS pos, event_id // 50 AS page, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 END AS level, CASE event_type WHEN 'error' THEN 'image' ELSE 'text' END AS type, event_type,
  (event_id % 2)::INT AS size, event_type = 'click' AS bold, 't' || event_id AS text FROM events)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 end")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.expr("event_id div 50").alias("page"), level.alias("level"), F.when(F.col("event_type") == "error", "image").otherwise("text").alias("type"), "event_type", (F.col("event_id") % 2).cast("int").alias("size"), (F.col("event_type") == "click").alias("bold"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"))


@query(f"""WITH {_NODES}, p AS (SELECT *, max(CASE level WHEN 1 THEN pos END) OVER w AS p1, max(CASE level WHEN 2 THEN pos END) OVER w AS p2, max(CASE level WHEN 3 THEN pos END) OVER w AS p3 FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, concat_ws(' > ', 't' || p1, CASE WHEN p2 > coalesce(p1, -1) THEN 't' || p2 END, CASE WHEN p3 > coalesce(p1, -1) AND p3 > coalesce(p2, -1) THEN 't' || p3 END) AS title_path FROM p""")
def title_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.title_paths(_nodes(spark, sf_dir)).select("doc", "pos", "title_path")


@query(f"""WITH {_NODES}, w AS (SELECT *, row_number() OVER o AS i, lag(page) OVER o IS DISTINCT FROM page AS head, max(CASE type WHEN 'text' THEN pos END) OVER (PARTITION BY doc ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM n WINDOW o AS (PARTITION BY doc ORDER BY page, pos)),
j AS (SELECT w.*, coalesce(w.head AND w.type = 'text' AND l.size = w.size AND l.bold = w.bold, false) AS joins FROM w LEFT JOIN n l ON l.doc = w.doc AND l.pos = w.lp),
a AS (SELECT *, CASE WHEN joins THEN max(CASE WHEN type = 'text' AND NOT joins THEN i END) OVER (PARTITION BY doc ORDER BY i) ELSE i END AS anchor FROM j)
SELECT doc, min(page) AS page, min(pos) AS pos, arg_min(type, i) AS type, string_agg(text, chr(10) ORDER BY i) AS text FROM a GROUP BY doc, anchor""")
def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stitched(_nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, k AS (SELECT doc, pos, CASE event_type WHEN 'signup' THEN 'heading' ELSE 'body' END AS kind, CASE event_type WHEN 'error' THEN ' ' ELSE text END AS text, pos % 10 = 0 AS wide, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM n),
b AS (SELECT *, lag(kind) OVER o AS pk, lag(wide) OVER o AS pw, i - lag(i) OVER o - 1 AS gap FROM k WHERE NOT (kind = 'body' AND trim(text) = '') WINDOW o AS (PARTITION BY doc ORDER BY pos)),
r AS (SELECT *, coalesce(kind = 'body' AND pk = 'body' AND NOT pw AND gap < 2, false) AS joined FROM b), s AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY doc ORDER BY pos) AS run FROM r)
SELECT doc, min(pos) AS pos, arg_min(kind, pos) AS kind, string_agg(CASE WHEN joined AND gap = 1 THEN chr(10) ELSE '' END || text, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc, run""")
def paragraph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "heading").otherwise("body")
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.col("text"))
    return layout.clusters(_nodes(spark, sf_dir).select("doc", "pos", kind.alias("kind"), text.alias("text"), (F.col("pos") % 10 == 0).alias("wide")))


@query(f"""WITH {_NODES}, s AS (SELECT doc, pos, CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' || text WHEN type = 'image' THEN '[图片: ' || text || ']' ELSE text END AS t FROM n)
SELECT doc, pos, coalesce(nullif(concat_ws(chr(10), lag(t, 2) OVER o, lag(t) OVER o), ''), '无') AS before, coalesce(nullif(concat_ws(chr(10), lead(t) OVER o, lead(t, 2) OVER o), ''), '无') AS after FROM s WINDOW o AS (PARTITION BY doc ORDER BY pos)""")
def neighbor_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumns({"type": F.when(F.col("level").isNotNull(), "heading").otherwise(F.col("type")), "language": F.lit(None).cast("string")})
    return layout.neighbours(nodes)
