"""Retrieval as a whole: three-table joins, reranking by given scores, parent lookup, and its edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import postings, retrieval
from quillspark.plans import catalog
from quillspark.plans.registry import query
from quillspark.sources.scratch import scratch_path
from quillspark.sources.tables import table

# Documents stand for chunks, pages for the files they come from; one parent in seven is missing.
_CHUNKS = """chunk AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 28 = 1 THEN doc_id + 1000000000 ELSE doc_id - doc_id % 4 END AS parent, lang AS type, source AS title, text FROM documents)"""
_SCORES = "score_of AS (SELECT vec_id AS id, label / 10.0 AS rerank FROM embeddings WHERE vec_id % 5 <> 0)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 28 == 1, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id") - F.col("doc_id") % 4)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), parent.alias("parent"), F.col("lang").alias("type"), F.col("source").alias("title"), "text")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("rerank"))


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] v FROM embeddings WHERE vec_id = 0), {_CHUNKS}
SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score, c.parent, c.type, c.title, md5(c.text) AS digest, p.url AS file
FROM embeddings e LEFT JOIN chunk c ON c.id = e.vec_id LEFT JOIN pages p ON p.page_id = e.vec_id % 300 WHERE label = 3 ORDER BY score DESC, e.vec_id LIMIT 20""")  # fmt: skip
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's nearest vectors with their chunk and file, either of which may be missing."""
    top = retrieval.dense_recall(table(spark, sf_dir, "embeddings").where("label = 3"), catalog._query_vector(spark, sf_dir))
    named = top.withColumn("page_id", F.col("id") % 300)
    found = retrieval.looked_up(retrieval.looked_up(named, _chunks(spark, sf_dir), "id"), table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file")), "page_id")
    return found.select("id", "score", "parent", "type", "title", F.md5("text").alias("digest"), "file")


@query(rf"""WITH {catalog._WORDS}, dtok AS (SELECT doc_id AS id, unnest({catalog._TOKENS}) t, generate_subscripts({catalog._TOKENS}, 1) i FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0), {catalog._RANKED},
best AS (SELECT id, score FROM hits WHERE every OR NOT (SELECT bool_or(every) FROM hits) ORDER BY score DESC, id LIMIT 20) SELECT id, score, source AS title, url AS file FROM best JOIN documents ON doc_id = id LEFT JOIN pages ON page_id = id % 300""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's searchable chunks by keywords, with their file."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en' and doc_id % 4 <> 0")
    top = retrieval.keyword_recall(docs, catalog._query_words(spark, sf_dir)).withColumn("page_id", F.col("id") % 300)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    found = retrieval.looked_up(retrieval.looked_up(top, rows, "id"), table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file")), "page_id")
    return found.select("id", "score", "title", "file")


_CANDIDATES = f"""{catalog._FUSED}, {_CHUNKS}, {_SCORES}, cand AS (SELECT f.id, coalesce(rerank, 0) AS score, rrf, parent, type, title, text FROM fused f LEFT JOIN chunk USING (id) LEFT JOIN score_of USING (id))"""


def _candidates(spark: SparkSession, sf_dir: str, scored: bool = True) -> DataFrame:
    fused = retrieval.looked_up(catalog.rrf_fuse(spark, sf_dir), _chunks(spark, sf_dir), "id")
    return retrieval.reranked(fused, _scores(spark, sf_dir) if scored else None)


@query(f"WITH {_CANDIDATES} SELECT id, score, rrf FROM cand")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("id", F.col("score").cast("double").alias("score"), "rrf")


@query(f"WITH {catalog._FUSED} SELECT id, coalesce(score, 0) AS score FROM fused")
def rerank_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a scorer every candidate keeps its own score."""
    return _candidates(spark, sf_dir, scored=False).select("id", "score")


@query(f"""WITH {catalog._FUSED}, t AS (SELECT f.id, coalesce(text, '') AS text, row_number() OVER (ORDER BY f.id) - 1 AS i FROM fused f LEFT JOIN documents ON doc_id = f.id)
SELECT (i // 8)::INT AS batch, (i % 8)::INT AS pos, id, md5(CASE WHEN length(text) > 510 THEN text[:510] || '...' ELSE text END) AS digest FROM t""")
def rerank_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank_requests(_candidates(spark, sf_dir)).select("batch", "pos", "id", F.md5("text").alias("digest"))


_EXPANDED = """keyed AS (SELECT c.*, p.id AS pid, p.type AS ptype, p.title AS ptitle, p.text AS ptext FROM cand c LEFT JOIN chunk p ON p.id = c.parent),
expanded AS (SELECT coalesce(pid, id) AS id, id AS child, score, rrf, coalesce(ptype, type) AS type, coalesce(ptitle, title) AS title, CASE WHEN pid IS NULL THEN text ELSE ptext END AS text FROM keyed QUALIFY row_number() OVER (PARTITION BY coalesce(pid, id) ORDER BY score DESC, rrf DESC, id) = 1)"""


@query(f"WITH {_CANDIDATES}, {_EXPANDED} SELECT id, child, score, type, title, md5(text) AS digest FROM expanded")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.expanded_to_parents(_candidates(spark, sf_dir), _chunks(spark, sf_dir))
    return found.select("id", "child", F.col("score").cast("double").alias("score"), "type", "title", F.md5("text").alias("digest"))


@query(f"WITH {_CANDIDATES} SELECT DISTINCT parent FROM cand WHERE parent IS NOT NULL")
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where("parent is not null").select("parent").distinct()


@query(f"""WITH {_CANDIDATES}, {_EXPANDED}, top AS (SELECT * FROM expanded ORDER BY score DESC, id LIMIT 5)
SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, floor(score * 10000 + 0.5) / 10000 AS score, title, md5(text) AS digest FROM top WHERE score >= 0.35""")
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, fusion, reranking, parents, top-k, threshold, order and the rounded view."""
    found = retrieval.expanded_to_parents(_candidates(spark, sf_dir), _chunks(spark, sf_dir))
    top = retrieval.top_k(found, retrieval.clamped(0), 0.35)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # top-k rows
    return top.select("id", rank.alias("rank"), T.rounded4(F.col("score").cast("double")).alias("score"), "title", F.md5("text").alias("digest"))


@query(f"""WITH {_CANDIDATES}, {_EXPANDED}, top AS (SELECT * FROM expanded ORDER BY score DESC, id LIMIT 10),
labels AS (SELECT row_number() OVER (ORDER BY score DESC, top.id) AS rank, url || coalesce(' > ' || nullif(title, ''), '') AS label FROM top JOIN pages ON page_id = child % 5)
SELECT list(label ORDER BY first) AS labels FROM (SELECT label, min(rank) AS first FROM labels GROUP BY label)""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct labels of the ten best results, first occurrence first."""
    found = retrieval.top_k(retrieval.expanded_to_parents(_candidates(spark, sf_dir), _chunks(spark, sf_dir)), retrieval.clamped(50, 10))
    ranked = found.select((F.col("child") % 5).alias("page_id"), "title", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    return retrieval.source_labels(retrieval.looked_up(ranked, table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file")), "page_id"))


@query(f"WITH {catalog._DENSE} SELECT id, score, round(0.7 / (60 + row_number() OVER (ORDER BY score DESC, id)), 9) AS rrf FROM dense")
def search_without_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question without keywords is answered by vectors alone."""
    return retrieval.fuse(catalog.dense_topk(spark, sf_dir), retrieval.keyword_recall(table(spark, sf_dir, "documents"), []))


@query("SELECT vec_id AS id, 0.0::DOUBLE AS score, 0.0::DOUBLE AS rrf FROM embeddings WHERE false")
def search_without_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant without rows gets no results."""
    dense = retrieval.dense_recall(table(spark, sf_dir, "embeddings").where("label = -1"), catalog._query_vector(spark, sf_dir))
    sparse = retrieval.keyword_recall(table(spark, sf_dir, "documents").where("source = 'nobody'"), catalog._query_words(spark, sf_dir))
    return retrieval.top_k(retrieval.fuse(dense, sparse), threshold=0.35)


# Many questions: each of some items asks by its keywords, and by the vector of its id where there is one.
_FIFTIETH = "benchmark WHERE item_id % 50 = 0"


def _many_sql(items: str) -> str:
    return rf"""toks AS (SELECT item_id AS query, unnest({catalog._TOKENS}) t FROM {items}),
firsts AS (SELECT DISTINCT query, t FROM toks WHERE length(t) >= 2 AND t NOT IN ({catalog._STOP})), asked AS (SELECT query, count(*) AS k FROM firsts GROUP BY query),
dtok AS (SELECT doc_id AS id, unnest({catalog._TOKENS}) t, generate_subscripts({catalog._TOKENS}, 1) i FROM documents),
counts AS (SELECT query, id, t, count(*) AS n FROM dtok JOIN firsts USING (t) GROUP BY ALL),
anys AS (SELECT query, id, count(*) = any_value(k) AS every, any_value(k) AS k, sum(list_sum([1.0::DOUBLE / (j * j) FOR j IN range(1, n + 1)])) * 0.1 / 1.64493406685 / any_value(k) AS score FROM counts JOIN asked USING (query) GROUP BY query, id),
full_ AS (SELECT query, id, t, i FROM dtok JOIN anys USING (id) JOIN firsts USING (query, t) WHERE every),
everys AS (SELECT query, x.id, 1 - product(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(x.i - y.i) / 1.5 - 2)))) AS score FROM full_ x JOIN full_ y USING (query, id) WHERE y.t < x.t AND abs(x.i - y.i) <= 100 GROUP BY query, x.id),
hits AS (SELECT a.query, a.id, every, round(CASE WHEN every AND k > 1 THEN coalesce(e.score, 0) ELSE a.score END, 6) AS score, bool_or(every) OVER (PARTITION BY a.query) AS any_every FROM anys a LEFT JOIN everys e USING (query, id)),
sparse AS (SELECT query, id, score FROM hits WHERE every OR NOT any_every QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20)"""


def _fused_sql(items: str) -> str:
    return f"""q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM {items})),
dense AS (SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) <= 20), {_many_sql(items)},
parts AS (SELECT query, id, score AS d, NULL AS s, 0.7 / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, id)) AS part FROM dense
  UNION ALL SELECT query, id, NULL, score, 0.3 / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, id)) FROM sparse),
fused AS (SELECT query, id, coalesce(max(d), max(s)) AS score, round(sum(part::DOUBLE), 9) AS rrf FROM parts GROUP BY query, id)"""


def _fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0")


def _index(spark: SparkSession, sf_dir: str) -> postings.Index:
    return postings.build(table(spark, sf_dir, "documents"), scratch_path(spark, "index"))


def _fused_many(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    dense = retrieval.dense_recall_many(vectors, vectors.join(questions.select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    return retrieval.fuse(dense, postings.recall(_index(spark, sf_dir), questions)[0], by="query")


@query(rf"WITH t AS (SELECT doc_id, unnest({catalog._TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM t GROUP BY term")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inverted index holds of each word."""
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("places"))


@query(f"WITH {_many_sql(_FIFTIETH)} SELECT query, id, score FROM sparse")
def keyword_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search for every fiftieth item against all documents, through the index."""
    return postings.recall(_index(spark, sf_dir), _fiftieth(spark, sf_dir))[0]


@query(f"WITH {_fused_sql('benchmark')}, top AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5) SELECT query, id, score, rrf FROM top WHERE score >= 0.35")
def hybrid_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both recalls of every item fused, its best and no others below the threshold."""
    return retrieval.top_k(_fused_many(spark, sf_dir, table(spark, sf_dir, "benchmark")), threshold=0.35, by="query")


@query(f"""WITH {_fused_sql(_FIFTIETH)}, {_CHUNKS}, {_SCORES}, cand AS (SELECT query, f.id, coalesce(rerank, 0) AS score, rrf, parent, type, title, text FROM fused f LEFT JOIN chunk USING (id) LEFT JOIN score_of USING (id)),
keyed AS (SELECT c.*, p.id AS pid, p.title AS ptitle, p.text AS ptext FROM cand c LEFT JOIN chunk p ON p.id = c.parent),
expanded AS (SELECT query, coalesce(pid, id) AS id, id AS child, score, rrf, CASE WHEN pid IS NULL THEN title ELSE coalesce(ptitle, title) END AS title, CASE WHEN pid IS NULL THEN text ELSE ptext END AS text FROM keyed QUALIFY row_number() OVER (PARTITION BY query, coalesce(pid, id) ORDER BY score DESC, rrf DESC, id) = 1)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, floor(score * 10000 + 0.5) / 10000 AS score, title, md5(text) AS digest FROM (SELECT * FROM expanded QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5) WHERE score >= 0.35""")
def search_pipeline_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for every fiftieth item: recalls, fusion, reranking, parents, top-k, threshold."""
    fused = retrieval.looked_up(_fused_many(spark, sf_dir, _fiftieth(spark, sf_dir)), _chunks(spark, sf_dir), "id")
    found = retrieval.expanded_to_parents(retrieval.reranked(fused, _scores(spark, sf_dir)), _chunks(spark, sf_dir), by="query")
    top = retrieval.top_k(found, threshold=0.35, by="query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return top.select("query", "id", rank.alias("rank"), T.rounded4(F.col("score").cast("double")).alias("score"), "title", F.md5("text").alias("digest"))
