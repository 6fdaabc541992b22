"""Hybrid retrieval: dense and keyword recall, reciprocal rank fusion, parent collapse, top-k, threshold.

Recall runs on narrow columns and ends in TakeOrderedAndProject or a group limit, so wide texts are joined after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import metric
from quillspark.sources.scratch import staged

RECALL, TOP_K, RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 20, 5, 60, 0.7, 0.3


def dense_recall(vectors: DataFrame, query: list[float], n: int = RECALL) -> DataFrame:
    """(id, score) of the n vectors of highest cosine, ties by id."""
    score = F.round(T.cosine(F.col("embedding"), F.lit(query).cast("array<double>")), 6)
    return vectors.select(F.col("vec_id").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(n)


def dense_recall_many(vectors: DataFrame, queries: DataFrame, n: int = RECALL) -> DataFrame:
    """(query, id, score): for each query (vec_id, embedding) its n vectors of highest cosine, ties by id. See ``metric.recall``."""
    return metric.recall(vectors, queries, n)[0]


#: Fixed values of the rank formulas: a word's weight, the limit of the sum of 1 / j ** 2, and the fall of weight with distance.
WEIGHT, ZETA2, FAR = 0.1, 1.64493406685, 100
_NEARNESS = "1.005D + 0.05D * exp(abs(x.i - y.i) / 1.5D - 2D)"


def places(text: Column, words: list[str]) -> Column:
    """Where the words stand in a text: (t, i) of each occurrence, i counted from 1."""
    numbered = F.transform(T.tokens(text), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i")))
    return F.filter(numbered, lambda p: p["t"].isin(*words))


def any_rank(found: str, words: int) -> Column:
    """The rank of a query of alternatives: each word's occurrences weigh 1, 1/4, 1/9 and so on; the mean over all words asked for."""
    each = f"transform(array_distinct({found}.t), w -> aggregate(sequence(1, size(filter({found}, p -> p.t = w))), 0D, (s, j) -> s + 1D / (j * j)))"
    return F.expr(f"aggregate({each}, 0D, (s, x) -> s + x)") * (WEIGHT / ZETA2 / max(words, 1))


def every_rank(found: str) -> Column:
    """The rank of a query that wants all words: each pair of places of two words adds to it, the more the nearer they are."""
    pair = f"case when y.t < x.t and abs(x.i - y.i) <= {FAR} then r * (1D - {WEIGHT}D * sqrt(1D / ({_NEARNESS}))) else r end"
    return F.lit(1.0) - F.expr(f"aggregate({found}, 1D, (s, x) -> s * aggregate({found}, 1D, (r, y) -> {pair}))")


def keyword_matches(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, every) of each row with any of the distinct words: its rank, and whether it has all of them.

    The rank is that of a text search engine's simple configuration, without its caps on places (16,383 in a text, 255 of a word).
    """
    words = list(dict.fromkeys(words))
    hits = docs.select(F.col(key).alias("id"), places(F.col(text), words).alias("found")).where("size(found) > 0")
    marked = hits.withColumn("every", F.size(F.array_distinct("found.t")) == len(words))
    score = any_rank("found", len(words)) if len(words) < 2 else F.when(F.col("every"), every_rank("found")).otherwise(any_rank("found", len(words)))
    return marked.select("id", F.round(score, 6).alias("score"), "every")


def keyword_recall(docs: DataFrame, words: list[str], n: int = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the n best rows with all words, or with any word where no row has all; none for no words.

    Both forms are one pass over the texts and one top-n, in which rows with all words come first.
    """
    best = keyword_matches(docs, words, key, text).orderBy(F.desc("every"), F.desc("score"), "id").limit(n)
    any_every = F.max("every").over(Window.partitionBy())  # over n rows
    return best.withColumn("any_every", any_every).where("every or not any_every").select("id", "score")


#: Rows of keys that are broadcast at most, 8 bytes each.
BROADCAST_KEYS = 1_000_000


def looked_up(top: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """A left join of results with a large table of unique keys.

    The results are staged once. Few keys are broadcast, so that the table is only scanned; the rows found are then
    joined as Spark sees fit for their size. More keys are joined by a shuffle.
    """
    top = staged(top, "results")
    wanted = top.where(F.col(on).isNotNull()).select(on).distinct()
    few = top.count() <= BROADCAST_KEYS
    return top.join(rows.join(F.broadcast(wanted) if few else wanted, on, "left_semi"), on, "left")


def fuse(dense: DataFrame, sparse: DataFrame, by: str | None = None) -> DataFrame:
    """(id, score, rrf): the union of both lists; a dense score wins, ranks add up. With ``by``, lists of many questions, each fused on its own."""
    keys = [by] if by else []
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))  # noqa: E731  recall-sized
    a = ranked(dense).select(*keys, "id", F.col("score").alias("dense"), (DENSE_WEIGHT / (RRF_K + F.col("rank"))).alias("part"), F.lit(None).cast("double").alias("sparse"))
    b = ranked(sparse).select(*keys, "id", F.lit(None).cast("double").alias("dense"), (SPARSE_WEIGHT / (RRF_K + F.col("rank"))).alias("part"), F.col("score").alias("sparse"))
    return a.unionByName(b).groupBy(*keys, "id").agg(F.coalesce(F.max("dense"), F.max("sparse")).alias("score"), F.round(F.sum("part"), 9).alias("rrf"))


def top_k(scored: DataFrame, k: int = TOP_K, threshold: float = 0.0, by: str | None = None) -> DataFrame:
    """Highest scores first, ties by id; the threshold (none if 0 or less) cuts after the limit. With ``by``, the k highest of each question."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= k).drop("_r") if by else scored.orderBy(*order).limit(k)
    return best.where(F.lit(threshold <= 0) | (F.col("score") >= threshold))


def reranked(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Candidates (id, score, ...) with a scorer's scores (id, rerank): a candidate that it left out gets 0.

    Without a scorer, or where it failed (None), a candidate keeps its own score, 0 if it has none.
    """
    if scores is None:
        return candidates.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return candidates.drop("score").join(scores, "id", "left").withColumn("score", F.coalesce("rerank", F.lit(0.0))).drop("rerank")


def rerank_requests(candidates: DataFrame, batch: int = 8, cut: int = 510) -> DataFrame:
    """(batch, pos, id, text): what a scorer is asked, in batches by id, texts cut; null texts are empty."""
    at = F.row_number().over(Window.orderBy("id")) - 1  # recall-sized
    asked = candidates.select("id", T.truncated(F.coalesce("text", F.lit("")), cut).alias("text"), at.alias("at"))
    return asked.select(F.expr(f"cast(at div {batch} as int)").alias("batch"), (F.col("at") % batch).cast("int").alias("pos"), "id", "text")


def expanded_to_parents(scored: DataFrame, chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Candidates (id, parent, score, rrf, type, title, text) as parents: the best child of each, with the parent's id, type, title and text.

    A child whose parent is null or missing from chunks (id, type, title, text) stands for itself. With ``by``, each question's candidates on their own.
    """
    keys = [by] if by else []
    parents = chunks.select(F.col("id").alias("parent"), F.lit(True).alias("_found"), *(F.col(c).alias(f"_{c}") for c in ("type", "title", "text")))
    joined = looked_up(scored, parents, "parent").withColumn("_key", F.when(F.col("_found"), F.col("parent")).otherwise(F.col("id")))
    rank = F.row_number().over(Window.partitionBy(*keys, "_key").orderBy(F.desc("score"), F.desc("rrf"), "id"))
    best = joined.withColumn("_r", rank).where("_r = 1")
    return best.select(*keys, F.col("_key").alias("id"), F.col("id").alias("child"), "score", "rrf", F.coalesce("_type", "type").alias("type"), F.coalesce("_title", "title").alias("title"), F.when(F.col("_found"), F.col("_text")).otherwise(F.col("text")).alias("text"))


def clamped(k: int | None, most: int | None = None) -> int:
    """How many results are asked for: the default for none, at most ``most``."""
    k = TOP_K if k is None or k <= 0 else k
    return k if most is None else min(k, most)


def source_labels(found: DataFrame, file: str = "file", title: str = "title") -> DataFrame:
    """(labels): the distinct labels of results (rank, file, title), first occurrence first; one row, of top-k results."""
    label = F.struct("rank", T.source_label(F.col(file), F.col(title)).alias("label"))
    return found.agg(F.array_distinct(F.array_sort(F.collect_list(label))["label"]).alias("labels"))


def collapse_to_parents(children: DataFrame) -> DataFrame:
    """(parent, id, score): the best child of each parent, ties by rrf order then id; a child without parent stands for itself."""
    key = F.coalesce("parent", -F.col("id") - 1)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("rrf"), "id"))
    return children.withColumn("_r", rank).where("_r = 1").drop("_r")
