"""Statements that change a table, carried out on one that is stored: what is read back equals the statement's twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import statements
from quillspark.plans.registry import query
from quillspark.sources import stored
from quillspark.sources.scratch import scratch_path
from quillspark.sources.tables import table


def _stored(spark: SparkSession, sf_dir: str, view: str) -> stored.Stored:
    return stored.Stored.create(statements._view(spark, sf_dir, view), scratch_path(spark, f"stored-{view}"), "id")


def _carried_out(name: str, as_name: str) -> None:
    s = next(x for x in statements.STATEMENTS if x.name == name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _stored(spark, sf_dir, s.view)
        if s.kind == "insert":
            kept.append_numbered(spark.range(1, s.rows + 1).toDF("i").select("i", *(F.expr(e).alias(c) for c, e in s.new.items())), "i")
            return kept.read()
        guard = F.expr(s.also)
        for column, value in statements._asked(s).items():
            guard &= F.col(column).isin(*value) if isinstance(value, tuple) else F.col(column) == value
        if s.kind == "delete":
            kept.delete(guard, expected=0)
        else:
            kept.update(guard, {c: F.expr(e) for c, e in s.new.items()}, expected=0)
        return kept.read()

    run.__name__ = as_name
    query(statements._twin(s))(run)


_carried_out("sql_exam_answers_submit", "stored_answers_submit")
_carried_out("sql_embedding_rows_insert_batch", "stored_vectors_insert")
_carried_out("sql_exam_context_insert_batch", "stored_context_insert")


@query("SELECT 'files' AS what, count(*) AS n FROM pages WHERE page_id % 9 <> 2 UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id % 300 NOT IN (SELECT page_id FROM pages WHERE page_id % 9 = 2) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id % 300 NOT IN (SELECT page_id FROM pages WHERE page_id % 9 = 2)")
def stored_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are deleted from stored tables with their chunks and vectors; what is left of each."""
    path = scratch_path(spark, "cascade")
    files = stored.Stored.create(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), f"{path}/files", "id")
    chunks = stored.Stored.create(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("document_id")), f"{path}/chunks", "id")
    vectors = stored.Stored.create(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 300).alias("document_id")), f"{path}/vectors", "id")
    stored.cascade(files, [(chunks, "document_id"), (vectors, "document_id")], F.col("id") % 9 == 2)
    parts = [t.read().agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, t in (("files", files), ("chunks", chunks), ("vectors", vectors))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
