"""The single-table statements of a row store, each as a registered query over stand-in tables.

A stand-in table is a projection of a given table by expressions that Spark and DuckDB read alike. A
statement names its table, its conditions and what it does; ``_run`` builds the DataFrame from the
functions of ``operators.tables``, ``_twin`` the SQL. Mutations return the rewritten table. The time
of a change and the current day are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import tables
from quillspark.plans.registry import query
from quillspark.sources.tables import table

NOW, TODAY = "TIMESTAMP '2024-02-01 00:00:00'", "DATE '2024-01-07'"

#: Stand-in tables: the table they are cut from, its condition, and their columns.
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "agent_steps": ("events", "true", {"id": "event_id", "session_id": "user_id", "chat_message_id": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 97 END", "step_order": "event_id % 10", "step_type": "event_type", "content": "props"}),
    "chat_messages": ("conversations", "true", {"id": "conv_id * 1000 + turn", "session_id": "conv_id", "user_id": "conv_id % 7", "parent_id": "CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END", "type": "role", "content": "text", "nearest_summary_id": "CASE WHEN turn > 2 THEN conv_id * 1000 ELSE NULL END", "created_at": "turn"}),
    "chat_sessions": ("conversations", "turn = 0", {"id": "conv_id", "user_id": "conv_id % 7", "title": "text", "updated_at": "CAST(NULL AS TIMESTAMP)"}),
    "exam_answers": ("labels", "true", {"id": "doc_id", "exam_id": "doc_id % 50", "user_id": "doc_id % 10", "answers": "CAST(quality AS VARCHAR(9))", "is_completed": "toxic = 1", "completed_at": "CAST(NULL AS TIMESTAMP)"}),
    "exam_context": ("lineitem", "true", {"id": "l_orderkey * 10 + l_linenumber", "exam_id": "l_orderkey", "question_order": "l_linenumber", "answer": "l_returnflag"}),
    "exams": ("orders", "true", {"id": "o_orderkey", "user_id": "o_custkey % 20", "title": "o_orderpriority", "status": "o_orderstatus", "linked_plan_id": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END", "created_at": "o_orderdate"}),
    "study_plans": ("customer", "true", {"id": "c_custkey", "user_id": "CAST(c_nationkey AS BIGINT)", "title": "c_name", "status": "c_mktsegment", "phase_count": "c_custkey % 6", "updated_at": "CAST(NULL AS TIMESTAMP)"}),
    "plan_phases": ("orders", "true", {"id": "o_orderkey", "plan_id": "o_custkey", "phase_order": "o_orderkey % 100", "title": "o_orderpriority"}),
    "plan_progress": ("orders", "true", {"id": "o_orderkey", "plan_id": "o_custkey", "phase_id": "o_orderkey", "user_id": "o_custkey % 20", "status": "o_orderstatus", "notes": "CAST(NULL AS VARCHAR(9))", "completed_at": "CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE NULL END"}),
    "activity_logs": ("events", "true", {"id": "event_id", "user_id": "user_id", "action_type": "CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'error' THEN 'delete' ELSE 'query' END", "created_at": "ts"}),
    "chunks": ("documents", "true", {"id": "doc_id", "document_id": "doc_id % 100", "user_id": "source", "parent_chunk_id": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id - doc_id % 4 END", "chunk_level": "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END", "chunk_text": "text", "chunk_type": "lang", "title_path": "source", "is_searchable": "doc_id % 4 <> 0", "ts_content": "lower(text)", "sort_order": "doc_id % 4"}),
    "document_files": ("pages", "true", {"id": "page_id", "user_id": "page_id % 5", "file_name": "url", "file_path": "concat('/store/', url)", "status": "CASE page_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE 'failed' END", "chunk_strategy": "CAST(NULL AS VARCHAR(9))"}),
    "embedding_rows": ("embeddings", "true", {"id": "vec_id", "chunk_id": "vec_id", "document_id": "vec_id % 300", "user_id": "label", "first": "embedding[1]"}),
    "users": ("supplier", "true", {"id": "s_suppkey", "username": "s_name", "password_hash": "md5(s_name)"}),
}


@dataclass
class Statement:
    name: str
    view: str
    kind: str
    where: dict = field(default_factory=dict)  # equal, or one of a list
    also: str = "true"  # any further condition
    order: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0
    columns: tuple[str, ...] = ()
    new: dict[str, str] = field(default_factory=dict)  # set, or the values of an inserted row
    rows: int = 1


def _s(name: str, view: str, kind: str, where: dict | None = None, **more) -> Statement:
    return Statement(f"sql_{view}_{name}", view, kind, where or {}, **more)


_TEXT = lambda x: f"'{x}'"

STATEMENTS = [
    _s("insert", "agent_steps", "insert", new={"session_id": "3", "step_order": "11", "step_type": "'note'", "content": "'new'"}),
    _s("of_message", "agent_steps", "select", {"chat_message_id": 7}, order=("step_order", "id")),
    _s("of_session", "agent_steps", "select", {"session_id": 3}, order=("chat_message_id", "step_order", "id")),
    _s("delete_session", "agent_steps", "delete", {"session_id": 3}),
    _s("bind_message", "agent_steps", "update", {"session_id": 3}, also="chat_message_id IS NULL", new={"chat_message_id": "777"}),
    _s("insert", "chat_messages", "insert", new={"session_id": "2", "user_id": "2", "parent_id": "2000", "type": "'user'", "content": "'hello'"}),
    _s("by_id", "chat_messages", "select", {"id": 2001}),
    _s("of_session", "chat_messages", "select", {"session_id": 2}, order=("created_at",)),
    _s("latest_of_session", "chat_messages", "select", {"session_id": 2}, order=("created_at DESC",), limit=1),
    _s("count_of_session", "chat_messages", "count", {"session_id": 2}),
    _s("delete_ids", "chat_messages", "delete", {"id": (2001, 3000, 5)}),
    _s("delete_session", "chat_messages", "delete", {"session_id": 2}),
    _s("nearest_summary", "chat_messages", "select", {"id": 3004}, columns=("nearest_summary_id",)),
    _s("set_nearest_summary", "chat_messages", "update", {"id": (2001, 2002, 3001)}, new={"nearest_summary_id": "2000"}),
    _s("set_parent", "chat_messages", "update", {"id": 2002}, new={"parent_id": "2000"}),
    _s("insert", "chat_sessions", "insert", new={"user_id": "2", "title": "'new'", "updated_at": NOW}),
    _s("by_id", "chat_sessions", "select", {"id": 2}),
    _s("of_user", "chat_sessions", "select", {"user_id": 2}, order=("updated_at DESC", "id"), limit=5, offset=2),
    _s("count_of_user", "chat_sessions", "count", {"user_id": 2}),
    _s("set_title", "chat_sessions", "update", {"id": 2}, new={"title": "'renamed'", "updated_at": NOW}),
    _s("touch", "chat_sessions", "update", {"id": 2}, new={"updated_at": NOW}),
    _s("delete_id", "chat_sessions", "delete", {"id": 2}),
    _s("insert", "exam_answers", "insert", new={"exam_id": "3", "user_id": "3", "answers": "'{}'", "is_completed": "false"}),
    _s("of_exam_and_user", "exam_answers", "select", {"exam_id": 3, "user_id": 3}),
    _s("submit", "exam_answers", "update", {"exam_id": (3, 4, 5), "user_id": (3, 4, 5)}, also="is_completed = false", new={"answers": "'[1]'", "is_completed": "true", "completed_at": NOW}),
    _s("save_draft", "exam_answers", "update", {"exam_id": (3, 4, 5), "user_id": (3, 4, 5)}, also="is_completed = false", new={"answers": "'[2]'"}),
    _s("insert_batch", "exam_context", "insert", new={"exam_id": "3", "question_order": "CAST(i AS INT)", "answer": "concat('N', CAST(i AS VARCHAR(9)))"}, rows=4),
    _s("of_exam", "exam_context", "select", {"exam_id": 3}, order=("question_order",)),
    _s("insert", "exams", "insert", new={"user_id": "3", "title": "'new'", "status": "'O'", "created_at": NOW}),
    _s("by_id", "exams", "select", {"user_id": 3, "id": 37}),
    _s("of_user", "exams", "select", {"user_id": 3, "status": None}, order=("created_at DESC", "id"), limit=10),
    _s("of_user_and_status", "exams", "select", {"user_id": 3, "status": "O"}, order=("created_at DESC", "id"), limit=10, offset=10),
    _s("count_of_user", "exams", "count", {"user_id": 3, "status": ""}),
    _s("count_of_user_and_status", "exams", "count", {"user_id": 3, "status": "O"}),
    _s("of_plan", "exams", "select", {"user_id": 3, "linked_plan_id": 103}, order=("created_at DESC", "id")),
    _s("set_status", "exams", "update", {"id": 37}, new={"status": "'done'"}),
    _s("link_plan", "exams", "update", {"id": (32, 33, 36)}, also="linked_plan_id IS NULL", new={"linked_plan_id": "5"}),
    _s("insert", "study_plans", "insert", new={"user_id": "3", "title": "'new'", "status": "'active'", "phase_count": "0"}),
    _s("by_id", "study_plans", "select", {"user_id": 3}, also="id % 9 = 1"),
    _s("of_user", "study_plans", "select", {"user_id": 3, "status": None}, order=("id DESC",), limit=10),
    _s("of_user_and_status", "study_plans", "select", {"user_id": 3, "status": "BUILDING"}, order=("id DESC",), limit=10),
    _s("count_of_user", "study_plans", "count", {"user_id": 3, "status": None}),
    _s("count_of_user_and_status", "study_plans", "count", {"user_id": 3, "status": "BUILDING"}),
    _s("set_status", "study_plans", "update", {"id": 3}, new={"status": "'completed'", "updated_at": NOW}),
    _s("set_phase_count", "study_plans", "update", {"id": 3}, new={"phase_count": "9", "updated_at": NOW}),
    _s("insert_batch", "plan_phases", "insert", new={"plan_id": "3", "phase_order": "i", "title": "concat('phase ', CAST(i AS VARCHAR(9)))"}, rows=3),
    _s("of_plan", "plan_phases", "select", {"plan_id": 3}, order=("phase_order",)),
    _s("insert_batch", "plan_progress", "insert", new={"plan_id": "3", "phase_id": "i", "user_id": "3", "status": "'not_started'"}, rows=3),
    _s("of_plan", "plan_progress", "select", {"plan_id": 3, "user_id": 3}, order=("phase_id",)),
    _s("of_phase", "plan_progress", "select", {"phase_id": 33}, also="user_id >= 0"),
    _s("set_status_done", "plan_progress", "update", {"phase_id": (33, 34)}, new={"status": "'completed'", "notes": "'read'", "completed_at": f"CASE WHEN 'completed' = 'completed' THEN {NOW} ELSE completed_at END"}),
    _s("set_status_open", "plan_progress", "update", {"phase_id": (33, 34)}, new={"status": "'in_progress'", "notes": "'read'", "completed_at": f"CASE WHEN 'in_progress' = 'completed' THEN {NOW} ELSE completed_at END"}),
    _s("count_of_plan", "plan_progress", "count", {"plan_id": 3, "user_id": 3, "status": None}),
    _s("count_of_plan_and_status", "plan_progress", "count", {"plan_id": 3, "user_id": 3, "status": "O"}),
    _s("insert", "activity_logs", "insert", new={"user_id": "3", "action_type": "'query'", "created_at": NOW}),
    _s("of_user", "activity_logs", "select", {"user_id": 3}, order=("created_at DESC", "id")),
    _s("count_of_action_in_range", "activity_logs", "count", {"user_id": 3, "action_type": "query"}, also="created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-20 00:00:00'"),
    _s("uploads_today", "activity_logs", "count", {"action_type": "upload"}, also=f"CAST(created_at AS DATE) = {TODAY}"),
    _s("queries_today", "activity_logs", "count", {"action_type": "query"}, also=f"CAST(created_at AS DATE) = {TODAY}"),
    _s("delete_id", "activity_logs", "delete", {"id": 3}),
    _s("delete_user", "activity_logs", "delete", {"user_id": 3}),
    _s("insert", "chunks", "insert", new={"document_id": "3", "user_id": "'src3'", "chunk_level": "2", "chunk_text": "'new'", "is_searchable": "true", "sort_order": "9"}),
    _s("by_id", "chunks", "select", {"id": 3}),
    _s("of_document", "chunks", "select", {"document_id": 3}, order=("id",)),
    _s("of_user", "chunks", "select", {"user_id": "src3"}, order=("id DESC",)),
    _s("by_ids", "chunks", "select", {"id": (3, 5, 8, 1000000)}),
    _s("delete_id", "chunks", "delete", {"id": 3}),
    _s("set_search_text", "chunks", "update", {"id": (3, 5)}, new={"chunk_type": "'general'", "title_path": "'A > B'", "is_searchable": "true", "ts_content": "lower(concat(title_path, ' ', chunk_text))"}),
    _s("delete_document", "chunks", "delete", {"document_id": 3}),
    _s("delete_user", "chunks", "delete", {"user_id": "src3"}),
    _s("siblings", "chunks", "select", {"parent_chunk_id": 8}, order=("sort_order",)),
    _s("of_document_in_order", "chunks", "select", {"document_id": 8}, order=("sort_order", "id")),
    _s("insert", "document_files", "insert", new={"user_id": "3", "file_name": "'new.md'", "file_path": "'/store/0/new.md'", "status": "'processing'"}),
    _s("by_id", "document_files", "select", {"id": 3}),
    _s("of_user_and_name", "document_files", "select", {"user_id": 3}, also="file_name LIKE '%1%'", order=("id DESC",), limit=1),
    _s("of_user", "document_files", "select", {"user_id": 3}, order=("id DESC",)),
    _s("of_user_and_status", "document_files", "select", {"user_id": 3, "status": "completed"}, order=("id DESC",)),
    _s("page_of_user", "document_files", "select", {"user_id": 3}, order=("id DESC",), limit=5, offset=5),
    _s("count_of_user", "document_files", "count", {"user_id": 3}),
    _s("set_status", "document_files", "update", {"id": 3}, new={"status": "'failed'"}),
    _s("set_strategy", "document_files", "update", {"id": 3}, new={"status": "'completed'", "chunk_strategy": "'node_based'"}),
    _s("set_path", "document_files", "update", {"id": 3}, new={"file_path": "'/store/3/source'"}),
    _s("delete_id", "document_files", "delete", {"id": 3}),
    _s("delete_user", "document_files", "delete", {"user_id": 3}),
    _s("insert_batch", "embedding_rows", "insert", new={"chunk_id": "i", "document_id": "3", "user_id": "3"}, rows=5),
    _s("delete_chunks", "embedding_rows", "delete", {"chunk_id": (3, 5, 8)}),
    _s("delete_user", "embedding_rows", "delete", {"user_id": 3}),
    _s("insert", "users", "insert", new={"username": "'new'", "password_hash": "md5('secret')"}),
    _s("by_id", "users", "select", {"id": 3}),
    _s("by_name", "users", "select", {"username": "Supplier#000000003"}),
    _s("set_name", "users", "update", {"id": 3}, new={"username": "'renamed'", "password_hash": "md5('other')"}),
    _s("delete_id", "users", "delete", {"id": 3}),
]

# A keyword search and a vector search are statements too; they are keyword_search and vector_search in plans.search.


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, where, columns = VIEWS[name]
    exprs = [F.expr(e.replace("embedding[1]", "embedding[0]")).alias(c) for c, e in columns.items()]  # Spark counts from 0
    return table(spark, sf_dir, source).where(where).select(*exprs)


def _asked(s: Statement) -> dict:
    return {c: v for c, v in s.where.items() if v is not None and v != ""}


def _run(s: Statement):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _view(spark, sf_dir, s.view)
        if s.kind == "insert":
            rows = spark.range(1, s.rows + 1).toDF("i").select("i", *(F.expr(e).alias(c) for c, e in s.new.items()))
            return tables.inserted(df, rows, "id", "i").select(*df.columns)
        if s.kind in ("select", "count"):
            found = tables.matching(df, **s.where).where(s.also)
            if s.kind == "count":
                return found.agg(F.count("*").alias("n"))
            found = found.select(*(s.columns or df.columns))
            return tables.ordered(found, [F.expr(c.removesuffix(" DESC")).desc_nulls_last() if c.endswith(" DESC") else F.expr(c).asc_nulls_last() for c in s.order], s.limit, s.offset) if s.order else found
        guard = F.expr(s.also)
        for name, value in _asked(s).items():
            guard &= F.col(name).isin(*value) if isinstance(value, tuple) else F.col(name) == value
        if s.kind == "delete":
            return tables.removed_where(df, guard)
        return tables.updated(df, guard, **{c: F.expr(e) for c, e in s.new.items()})

    run.__name__ = s.name
    return run


def _twin(s: Statement) -> str:
    source, where, columns = VIEWS[s.view]
    text = lambda v: _TEXT(v) if isinstance(v, str) else str(v)
    asked = [f"{c} IN ({', '.join(map(text, v))})" if isinstance(v, tuple) else f"{c} = {text(v)}" for c, v in _asked(s).items()]
    guard = " AND ".join([*asked, f"({s.also})"])
    cut = f"WITH v AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where}) "
    if s.kind == "insert":
        values = ", ".join(s.new.get(c, "NULL") + f" AS {c}" for c in columns if c != "id")
        return cut + f"SELECT * FROM v UNION ALL BY NAME SELECT (SELECT coalesce(max(id), 0) FROM v) + i AS id, {values} FROM (SELECT unnest(range(1, {s.rows + 1})) AS i)"
    if s.kind == "count":
        return cut + f"SELECT count(*) AS n FROM v WHERE {guard}"
    if s.kind == "select":
        order = f" ORDER BY {', '.join(c + ' NULLS LAST' for c in s.order)}" if s.order else ""
        return cut + f"SELECT {', '.join(s.columns or columns)} FROM v WHERE {guard}{order}" + (f" LIMIT {s.limit}" if s.limit is not None else "") + (f" OFFSET {s.offset}" if s.offset else "")
    if s.kind == "delete":
        return cut + f"SELECT * FROM v WHERE NOT coalesce({guard}, false)"
    return cut + "SELECT " + ", ".join(f"CASE WHEN {guard} THEN {s.new[c]} ELSE {c} END AS {c}" if c in s.new else c for c in columns) + " FROM v"


for _statement in STATEMENTS:
    query(_twin(_statement))(_run(_statement))
