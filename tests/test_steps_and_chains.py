"""Rule notes, chains that end for single chunks, and Word files through the dispatcher, on literal rows."""

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import chunks, steps
from quillspark.sources import files, nodes


def test_rule_notes(spark):
    rows = [(1, 1, "tool_result", "c1", "read", "long"), (1, 2, "tool_result", None, "search", "long"), (1, 3, "tool_call", "c1", "read", "{}"), (1, 4, "tool_result", "c2", "read", "long"), (2, 5, "tool_result", "c1", "read", "long"), (1, 6, "tool_result", None, None, "long"), (1, 7, "tool_result", "c3", "x", None)]
    rules = [(1, "c1", 2, "second"), (1, "c1", 1, "too long"), (1, "search", 1, " "), (1, "c3", 1, None), (1, None, 1, "nothing"), (3, "c1", 1, "other session")]
    out = steps.rewritten(spark.createDataFrame(rows, "session int, step_order int, step_type string, call_id string, tool string, content string"), spark.createDataFrame(rules, "session int, call_id string, place int, reason string"))
    head = "[此工具结果已被 Projection 精简：toolCallId="
    want = {1: f"{head}c1, reason=too long]", 2: f"{head}search]", 3: "{}", 4: "long", 5: "long", 6: "long", 7: f"{head}c3]"}
    assert {r["step_order"]: r["content"] for r in out.collect()} == want and out.columns[:2] == ["session", "step_order"]


def test_chain_ends_for_single_chunks(spark):
    made = spark.createDataFrame([(i, None) for i in range(6)], "id int, seen string")
    mark = lambda name: lambda df: df.withColumn("seen", F.concat_ws("", "seen", F.lit(name)))
    added = lambda df: df.withColumn("late", F.col("id") * 10)
    last = lambda df: chunks.stopping(F.col("id") == 2)(mark("b")(df))
    out = chunks.handled(made, [(3, mark("c")), (0, mark("a")), (1, last), (2, chunks.stopping(F.when(F.col("id") == 5, None).otherwise(F.col("id") > 3))), (4, added)])
    assert {r["id"]: (r["seen"], r["late"]) for r in out.collect()} == {0: ("abc", 0), 1: ("abc", 10), 2: ("ab", None), 3: ("abc", 30), 4: ("ab", None), 5: ("abc", 50)}
    assert out.columns == ["id", "seen", "late"]
    assert [r["seen"] for r in chunks.handled(made, [(0, mark("a")), (1, lambda df: None), (2, mark("b"))]).distinct().select("seen").distinct().collect()] == ["a"]


def test_word_files_are_dispatched(spark):
    def docx(*paragraphs):
        body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as archive:
            archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return bytearray(raw.getvalue())

    long = [("", f"{c * 120}.") for c in "abcdef"]
    rows = [(1, "a.docx", None, docx(("Heading1", "Top"), ("", "one"), ("", "two"), ("Heading2", "Sub"), *long)), (2, "b.docx", None, None), (3, "c.docx", None, bytearray(b"broken")), (4, "d.md", "# H\n\ntext", None), (5, "e.txt", "line", docx(("", "no")))]
    got = files.parsed(spark.createDataFrame(rows, "doc_id long, path string, text string, content binary"), content="content").orderBy("doc_id", "pos").collect()
    shown = [(r["doc_id"], r["document_type"], r["pos"], r["type"], r["text"], r["title_path"], r["group_id"] is not None) for r in got]
    pieces = nodes.cluster_pieces("\n".join(t for _, t in long))
    assert len(pieces) > 1
    assert shown[:3] == [(1, "docx", 0, "heading", "Top", "Top", False), (1, "docx", 1, "text", "one\ntwo", "Top", False), (1, "docx", 2, "heading", "Sub", "Top > Sub", False)]
    assert shown[3 : 3 + len(pieces)] == [(1, "docx", 3 + i, "text", p, "Top > Sub", True) for i, p in enumerate(pieces)]
    assert [(d, k, t) for d, _, _, k, t, _, _ in shown[3 + len(pieces) :]] == [(4, "heading", "H"), (4, "text", "text"), (5, "text", "line")]
    assert len({r["group_id"] for r in got if r["doc_id"] == 1 and r["group_id"]}) == 1
