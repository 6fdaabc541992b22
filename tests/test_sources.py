"""HTML pages, files of several encodings, dispatch by type, token counts, and the smaller rules of retrieval and ingest."""

import io
import zipfile

import public_tokenizers
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import ingest, learning, retrieval, tables
from quillspark.plans import catalog
from quillspark.sources import files
from quillspark.sources.html import page_nodes
from quillspark.sources.office import docx_nodes
from quillspark.streaming import requests


def test_html():
    page = """<html><head><title>t</title><style>p {}</style></head><body>lead <p>in</p><h1>A</h1>one<h3>B</h3><script>x()</script><div>two</div><h3>C</h3>three
<form><h2>D</h2>in form</form>after<table class="k"><tr><td>a &amp; b</td></tr></table><section><h2>E</h2>five</section>six</body></html>"""
    got = [(n.type, " ".join(n.text.split()), n.title_path) for n in page_nodes(page)]
    assert got == [
        ("text", "lead in", None), ("text", "A one", "A"), ("text", "B two", "A > B"), ("text", "C three", "A > B > C"), ("text", "D in form", "A > D"), ("text", "after", "A > D"),
        ("table", '<table class="k"><tr><td>a &amp; b</td></tr></table>', "A > D"), ("text", "E five", "A > E"), ("text", "six", "A > E"),
    ]


def test_html_without_structure():
    assert [n.text for n in page_nodes("<p>a</p>\n\n<p>b</p>")] == ["a\nb"]
    long = page_nodes("<div>" + "x" * 240 + "\n\n" + "y" * 20 + "\n\n" + "z " * 200 + "</div>")
    assert [n.text for n in long][:2] == ["x" * 240, "y" * 20] and all(len(n.text) <= 300 for n in long) and long[2].group_id
    assert page_nodes("<!-- only -->") == [] and page_nodes("<h1>open")[0].text == "open"


def test_html_references():
    """Only whole references are read: of known names or numbers, up to a semicolon."""
    page = '<body><h1>a&amp b&ampc &lt; &#39;&#x41; &nosuch; &notit; & &#38</h1>x &amp;lt;<table id="1&amp2"><tr><td>p&amp q</td></tr></table>\ue000</body>'
    assert [(n.text, n.title_path) for n in page_nodes(page)] == [
        ("a&amp b&ampc < 'A &nosuch; &notit; & &#38 x &lt;", "a&amp b&ampc < 'A &nosuch; &notit; & &#38"),
        ('<table id="1&amp2"><tr><td>p&amp;amp q</td></tr></table>', "a&amp b&ampc < 'A &nosuch; &notit; & &#38"), ("\ue000", "a&amp b&ampc < 'A &nosuch; &notit; & &#38"),
    ]


def test_parsed_pages_with_broken_references(spark, tmp_path):
    pages = [(1, "u", "<html><body><nav>n</nav><article><h1>a &amp b</h1>c</article></body></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [x["text"] for x in catalog.queries()["parsed_documents"](spark, str(tmp_path)).orderBy("pos").collect()] == ["n", "a &amp b c"]


def test_encodings(spark, tmp_path):
    raw = {"a.txt": "é ü".encode(), "b.txt": "中文".encode("gbk"), "c.txt": b"\xff\xfe\xfa\x81", "d.txt": b""}
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
    got = {x["path"].rsplit("/", 1)[1]: x["text"] for x in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "é ü", "b.txt": "中文", "c.txt": files.decoded(raw["c.txt"])}


def test_dispatch(spark):
    docs = [(1, "a.md", "# T\nbody"), (2, None, "<html><body>x<h1>h</h1>y</body></html>"), (3, "m.rs", "fn main() {\n}\n"), (4, "x.log", "line"), (5, "x.pdf", "text"), (6, "a.md", None)]
    got = [(x["doc_id"], x["document_type"], x["type"], x["language"]) for x in files.parsed(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()]
    assert got == [(1, "markdown", "heading", None), (1, "markdown", "text", None), (2, "html", "text", None), (2, "html", "text", None), (3, "code", "code", "rust"), (4, "linebased", "text", None)]


def test_bpe_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a  b",)], "t string")
    counts = [x[0] for x in df.select(files.bpe_tokens(F.col("t"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).collect()]
    assert counts == [2, 0, 0, 3]


def test_ranks(spark):
    """The rank of alternatives adds occurrences as 1, 1/4, 1/9; the rank of all words adds pairs by nearness."""
    docs = spark.createDataFrame([(1, "x a a a"), (2, "a b"), (3, "a x x b a"), (4, "none"), (5, None)], "doc_id long, text string")
    score = {x["id"]: (x["score"], x["every"]) for x in retrieval.keyword_matches(docs, ["a", "b", "a"]).collect()}
    near = lambda d: 0.1 * (1 / (1.005 + 0.05 * 2.718281828459045 ** (d / 1.5 - 2))) ** 0.5
    assert score[1] == (round(0.1 * (1 + 1 / 4 + 1 / 9) / 1.64493406685 / 2, 6), False)
    assert score[2] == (round(near(1), 6), True) and score[3] == (round(1 - (1 - near(3)) * (1 - near(1)), 6), True) and set(score) == {1, 2, 3}
    assert {x["id"] for x in retrieval.keyword_recall(docs, ["a", "b"]).collect()} == {2, 3}
    assert {x["id"] for x in retrieval.keyword_recall(docs, ["x", "none"]).collect()} == {1, 3, 4}
    assert retrieval.keyword_recall(docs, []).count() == 0


def test_clamps():
    assert [retrieval.clamped(k) for k in (None, 0, -1, 7)] == [5, 5, 5, 7] and [retrieval.clamped(k, 10) for k in (0, 7, 50)] == [5, 7, 10]


def test_optional_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "u int, s string")
    assert tables.matching(df, u=None, s="").count() == 3 and tables.matching(df, s="a").count() == 1 and tables.matching(df, u=[1, 2, 9]).count() == 2


def test_uploads(spark):
    known = spark.createDataFrame([(1, "a", 4), (1, "a", 7), (2, "a", 5)], "user_id int, file_name string, id long")
    new = spark.createDataFrame([(1, "a", False), (2, "a", True), (1, "b", None)], "user_id int, file_name string, overwrite boolean")
    assert {(x["user_id"], x["file_name"]): (x["code"], x["duplicate_id"]) for x in ingest.upload_codes(new, known).collect()} == {(1, "a"): (2, 7), (2, "a"): (1, 5), (1, "b"): (1, None)}
    assert sorted(tuple(x) for x in ingest.taken_in(known, new).collect()) == [(1, "a", 4), (1, "a", 7), (1, "b", 8), (2, "a", 9)]
    assert ingest.taken_in(known.where("false"), new).count() == 3


def test_faults_stop_at_the_first(spark):
    rows = [(1, 0, " ", "multi_choice", "s", "A", ["A"]), (1, 1, " ", "single_choice", "", "B", ["A"]), (2, None, "t", None, None, None, None), (3, 0, "t", "fill_blank", "s", '["x"]', None)]
    df = spark.createDataFrame(rows, "exam int, index int, title string, type string, stem string, answer string, options array<string>")
    found = learning.validate_exam(df)
    assert sorted((x["exam"], x["index"], x["field"]) for x in found.collect()) == [(1, -1, "title"), (1, 0, "answer"), (1, 1, "answer"), (1, 1, "stem"), (2, -1, "questions")]
    assert sorted((x["exam"], x["index"], x["field"]) for x in learning.first_fault(found, "exam").collect()) == [(1, -1, "title"), (2, -1, "questions")]


def test_segments(spark):
    words = spark.createDataFrame([("RAG 索引失效 的 v2",), (None,), ("。，",)], "t string").select(T.segments(F.col("t"))).collect()
    assert [x[0] for x in words] == [["rag", "索引", "引失", "失效", "的", "v2"], None, []]


def _docx(body: str) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def test_docx(spark):
    p = lambda text, style="", extra="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{extra}</w:pPr>' + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in text.split("|") if t) + "</w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "Heading1") + p("one |more") + p("two") + p("") + p("three") + p("") + p("") + p("four", extra='<w:spacing w:after="300"/>') + p("five") + p("Sub", "heading 2") + p("item", extra="<w:numPr/>")
    body += f"<w:tbl><w:tr>{cell('h')}{cell('k')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("x = 1", "SourceCode") + '<w:p><w:r><a:blip/></w:r></w:p>' + p("end")
    files = spark.createDataFrame([(1, bytearray(_docx(body))), (2, bytearray(b"no zip")), (3, None)], "doc long, content binary")
    got = [(x["doc"], x["kind"], x["text"], x["title_path"]) for x in docx_nodes(files).orderBy("doc", "pos").collect()]
    assert got == [
        (1, "heading", "Title", "Title"), (1, "body", "one more\ntwo\n\nthree", "Title"), (1, "body", "four", "Title"), (1, "body", "five", "Title"), (1, "heading", "Sub", "Title > Sub"), (1, "list", "item", "Title > Sub"),
        (1, "table", "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>", "Title > Sub"), (1, "code", "x = 1", "Title > Sub"), (1, "image", "", "Title > Sub"), (1, "body", "end", "Title > Sub"),
    ]


def test_expiring_entries(spark, tmp_path):
    """An entry is opened, hit, and expired once the watermark is past its idle time."""
    feed = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00"), ("c", "2024-01-02 20:00:00"), ("c", "2024-01-02 20:30:00")]
    for i, (k, t) in enumerate(feed):
        spark.createDataFrame([(k, t)], "session string, ts string").select("session", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = requests.expiring_entries(stream).writeStream.format("memory").queryName("entries").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    events = sorted((x["key"], x["hits"], x["event"]) for x in spark.table("entries").collect())
    assert [e for e in events if e[0] == "a"] == [("a", 1, "opened"), ("a", 2, "expired"), ("a", 2, "hit")] and ("b", 1, "expired") in events and ("c", 2, "expired") not in events
