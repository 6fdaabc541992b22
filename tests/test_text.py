"""Column functions on literal fixtures."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import learning, trees
from quillspark.streaming import requests


@pytest.mark.parametrize(
    "made, given, want",
    [
        (lambda t: T.paragraphs(t), " a \n \nb\n\n\n", ["a", "b"]),
        (lambda t: T.paragraphs(t), "", []),
        (lambda t: T.uniform_lines(t), "aaa\nbbb\nccc\n\nddd", True),
        (lambda t: T.uniform_lines(t), "aaa\nbbb\nccc", False),
        (lambda t: T.uniform_lines(t), None, False),
        (lambda t: T.frequent_gaps(t), "a\n\n\nb\n\n\nc\n \n\nd", True),
        (lambda t: T.frequent_gaps(t), "a\n\n\nb\n\n\nc\n\n\n", False),
        (lambda t: T.document_type(t, F.lit(None).cast("string")), "dir.py/name.TXT", "linebased"),
        (lambda t: T.document_type(F.lit("x"), t), "# Title", "markdown"),
        (lambda t: T.document_type(F.lit("x"), t), "import os", "code"),
        (lambda t: T.safe_file_name(t), "..\\up/a<b>.tar.gz", "a_b_.tar.gz"),
        (lambda t: T.safe_file_name(t), ".png", ".png"),
        (lambda t: T.safe_file_name(t), "dir/ . ", None),
        (lambda t: T.archive_name(t), "!学习 (Spark)!", "学习_Spark"),
        (lambda t: T.archive_name(t), "!!", "unnamed"),
        (lambda t: T.title_of(t), "x\n## Head \ny", "Head"),
        (lambda t: T.title_of(t), "<H2 id='a'>An <b>old</b> one</H2>", "An old one"),
        (lambda t: T.title_of(t), "none", None),
        (lambda t: T.snippet(t, "KEY", 9), "0123456key\n3456", "…456key 34…"),
        (lambda t: T.snippet(t, "key"), "no hit", None),
        (lambda t: T.section(t, "Plan"), "## Topic\na\n## Plan\nb\nc\n## Next\nd", "b\nc"),
        (lambda t: T.head_summary(t), "# A\n## B\nbody\n## C\n", "B\nbody"),
        (lambda t: T.head_summary(t), None, "(空)"),
        (lambda t: T.head_summary(t, 3), "abcdef", "abc…(已截断)"),
        (lambda t: T.source_label(t, F.lit("")), "f.txt", "f.txt"),
        (lambda t: T.language_of(t), "select x from y", "sql"),
        (lambda t: T.language_of(t), "plain", None),
        (lambda t: T.error_label(F.split(t, ",")), "RuntimeException,IOException", "NETWORK"),
        (lambda t: T.error_label(F.split(t, ",")), "X", "OTHER"),
        (lambda t: T.hmac_sha256("a key", t), "message é", hmac.new(b"a key", "message é".encode(), hashlib.sha256).hexdigest()),
        (lambda t: T.hmac_sha256("k" * 80, t), "", hmac.new(b"k" * 80, b"", hashlib.sha256).hexdigest()),
        (lambda t: T.signed_image(t, "s", F.lit(1)), " ", None),
        (lambda t: T.front_matter(t), "---\na: 1\nb : x: y\na: 2\n---\nbody", {"b": "x: y", "a": "2"}),
        (lambda t: T.front_matter(t), "no head", {}),
        (lambda t: T.json_object(t), '```json\n{"a": "}\\"{", "b": {"c": 1}} tail }\n```', '{"a": "}\\"{", "b": {"c": 1}}'),
        (lambda t: T.json_object(t), 'It\'s "so": {"a": {}} end', 'It\'s "so": {"a": {}}'),
        (lambda t: T.json_object(t), " {open ", "{open"),
        (lambda t: T.json_object(t), None, ""),
        (lambda t: T.rounded4(t.cast("double")), "0.12345", 0.1235),
    ],
)
def test_function(spark, made, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(made(F.col("t"))).first()[0] == want


def test_plans(spark):
    rows = [(1, "t", "g", "s", [("p",), (" ",)]), (2, None, "g", "s", []), (3, "t", "g", "s", [("p",)]), (4, "t", "g", "", None)]
    got = learning.validate_plan(spark.createDataFrame(rows, "plan int, title string, goal string, source_type string, phases array<struct<title: string>>"))
    assert sorted((r["plan"], r["index"], r["field"]) for r in got.collect()) == [(1, 1, "title"), (2, -1, "phases"), (2, -1, "title"), (4, -1, "phases"), (4, -1, "source_type")]


def test_history(spark):
    files = spark.createDataFrame([("History/2024-01/a.md", "Spark here"), ("History/2024-02/b.md", "none"), ("History/.raw/c.md", "spark"), ("Current.md", "spark"), ("History/2024-03/d.md", None)], "path string, content string")
    assert [r.path for r in trees.history_search(files, "SPARK", 9).collect()] == ["History/2024-01/a.md"]
    assert [r.path for r in trees.history_search(files, " ", 2).collect()] == ["History/2024-03/d.md", "History/2024-02/b.md"]


def test_stream_of_rules(spark, tmp_path):
    for i, batch in enumerate([[("s", "r", "ADD", "x", 1), ("s", "q", "ADD", "y", 2)], [("s", "r", "REMOVE", None, 3)]]):
        spark.createDataFrame(batch, "session string, rule string, op string, content string, at int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = requests.rules_in_force(spark.readStream.schema("session string, rule string, op string, content string, at int").json(f"{tmp_path}/in"))
        q = stream.writeStream.format("memory").queryName(f"rules{i}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp{i}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.rule, r.op) for r in spark.table("rules1").collect()) == [("q", "ADD"), ("r", "REMOVE")]


def test_kept_steps(spark):
    df = spark.createDataFrame([("heartbeat",), ("final",), ("tool_call",), (None,)], "event_type string")
    assert [r.event_type for r in requests.kept_steps(df).collect()] == ["tool_call", None]
