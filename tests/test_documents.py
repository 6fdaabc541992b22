"""Parsers and chunk building on literal fixtures."""

from quillspark.operators import chunks
from quillspark.sources import nodes as N

MARKDOWN = "intro\n\n# A\n\n### C\ntext ![x](pic.png) tail\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n## Empty\n\n## B\n```java\nint x;\n```\n![far](http://h/i.png)\n"


def test_markdown():
    got = [(n.type, n.text, n.title_path) for n in N.markdown_nodes(MARKDOWN)]
    assert got == [
        ("text", "intro", None), ("heading", "C", "A > C"), ("text", "text", "A > C"), ("image", "pic.png", "A > C"), ("text", "tail", "A > C"),
        ("table", "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>", "A > C"), ("heading", "B", "A > B"), ("code", "int x;", "A > B"),
    ]
    assert N.markdown_nodes(MARKDOWN)[-1].language == "java"


def test_code():
    java = "package p;\n\n/** Doc. */\npublic class A {\n  // says hi\n  public void hi(int x) {\n    if (x > 0) { go(); }\n  }\n}\n"
    assert [(n.title_path, n.text.split("\n")[0]) for n in N.code_nodes(java)] == [(None, "package p;"), ("A", "/** Doc. */"), ("A > hi", "  // says hi")]
    assert [n.title_path for n in N.code_nodes("import os\n\ndef f(a):\n    return a\n\nclass B:\n    def g(self):\n        pass\n")] == [None, "f", "B", "B > g"]
    assert [n.title_path for n in N.code_nodes("func main() {\n}\nint two(int a) {\n return foo(a);\n}\n")] == ["main", "two"]
    assert [n.title_path for n in N.code_nodes("x = 1\n")] == [None]


def test_lines():
    assert [n.text for n in N.line_nodes("a" * 240 + "\n\n" + "b" * 58 + "\n \nc")] == ["a" * 240 + "\n\n" + "b" * 58, "c"]
    split = N.line_nodes("short\n\n" + "One sentence here. " * 40)
    assert split[0] == N.Node("text", "short") and len({n.group_id for n in split[1:]}) == 1 and all(len(n.text) <= 300 for n in split)
    assert "".join(n.text for n in split[1:]).replace(" ", "") == ("One sentence here. " * 40).replace(" ", "")
    assert N.weak_paragraphs("p\nq\n- a\n- b\nr\n\n1. x") == ["p\nq", "- a\n- b", "r", "1. x"]
    assert [len(p) for p in N.long_pieces("x" * 700)] == [300, 300, 100] and N.long_pieces("ab, " + "y" * 299) == ["ab,", "y" * 299]


def test_chunks(spark):
    """The packing equals a plain loop, groups stay apart and have parents."""
    sizes = [(0, "a" * 100, None), (1, "b" * 198, None), (2, "c" * 2, None), (3, "d" * 400, None), (4, "e" * 200, "g"), (5, "f" * 200, "g"), (6, "h", "k"), (7, "i", None), (8, None, None)]
    df = spark.createDataFrame([(d, p, t, f"t{p}", g) for d in (1, 2) for p, t, g in sizes], "doc_id long, pos int, text string, title_path string, group_id string")
    made = chunks.chunks(df).where("doc_id = 2").orderBy("sort_order").collect()
    got = [(r.sort_order, r.chunk_level, r.parent_order, r.title_path, "".join(sorted(set(r.text) - {"\n"}))) for r in made]
    # 150 + 297 + 2 tokens fill 449 of 450; c's three tokens and a separator no longer fit
    assert got == [(0, 2, None, "t0", "ab"), (1, 2, None, "t2", "c"), (2, 2, None, "t3", "d"), (3, 1, None, "t4", "ef"), (4, 2, 3, "t4", "e"), (5, 2, 3, "t4", "f"), (6, 1, None, "t6", "h"), (7, 2, 6, "t6", "h"), (8, 2, None, "t7", "i")]
    around = {r.sort_order: r.context for r in chunks.with_context(chunks.chunks(df).where("doc_id = 2")).collect()}
    assert around[5] == "e" * 200 + "\n\n" + "f" * 200 == around[3] and around[0] is None


def test_nodes_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "word", "x"), (4, "  \n", "x")], "doc_id long, text string, pos string")
    for parse in (N.line_nodes, N.markdown_nodes, N.code_nodes):
        assert [(r.doc_id, r.pos, r.text) for r in N.nodes(df, parse).collect()] == [(None, 0, "word")]
    assert chunks.chunks(N.nodes(df.where("false"), N.line_nodes)).count() == 0
