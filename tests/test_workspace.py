"""The workspace: listing, reading, guarded writes, moves, and the monthly merge with breaks between its steps."""

import os

import pytest

from quillspark.operators import tables
from quillspark.plans import catalog
from quillspark.sources import workspace

MONTH = "2024-01"
TREE = {
    "7/History/2024-01/b.md": "B\n", "7/History/2024-01/a.md": "A", "7/History/2024-01/blank.md": " \n", "7/History/2024-01/.raw/old.md": "old", "7/History/2024-01/.trash/x.md": "x",
    "7/History/2024-01/_merged.md": "before", "7/History/2024-01/note.txt": "no", "7/History/2024-02/c.md": "C", "7/Learning/Current/plan.md": "plan",
    "12/History/2024-01/sub/z.md": "Zé", "13/History/2024-01/only.md": "\n", "guest/History/2024-01/a.md": "not a user",
}
MERGED = {
    "7/History/2024-01/_merged.md": "=== History/2024-01/a.md ===\nA\n\n=== History/2024-01/b.md ===\nB\n\n\n",
    "12/History/2024-01/_merged.md": "=== History/2024-01/sub/z.md ===\nZé\n\n",
    "7/History/2024-01/.raw/a.md": "A", "7/History/2024-01/.raw/b.md": "B\n", "7/History/2024-01/.raw/blank.md": " \n", "12/History/2024-01/.raw/z.md": "Zé",
}
GONE = ["7/History/2024-01/a.md", "7/History/2024-01/b.md", "7/History/2024-01/blank.md", "12/History/2024-01/sub/z.md"]


@pytest.fixture()
def root(tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return f"file://{tmp_path}"


def seen(root):
    top = root.removeprefix("file://")
    return {os.path.relpath(f"{d}/{n}", top): open(f"{d}/{n}").read() for d, _, names in os.walk(top) for n in names if not n.endswith(".crc")}


def test_list_and_read(spark, root):
    rows = {(r["user"], r["path"]): r for r in workspace.files(spark, root, partitions="3").collect()}
    assert {f"{u}/{p}": r["content"] for (u, p), r in rows.items()} == {k: v for k, v in TREE.items() if k.endswith(".md") and not k.startswith("guest")}
    assert all(r["size"] == len((r["content"] or "").encode()) and r["mtime"] > 1.6e12 for r in rows.values())
    named = workspace.files(spark, root, users="12,99", content="false").collect()
    assert [(r["user"], r["path"], r["content"]) for r in named] == [("12", "History/2024-01/sub/z.md", None)]


def test_guarded_writes(spark, root):
    base = {(r["user"], r["path"]): (r["mtime"], r["size"]) for r in workspace.files(spark, root).collect()}
    plan = ("7", "Learning/Current/plan.md")
    schema = "user string, path string, action string, content string, seen_mtime long, seen_size long, to string"
    rows = [
        (*plan, "write", "mine", *base[plan], None), (*plan, "write", "theirs", *base[plan], None),
        ("7", "new.md", "write", "first", None, None, None), ("7", "new.md", "write", "second", None, None, None),
        ("7", "gone.md", "write", "x", 5, 5, None), ("12", "../7/new.md", "write", "x", None, None, None), ("12", "/etc/x.md", "force", "x", None, None, None), ("guest", "a.md", "force", "x", None, None, None),
        ("7", "a/../..", "force", "x", None, None, None), ("7", " ", "delete", None, None, None, None), ("12", "forced.md", "force", None, None, None, None),
        ("7", "History/2024-02/c.md", "move", None, None, None, "kept/c.md"), ("7", "nothing.md", "move", None, None, None, "kept/n.md"), ("7", "History/2024-01/b.md", "move", None, None, None, "../12/b.md"), ("7", "History/2024-01/a.md", "delete", None, None, None, None),
    ]
    done = workspace.changed(spark.createDataFrame(rows, schema).coalesce(1), root).collect()
    by = lambda p: sorted(r["result"] for r in done if (r["user"], r["path"]) == p)
    assert by(plan) == ["conflict", "written"] and by(("7", "new.md")) == ["conflict", "written"] and by(("7", "gone.md")) == ["conflict"]
    assert sum(r["result"] == "refused" for r in done) == 6 and by(("7", "nothing.md")) == ["missing"] and by(("7", "History/2024-01/a.md")) == ["deleted"]
    now = seen(root)
    assert now["7/Learning/Current/plan.md"] == "mine" and now["7/new.md"] == "first" and now["12/forced.md"] == "" and now["7/kept/c.md"] == "C"
    assert not {"7/gone.md", "7/History/2024-02/c.md", "7/History/2024-01/a.md", "12/b.md"} & set(now) and not any(workspace.JOBS in k for k in now)
    # A writer that read the file before the first one won finds another baseline.
    late = workspace.changed(spark.createDataFrame([(*plan, "write", "late", *base[plan], None)], schema), root).collect()
    assert [r["result"] for r in late] == ["conflict"] and seen(root)["7/Learning/Current/plan.md"] == "mine"


def after_merge():
    return {k: v for k, v in TREE.items() if k not in GONE} | MERGED


def test_merge(spark, root):
    done = workspace.merge_month(spark, root, MONTH).collect()
    assert sorted(r["result"] for r in done) == ["moved"] * 4 + ["written"] * 2
    assert seen(root) == after_merge()
    assert workspace.merge_month(spark, root, MONTH).count() == 0 and seen(root) == after_merge()


def test_break_before_commit(spark, root):
    """A task fails: nothing is left and nothing has changed."""
    changes = workspace.merge_changes(workspace.files(spark, root, under=f"History/{MONTH}"), MONTH)
    with pytest.raises(Exception, match="division|DIVIDE"):
        workspace.committed(changes.selectExpr("user", "path", "action", "to", "case when action = 'move' then string(1 / (length(user) - length(user))) else content end as content"), root)
    (os.makedirs(root.removeprefix("file://") + "/.jobs/job-x/data"))
    assert workspace.recovered(spark, root) == [] and seen(root) == TREE


@pytest.mark.parametrize("phases", [(), ("write",)])
def test_break_after_commit(spark, root, phases):
    """The driver is lost before the changes are applied, or between the writes and the moves; the next run ends the same."""
    job = workspace.committed(workspace.merge_changes(workspace.files(spark, root, under=f"History/{MONTH}"), MONTH), root)
    if phases:
        workspace._finished(spark, root, job, phases)
    assert seen(root) != after_merge()
    assert workspace.merge_month(spark, root, MONTH).count() == 0 and seen(root) == after_merge()


def test_lock(spark, root):
    with workspace.locked(spark, f"{root}/{workspace.JOBS}"), pytest.raises(RuntimeError):
        workspace.merge_month(spark, root, MONTH)
    assert workspace.merge_month(spark, root, MONTH).count() == 6


def test_writes_of_shared_paths_and_unknown_sizes(spark, tmp_path):
    """A row stays one where files share a path, and a page without content is written as it was seen."""
    pages = [(4, "same", "a"), (8, "same", "b"), (12, None, "c"), (2, "x", None), (3, "y", "d"), (5, "z", "e")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["id"], r["result"]) for r in catalog.queries()["workspace_writes"](spark, str(tmp_path)).collect())
    assert got == [(2, "written"), (3, "written"), (4, "refused"), (5, "stale"), (8, "refused"), (12, "refused")]
    files = spark.createDataFrame([("p", 1, 1, "a"), ("p", 2, 2, "b"), ("q", 1, 1, "c")], "path string, mtime long, size long, content string")
    writes = spark.createDataFrame([("p", 1, 1, "new"), ("p", 1, 1, "also"), ("p", 9, 9, "late")], "path string, seen_mtime long, seen_size long, new string")
    assert sorted((r["path"], r["content"], r["result"] or "") for r in tables.guarded_writes(files, writes).collect()) == [("p", "also", "written"), ("p", "b", "stale"), ("q", "c", "")]


def test_monthly_archive_holds_every_text_of_the_month(spark, tmp_path):
    """No text of the month is left out because of its number, and each part follows those before it in its user's merge."""
    docs = [(i, " " if i % 100 == 1 else f"é{i}" * (i % 5 + 1)) for i in range(1, 400)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["monthly_archive"](spark, str(tmp_path)).collect()
    assert {int(r["path"][-12:-3]) for r in got} == {i for i, t in docs if i % 3 == 1 and t.strip()} and len(got) == len({r["path"] for r in got})
    text = dict(docs)
    for user in {r["user"] for r in got}:
        start = 0
        for pos, r in enumerate(sorted((r for r in got if r["user"] == user), key=lambda r: r["path"])):
            assert (r["pos"], r["start"]) == (pos, start)
            start += len(f"=== {r['path']} ===\n{text[int(r['path'][-12:-3])]}\n\n".encode())
