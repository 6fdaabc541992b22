"""Mutations that write: only touched buckets get new files, stale writers fail, and what broke off is finished."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.sources import stored
from quillspark.sources.stored import StaleVersion, Stored

ROWS = [(i, f"u{i % 7}", i % 3 == 0, None) for i in range(200)] + [(None, "nobody", None, None)]
SCHEMA = "id long, user string, done boolean, score int"


@pytest.fixture()
def table(spark, tmp_path):
    return Stored.create(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/t", "id", 16)


def files(table):
    """Names of the data files by partition."""
    top = Path(table.path.removeprefix("file://")) / "rows"
    return {d.name: sorted(f for f in os.listdir(d) if f.endswith(".parquet")) for d in top.iterdir() if d.is_dir()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_rewrites_only_touched_buckets(spark, table):
    before = files(table)
    assert rows(table.read()) == sorted(ROWS, key=str) and table.version == 0 and len(before) == 16
    guard = F.col("id").isin(7, 8, 11) & ~F.col("done")
    assert table.update(guard, {"score": F.lit(5), "done": F.lit(True)}, expected=0) == 1
    want = [(i, u, True, 5) if i in (7, 8, 11) else (i, u, d, s) for i, u, d, s in ROWS]
    assert rows(table.read()) == sorted(want, key=str)
    after = files(table)
    changed = {k for k in before if before[k] != after[k]}
    touched = {f"_bucket={r[0]}" for r in spark.createDataFrame([(7,), (8,), (11,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
    assert changed == touched and len(changed) < 4
    # The guard is no longer met: nothing is written, the version stays.
    assert table.update(guard, {"score": F.lit(6)}) == 1 and files(table) == after


def test_stale_writer_fails(table):
    seen = table.version
    assert table.update(F.col("id") == 1, {"score": F.lit(1)}, expected=seen) == seen + 1
    with pytest.raises(StaleVersion):
        table.update(F.col("id") == 1, {"score": F.lit(2)}, expected=seen)
    assert [r["score"] for r in table.read().where("id = 1").collect()] == [1]
    with stored.locked(table.spark, table.path), pytest.raises(RuntimeError):
        table.delete(F.col("id") == 2)
    with pytest.raises(ValueError):
        table.update(F.col("id") == 1, {"id": F.lit(2)})


def test_insert_replace_and_delete(spark, table):
    before = files(table)
    table.insert(spark.createDataFrame([(500, "new", "x")], "id long, user string, other string"))
    assert len({k for k, v in files(table).items() if before.get(k) != v}) == 1
    table.insert(spark.createDataFrame([(500, "newer", True, 9), (3, "three", None, 1)], SCHEMA), replace=True)
    found = {r["id"]: tuple(r) for r in table.read().where("id in (3, 500)").collect()}
    assert found == {500: (500, "newer", True, 9), 3: (3, "three", None, 1)}
    table.append_numbered(spark.createDataFrame([("b", 2), ("a", 1)], "user string, i int"), "i")
    assert sorted((r["id"], r["user"]) for r in table.read().where("id > 500").collect()) == [(501, "a"), (502, "b")]
    one = spark.createDataFrame([(3,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).first()["b"]
    bucket = F.pmod(F.xxhash64("id"), F.lit(16)) == one
    table.delete(bucket)
    assert f"_bucket={one}" not in files(table) and table.read().where(bucket).count() == 0
    assert table.read().where("id is null").count() == 1
    table.delete_keys(spark.createDataFrame([("u1",), ("u2",), (None,)], "user string"), "user")
    assert {r["user"] for r in table.read().select("user").distinct().collect()} & {"u1", "u2"} == set()


@pytest.mark.parametrize("written", [0, 1])
def test_break_after_the_intent(spark, table, monkeypatch, written):
    """The driver is lost before the partitions are overwritten, or before the version is counted up; the next reader finishes."""
    kept = Stored.recovered
    done = []

    def broken(self):
        if self._text("_intent"):
            done.append(1)
            if written:
                monkeypatch.setattr(stored, "_written", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                kept(self)
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Stored, "recovered", broken)
        with pytest.raises(OSError):
            table.update(F.col("user") == "u1", {"score": F.lit(3)})
    monkeypatch.undo()
    assert done and table.version == 0
    assert {r["score"] for r in table.read().where("user = 'u1'").collect()} == {3} and table.version == 1
    assert not [n for n in os.listdir(table.path.removeprefix("file://")) if n.startswith(("_pending", "_intent", "lock"))]


def test_cascade(spark, tmp_path):
    parents = Stored.create(spark.range(20), f"file://{tmp_path}/p", "id", 4)
    children = Stored.create(spark.range(100).select("id", (F.col("id") % 20).alias("parent")), f"file://{tmp_path}/c", "id", 4)
    stored.cascade(parents, [(children, "parent")], F.col("id") < 5)
    assert parents.read().count() == 15 and children.read().count() == 75 and children.read().where("parent < 5").count() == 0


def test_empty_table(spark, tmp_path):
    table = Stored.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e", "id")
    assert table.read().count() == 0 and table.delete(F.lit(True)) == 0
    table.insert(spark.createDataFrame(ROWS[:3], SCHEMA))
    assert rows(table.read()) == sorted(ROWS[:3], key=str)
