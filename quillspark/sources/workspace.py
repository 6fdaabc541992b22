"""Users' files in folders of their own: a data source that lists, reads and changes them, and the monthly merge of archives.

A workspace is a folder with one folder a user, whose name is a number; only ``.md`` files below it are seen, and no
path leaves it. Changes go in two steps. Tasks write new contents and a list of what is to be done into a folder of the
job; when all have ended, the driver marks the job as committed. Then the list is applied by a Spark job, writes before moves:
each is a rename or nothing, and one that was done before is known by its content having left the job's
folder. So a job that was never committed leaves no trace, and one that was is finished by ``recovered``
whenever it broke off. A lock file, created only where there is none, keeps two jobs from applying at once.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillspark.sources.scratch import locked, removed, staged

FILES = "user string, path string, mtime long, size long, content string"
#: actions: write (only onto the seen time and size, or a new file where they are null), force, append (rows of one target in a row make one file), move, delete.
CHANGES = "user string, path string, action string, content string, seen_mtime long, seen_size long, to string"
RESULTS = "user string, path string, action string, result string"
JOBS = ".jobs"
#: Names of the merged file and the hidden folders, and what stands around an archive's path and after its text in a merge.
MERGED, RAW, TRASH = "_merged.md", ".raw", ".trash"
HEAD, HEAD_END, TEXT_END = "=== ", " ===\n", "\n\n"
BATCH_BYTES = 4 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{posixpath.abspath(root)}")


def resolved(user: str | None, path: str | None) -> str | None:
    """The place of a user's path below the root; None if it is blank, leaves the user's folder, or the user is no number."""
    if not user or not user.isascii() or not user.isdigit() or not path or not path.strip() or path.startswith("/"):
        return None
    whole = posixpath.normpath(path)
    return None if whole in (".", "..") or whole.startswith("../") else f"{user}/{whole}"


@dataclass
class _Share(InputPartition):
    number: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.under = options["root"], options.get("under", "").strip("/")
        self.shares, self.content = int(options.get("partitions", "200")), options.get("content", "true").lower() == "true"
        self.users = [u for u in options.get("users", "").split(",") if u]

    def partitions(self) -> list[InputPartition]:
        return [_Share(i) for i in range(min(self.shares, len(self.users) or self.shares))]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        """The files of the users whose names hash to this share; contents are read one at a time and passed on in small batches."""
        store, root = _opened(self.root)
        shares = min(self.shares, len(self.users) or self.shares)
        names = self.users or [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory]
        rows, size = [], 0
        for user in names:
            if not (user.isascii() and user.isdigit()) or crc32(user.encode()) % shares != partition.number:
                continue
            base = f"{root}/{user}"
            for info in store.get_file_info(fs.FileSelector(f"{base}/{self.under}".rstrip("/"), recursive=True, allow_not_found=True)):
                if info.type != fs.FileType.File or not info.base_name.endswith(".md"):
                    continue
                text = None
                if self.content:
                    with store.open_input_stream(info.path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                rows.append({"user": user, "path": info.path[len(base) + 1 :], "mtime": info.mtime_ns // 1_000_000, "size": info.size, "content": text})
                size += info.size
                if size >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FILES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FILES)


_FILES = pa.schema([("user", pa.string()), ("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64()), ("content", pa.string())])


@dataclass
class _Listed(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.job = options["root"], options["job"]

    def write(self, iterator: Iterator) -> _Listed:
        """Contents into files of the job, what is to be done with them into this task's list."""
        store, root = _opened(self.root)
        folder = f"{root}/{JOBS}/{self.job}"
        store.create_dir(f"{folder}/data")
        context = TaskContext.get()
        name, place, target, stream = f"list-{context.partitionId()}-{context.taskAttemptId()}.json", 0, None, None
        with store.open_output_stream(f"{folder}/{name}") as todo:
            for row in iterator:
                if row["action"] == "append" and target == (row["user"], row["path"]):
                    stream.write((row["content"] or "").encode())
                    continue
                if stream is not None:
                    stream.close()
                    target = stream = None
                data = None
                if row["action"] in ("write", "force", "append"):
                    data = f"data/{uuid.uuid4().hex}"
                    stream = store.open_output_stream(f"{folder}/{data}")
                    stream.write((row["content"] or "").encode())
                    if row["action"] == "append":
                        target = (row["user"], row["path"])
                line = {c: row[c] for c in ("user", "path", "seen_mtime", "seen_size", "to")} | {"action": "force" if row["action"] == "append" else row["action"], "data": data, "task": context.partitionId(), "place": place}
                todo.write((json.dumps(line) + "\n").encode())
                place += 1
            if stream is not None:
                stream.close()
        return _Listed(name)

    def commit(self, messages: list[_Listed | None]) -> None:
        """Marks the job as committed, with the lists of the tasks that count."""
        store, root = _opened(self.root)
        folder = f"{root}/{JOBS}/{self.job}"
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/committing") as out:
            out.write(json.dumps([m.name for m in messages if m]).encode())
        store.move(f"{folder}/committing", f"{folder}/committed")

    def abort(self, messages: list[_Listed | None]) -> None:
        store, root = _opened(self.root)
        store.delete_dir_contents(f"{root}/{JOBS}/{self.job}", missing_dir_ok=True)


class Workspace(DataSource):
    """Options: root; for reading: under (a folder below each user's), users (numbers, by comma), content (false: names only), partitions; for writing: job."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(user, path, mtime, size, content) of a workspace."""
    spark.dataSource.register(Workspace)
    return spark.read.format("workspace").options(root=root, **options).load()


def _applied(root: str, job: str):
    """Rows of a job's lists, in order, with what came of each."""

    def one(store: fs.FileSystem, base: str, row: dict) -> str:
        at = resolved(row["user"], row["path"])
        to = resolved(row["user"], row["to"]) if row["action"] == "move" else at
        if at is None or to is None:
            return "refused"
        target = f"{base}/{at}"
        info = store.get_file_info(target)
        there = info.type == fs.FileType.File
        if row["action"] in ("write", "force"):
            data = f"{base}/{JOBS}/{job}/{row['data']}"
            if store.get_file_info(data).type == fs.FileType.NotFound:
                return "written"  # before a restart
            if row["action"] == "write":
                seen = None if row["seen_mtime"] is None else (row["seen_mtime"], row["seen_size"])
                if seen != ((info.mtime_ns // 1_000_000, info.size) if there else None):
                    return "conflict"
            store.create_dir(posixpath.dirname(target))
            store.move(data, target)
            return "written"
        if row["action"] == "delete":
            if there:
                store.delete_file(target)
            return "deleted"
        moved = f"{base}/{to}"
        if not there:
            return "moved" if store.get_file_info(moved).type == fs.FileType.File else "missing"
        store.create_dir(posixpath.dirname(moved))
        store.move(target, moved)
        return "moved"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(root)
        for batch in batches:
            rows = batch.to_pylist()
            out = [{"user": r["user"], "path": r["path"], "action": r["action"], "result": one(store, base, r)} for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("user", "path", "action", "result")]))

    return run


def _finished(spark: SparkSession, root: str, job: str, phases: tuple[str, ...] = ("write", "move")) -> DataFrame:
    """Applies a committed job and removes its folder."""
    store, base = _opened(root)
    folder = f"{base}/{JOBS}/{job}"
    with store.open_input_stream(f"{folder}/committed") as stream:
        names = json.loads(stream.read())
    listed = spark.read.schema(f"{CHANGES.replace(', content string', '')}, data string, task int, place long").json([f"{root}/{JOBS}/{job}/{n}" for n in names]) if names else spark.createDataFrame([], f"{CHANGES.replace(', content string', '')}, data string, task int, place long")
    done = None
    for phase in phases:
        part = listed.where(F.col("action").isin("write", "force") if phase == "write" else ~F.col("action").isin("write", "force"))
        # One place's changes are one task's, in the order they were given.
        rows = staged(part.repartition("user", "path").sortWithinPartitions("user", "path", "task", "place").mapInArrow(_applied(root, job), RESULTS), "workspace")
        done = rows if done is None else done.unionByName(rows)
    if phases == ("write", "move"):
        removed(spark, f"{root}/{JOBS}/{job}")
    return done


def recovered(spark: SparkSession, root: str) -> list[str]:
    """Finishes the jobs that were committed but broke off while applied, removes those that never were; the names of the former."""
    store, base = _opened(root)
    with locked(spark, f"{root}/{JOBS}"):
        found = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/{JOBS}", allow_not_found=True)) if i.type == fs.FileType.Directory)
        whole = [j for j in found if store.get_file_info(f"{base}/{JOBS}/{j}/committed").type == fs.FileType.File]
        for job in found:
            if job in whole:
                _finished(spark, root, job)
            else:
                removed(spark, f"{root}/{JOBS}/{job}")
    return whole


def committed(changes: DataFrame, root: str) -> str:
    """Writes a job's changes and commits them; the job's name. They are applied by ``changed`` or ``recovered``."""
    changes.sparkSession.dataSource.register(Workspace)
    job = f"job-{uuid.uuid4().hex}"
    missing = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in CHANGES.split(", ")) if c not in changes.columns]
    names = [x.split(" ")[0] for x in CHANGES.split(", ")]
    changes.select("*", *missing).select(*names).write.format("workspace").mode("append").options(root=root, job=job).save()
    return job


def changed(changes: DataFrame, root: str) -> DataFrame:
    """(user, path, action, result) after changes (see CHANGES; columns that are absent are null): written, conflict, refused, moved, missing, deleted.

    A write onto another time or size than seen is a conflict and changes nothing, as is a new file where there
    is one; so of two writers of one baseline one wins. Rows of one job are taken by place, in the order of their task.
    """
    job = committed(changes, root)
    with locked(changes.sparkSession, f"{root}/{JOBS}"):
        return _finished(changes.sparkSession, root, job)


def monthly_archives(archives: DataFrame, month: str) -> DataFrame:
    """(user, folder, path, part): what a month's merge is made of, in path order within a user: each archive that isn't blank below its path.

    archives: (user, path, content). Only ``.md`` files of the month's folder count, without those below ``.raw`` or ``.trash``
    and without the merged file itself. A user's merge is the parts one after the other; no row holds more than one.
    """
    shown = month_archives(archives, month).where(F.col("content").rlike(r"\S"))
    return shown.select("user", F.lit(f"History/{month}").alias("folder"), "path", F.concat(F.lit(HEAD), "path", F.lit(HEAD_END), "content", F.lit(TEXT_END)).alias("part"))


def placed(parts: DataFrame) -> DataFrame:
    """(user, folder, path, digest, pos, start) of parts (see ``monthly_archives``): the part's number in its user's merge, and the bytes before it.

    Parts are dealt out in ranges of their order, whose totals alone meet, so a user's merge isn't one task's.
    """
    narrow = parts.select("user", "folder", "path", F.md5("part").alias("digest"), F.octet_length("part").cast("long").alias("size"))
    shares = staged(narrow.repartitionByRange("user", "path", "digest").withColumn("share", F.spark_partition_id()), "archive-parts")
    totals = shares.groupBy("user", "share").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("user").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)  # a row a share
    bases = totals.select("user", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("user", "share").orderBy("path", "digest")
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = shares.withColumns({"_pos": F.row_number().over(own) - 1, "_start": before})
    return within.join(bases, ["user", "share"]).select("user", "folder", "path", "digest", (F.col("first") + F.col("_pos")).alias("pos"), (F.col("base") + F.col("_start")).alias("start"))


def month_archives(archives: DataFrame, month: str) -> DataFrame:
    """The archives of a month that haven't been merged."""
    segments = F.split("path", "/")
    own = F.startswith(F.col("path"), F.lit(f"History/{month}/")) & F.endswith(F.col("path"), F.lit(".md")) & ~F.endswith(F.col("path"), F.lit(f"/{MERGED}"))
    return archives.where(own & ~F.array_contains(segments, RAW) & ~F.array_contains(segments, TRASH))


def merge_changes(archives: DataFrame, month: str) -> DataFrame:
    """The changes that a month's merge makes: each user's merged file, written part by part, and the move of the archives to ``.raw``. Users whose archives are all blank have none."""
    own = staged(month_archives(archives, month).select("user", "path", "content"), "archives")
    users = own.where(F.col("content").rlike(r"\S")).select("user").distinct()
    parts = monthly_archives(own, month).select("user", F.concat("folder", F.lit(f"/{MERGED}")).alias("path"), F.lit("append").alias("action"), F.col("part").alias("content"), F.lit(None).cast("string").alias("to"), F.col("path").alias("_order"))
    to = F.concat(F.lit(f"History/{month}/{RAW}/"), F.element_at(F.split("path", "/"), -1))
    moves = own.join(users, "user", "left_semi").select("user", "path", F.lit("move").alias("action"), F.lit(None).cast("string").alias("content"), to.alias("to"), F.col("path").alias("_order"))
    return parts.unionByName(moves).repartition("user").sortWithinPartitions("user", "action", "_order").drop("_order")


def merge_month(spark: SparkSession, root: str, month: str) -> DataFrame:
    """The job of the week: what broke off before is finished, then the month's new archives of every user become its merged file and move to ``.raw``. A second run finds nothing to do."""
    recovered(spark, root)
    return changed(merge_changes(files(spark, root, under=f"History/{month}"), month), root)
