"""Durable intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what the session was given by setCheckpointDir.

    Where neither is set, a session that runs in one process (tests) gets a temporary folder, removed at its end; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_kept = threading.local()


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for made in getattr(_kept, "scopes", ()):
        made.append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads; nothing happens where there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: Seconds after which a lock counts as left behind.
LEASE_SECONDS = 3600


@contextmanager
def locked(spark: SparkSession, folder: str) -> Iterator[None]:
    """Holds a folder's lock, a file that is created only where there is none. RuntimeError if another job has it, unless for longer than LEASE_SECONDS."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lock")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.createNewFile(path):
        if time.time() - store.getFileStatus(path).getModificationTime() / 1000 < LEASE_SECONDS:
            raise RuntimeError(f"another job changes {folder}")
        store.delete(path, False)
        if not store.createNewFile(path):
            raise RuntimeError(f"another job changes {folder}")
    try:
        yield
    finally:
        store.delete(path, False)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables that this thread makes inside are removed at its end, but for those taken off the list. Nothing that still reads them may be left."""
    scopes = _kept.__dict__.setdefault("scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.remove(made)
        for path in made:
            removed(spark, path)


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and a lost executor loses nothing."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
