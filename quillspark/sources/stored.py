"""Tables that mutations write to: Parquet partitioned by a bucket of the key, of which a change rewrites only the buckets it touches.

A change first writes the new contents of its buckets beside the table, then an intent that names them, then
overwrites those partitions (dynamic partition overwrite) and counts the version up. Up to the intent nothing
has changed; from then on ``Stored.recovered`` finishes the change however often it broke off. A lock keeps
writers apart, and a writer that names the version it has read fails if another has been faster.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillspark.sources.scratch import locked, removed

BUCKETS = 64


class StaleVersion(RuntimeError):
    """The table has changed since the version that the change was made for."""


class Stored:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = json.loads(self._text("_table"))

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Stored:
        """Writes df as a table at version 0. Rows of one key share a bucket; so do those of null keys."""
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        df.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
        spark = df.sparkSession
        _written(spark, f"{path}/_table", json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()}))
        _written(spark, f"{path}/_version", "0")
        return cls(spark, path)

    def _text(self, name: str) -> str | None:
        return _read(self.spark, f"{self.path}/{name}")

    @property
    def version(self) -> int:
        return int(self._text("_version"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.meta["key"]), F.lit(self.meta["buckets"])).cast("int")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.meta["schema"]).add("_bucket", IntegerType())).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """The rows as they are; a change that broke off is finished first."""
        if self._text("_intent"):
            with locked(self.spark, self.path):
                self.recovered()
        return self._rows().drop("_bucket")

    def _changed(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], expected: int | None) -> int:
        """Rewrites the buckets of touched (_bucket) by change; the new version, or the old one where nothing is touched."""
        with locked(self.spark, self.path):
            self.recovered()
            version = self.version
            if expected is not None and expected != version:
                raise StaleVersion(f"{self.path} is at version {version}, not {expected}")
            buckets = sorted(r[0] for r in touched.select("_bucket").distinct().collect())  # as many as there are buckets at most
            if not buckets:
                return version
            pending = f"_pending-{version + 1}"
            removed(self.spark, f"{self.path}/{pending}")
            new = change(self._rows().where(F.col("_bucket").isin(buckets)).drop("_bucket")).withColumn("_bucket", self._bucket())
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{pending}")
            _written(self.spark, f"{self.path}/_intent", json.dumps({"version": version + 1, "pending": pending, "buckets": buckets}))
            self.recovered()
            return version + 1

    def recovered(self) -> None:
        """Finishes a change whose intent was written; again does no harm."""
        intent = self._text("_intent")
        if not intent:
            return
        todo = json.loads(intent)
        if self.version < todo["version"]:
            rows = self.spark.read.schema(self._rows().schema).parquet(f"{self.path}/{todo['pending']}")
            left = {r[0] for r in rows.select("_bucket").distinct().collect()}
            rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
            for empty in set(todo["buckets"]) - left:
                removed(self.spark, f"{self.path}/rows/_bucket={empty}")
            _written(self.spark, f"{self.path}/_version", str(todo["version"]))
        removed(self.spark, f"{self.path}/{todo['pending']}")
        removed(self.spark, f"{self.path}/_intent")

    def update(self, where: Column, new: dict[str, Column], expected: int | None = None) -> int:
        """Rows that meet the condition take new values; a null condition counts as unmet. Only the condition's columns are read of buckets that have no such row. The key stays."""
        if self.meta["key"] in new:
            raise ValueError("a row's key can't be changed")
        change = lambda rows: rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})
        return self._changed(self._rows().where(where), change, expected)

    def delete(self, where: Column, expected: int | None = None) -> int:
        """Rows that meet the condition go; a null condition keeps its row."""
        return self._changed(self._rows().where(where), lambda rows: rows.where(~F.coalesce(where, F.lit(False))), expected)

    def delete_keys(self, keys: DataFrame, on: str, expected: int | None = None) -> int:
        """Rows whose column ``on`` is among those of keys go."""
        gone = keys.select(on).where(F.col(on).isNotNull()).distinct()
        return self._changed(self._rows().join(gone, on, "left_semi"), lambda rows: rows.join(gone, on, "left_anti").select(*rows.columns), expected)

    def insert(self, rows: DataFrame, replace: bool = False, expected: int | None = None) -> int:
        """Adds rows by name, columns they lack being null; with ``replace`` those of known keys take the old ones' place."""
        key = self.meta["key"]
        known = self._rows().drop("_bucket")
        whole = known.limit(0).unionByName(rows, allowMissingColumns=True).select(*known.columns)
        keys = whole.select(key).distinct()
        kept = (lambda old: old.join(keys, key, "left_anti").select(*old.columns)) if replace else (lambda old: old)
        return self._changed(whole.select(self._bucket().alias("_bucket")), lambda old: kept(old).unionByName(whole), expected)

    def append_numbered(self, rows: DataFrame, order: str) -> int:
        """Adds rows without keys; theirs count on from the highest one, in the order of a column (the rows of one statement)."""
        last = self._rows().agg(F.coalesce(F.max(self.meta["key"]), F.lit(0)).cast("long").alias("_last"))  # one row
        number = F.col("_last") + F.row_number().over(Window.orderBy(order))
        known = self._rows().columns
        return self.insert(rows.crossJoin(F.broadcast(last)).withColumn(self.meta["key"], number).select(*(c for c in [*rows.columns, self.meta["key"]] if c in known)))


def cascade(parents: Stored, children: list[tuple[Stored, str]], where: Column) -> None:
    """Deletes parents that meet a condition, after their children, so that no child is ever left without its parent if the job breaks off; running it again finishes it."""
    keys = parents.read().where(where).select(parents.meta["key"])
    for child, column in children:
        child.delete_keys(keys.withColumnRenamed(parents.meta["key"], column), column)
    parents.delete(where)


def _written(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by a rename."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.tmp")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(target, False)
    store.rename(part, target)


def _read(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none. One that was being put in place is looked for under both names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in (path, f"{path}.tmp"):
        found = hadoop.Path(name)
        store = found.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(found):
            stream = store.open(found)
            try:
                return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
    return None
