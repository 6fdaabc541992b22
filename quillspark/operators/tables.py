"""Mutations of tables as DataFrame rewrites: what a row store does in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def updated(df: DataFrame, where: Column, **new: Column) -> DataFrame:
    """Rows that meet the guard take the new values; a null guard counts as unmet."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def deleted(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti").select(*df.columns)


def cascade(parents: DataFrame, children: list[tuple[DataFrame, str]], keys: DataFrame, on: str) -> tuple[DataFrame, ...]:
    """Parents and their children without the given keys."""
    return deleted(parents, keys, on), *(deleted(c, keys.withColumnRenamed(on, name), name) for c, name in children)


def upserted(df: DataFrame, rows: DataFrame, on: list[str], overwrite: bool) -> DataFrame:
    """Rows of new keys are added; those of known keys replace the old ones, or are left out."""
    new = rows if overwrite else rows.join(df.select(*on).distinct(), on, "left_anti")
    old = df.join(rows.select(*on).distinct(), on, "left_anti") if overwrite else df
    return old.unionByName(new)


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values, or one of them where a list is given. A value that is None or empty asks nothing."""
    for name, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(*value))
        elif value is not None and value != "":
            df = df.where(F.col(name) == value)
    return df


def ordered(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order; with a limit Spark keeps only the first rows of each task."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def inserted(df: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """df with rows added, their keys counting on from the highest one in the order of a column; columns they lack are null."""
    last = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_last"))  # one row
    number = F.row_number().over(Window.orderBy(order))  # over the new rows only: one statement's values
    new = rows.crossJoin(F.broadcast(last)).withColumn(key, F.col("_last") + number).drop("_last")
    return appended(df, new)


def removed_where(df: DataFrame, where: Column) -> DataFrame:
    """Rows that don't meet the condition; a null condition keeps its row."""
    return df.where(~F.coalesce(where, F.lit(False)))


def guarded_writes(files: DataFrame, writes: DataFrame) -> DataFrame:
    """files (path, mtime, size, content, ...) after writes (path, seen_mtime, seen_size, new), with ``result``: a row for each row of files.

    A path that leaves its folder, or a null one, is refused; a write whose time and size aren't the file's is stale and changes nothing; null without a write.
    A time or size that isn't known is equal to itself alone. Of several writes of one path that saw the file as it is, the one of the smallest content counts.
    """
    aimed = writes.select(F.col("path").alias("_p")).distinct().withColumn("_aimed", F.lit(True))
    seen = writes.groupBy(F.col("path").alias("_path"), "seen_mtime", "seen_size").agg(F.min(F.struct("new")).alias("_write"))
    fresh = F.col("path").eqNullSafe(F.col("_path")) & F.col("mtime").eqNullSafe(F.col("seen_mtime")) & F.col("size").eqNullSafe(F.col("seen_size"))
    joined = files.join(aimed, F.col("path").eqNullSafe(F.col("_p")), "left").join(seen, fresh, "left")
    outside = F.coalesce(F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.startswith(F.col("path"), F.lit("/")), F.lit(True))
    result = F.when(F.col("_aimed"), F.when(outside, "refused").when(F.col("_write").isNotNull(), "written").otherwise("stale"))
    return joined.withColumn("result", result).withColumn("content", F.when(F.col("result") == "written", F.col("_write.new")).otherwise(F.col("content"))).select(*files.columns, "result")
