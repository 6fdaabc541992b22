"""Readers of the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a message tree: (conv_id, id, parent_id, turn, type, text). Later turns branch off turn 1; system rows are summaries."""
    parent = F.when(F.col("turn") == 0, None).when((F.col("turn") >= 4) & (F.col("turn") % 4 == 0), F.col("conv_id") * 1000 + 1).otherwise(F.col("conv_id") * 1000 + F.col("turn") - 1)
    kind = F.when(F.col("role") == "system", "summary").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), parent.cast("long").alias("parent_id"), "turn", kind.alias("type"), "text")
