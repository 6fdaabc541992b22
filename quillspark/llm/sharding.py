"""Proportional stratified interleaving: shards that all hold the sources in the corpus's own mixture.

Rows of each source are put in a seeded random order; a row of rank r among the n of its source
gets the fraction (r - 0.5) / n. Sorting all rows by fraction interleaves the sources in
proportion, so that any contiguous cut holds the mixture; the cut into shards of equal row
counts follows. No window ever spans a source or the corpus: ranks are counted inside buckets
of the order and shifted by the counts of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tagged

ROWS_A_BUCKET = 100_000


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """Adds _rank (from 1) and _of, within group, by (bucket, order)."""
    sizes = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*group) if group else Window.partitionBy()
    sums = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_of": F.sum("_n").over(within)}).drop("_n")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    return numbered.join(sums, [*group, bucket]).withColumn("_rank", F.col("_i") + F.col("_before")).drop("_i", "_before")


def interleave(df: DataFrame, shards: int, stratum: str, key: str, seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``shard`` (0 to shards - 1, row counts at most one apart) and ``slot`` (from 0, without gaps, in a shard).

    stratum: column whose mixture every shard repeats; null is a stratum of its own. key: what the
    seeded order hashes, with the columns in ties, so that rows without a key or of one key are spread too; rows equal in
    all of these are interchangeable. Copies of a text get no place of their own: rows are the
    unit, so a group of copies is spread in proportion like its source. An empty table gives an
    empty one. The rows are staged twice, so project wide columns away first.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *ties)))).alias("_h")
    rows = staged(df.select("*", tagged(stratum).alias("_s"), hashed), "shard-rows")
    total = rows.count()
    buckets = max(16, -(-total // ROWS_A_BUCKET))
    lead = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    order = [F.col("_h"), *(F.col(t) for t in ties)]
    first = _ranked(rows.withColumn("_b", F.shiftright(lead * F.lit(buckets), 32)), ["_s"], "_b", order)
    spread = staged(first.withColumn("_f", (F.col("_rank") - F.lit(0.5)) / F.col("_of")).drop("_b", "_rank", "_of"), "shard-spread")
    cut = _ranked(spread.withColumn("_b", F.floor(F.col("_f") * buckets)), [], "_b", [F.col("_f"), F.col("_s"), *order])
    at = F.col("_rank") - 1
    shard = F.expr(f"((_rank - 1) * {shards}L) div _of")
    return cut.withColumn("shard", shard.cast("int")).withColumn("slot", at - F.expr(f"(shard * _of + {shards - 1}L) div {shards}L")).drop("_rank", "_of", "_b", "_f", "_s", "_h")


def write_shards(df: DataFrame, path: str) -> None:
    """Write interleaved rows as one folder a shard, each in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
