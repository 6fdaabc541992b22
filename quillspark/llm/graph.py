"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and, for each, the smallest node of its component among these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        far = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(roots[far], pa.int64())], names=["v", "m"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the edges that isn't its component's smallest; root is that smallest node.

    edges: two columns of longs without nulls; direction, repeats and loops don't matter. Each round
    costs two shuffles of the edge table, which shrinks to one star a component; the number of
    rounds grows with the logarithm of the largest component's diameter. An empty table gives an empty one.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = staged(pairs.mapInArrow(_forest, "v long, m long").distinct(), "cc")

    def measure(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    seen = measure(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        down = large.where("v <> m").distinct()
        low = down.groupBy("v").agg(F.min("m").alias("least"))
        small = down.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e")).select("e.*")
        now = staged(small.where("v <> m").distinct(), "cc")
        then, seen = seen, measure(now)
        if then == seen:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
