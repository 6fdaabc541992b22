"""Reachability by pointer doubling over staged tables: neither rows nor levels are capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import staged


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, id, depth): what each start (id) reaches over edges (id, to), itself at depth 0, one row for each way.

    The pairs at a distance of 2 ** k are those at 2 ** (k - 1) joined to themselves, so the rounds
    are the logarithm of the depth. ValueError if the edges hold a cycle.
    """
    jumps = [staged(edges.where("id is not null and to is not null").select("id", "to"), "reach")]
    limit = jumps[0].count()
    while not jumps[-1].isEmpty():
        if 2 ** (len(jumps) - 1) > limit:
            raise ValueError("the tree holds a cycle")
        last = jumps[-1]
        jumps.append(staged(last.alias("a").join(last.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"), "reach"))
    found = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    for k, jump in enumerate(jumps[:-1]):
        found = staged(found, "reach")
        further = found.alias("f").join(jump.alias("j"), F.col("f.id") == F.col("j.id"))
        found = found.union(further.select("f.start", F.col("j.to").alias("id"), (F.col("depth") + 2**k).alias("depth")))
    return found
