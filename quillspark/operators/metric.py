"""Exact nearest vectors for many queries, by metric partitions.

Unit vectors are dealt to the nearest of some pivots, and each partition knows between which distances from its
pivot its vectors lie. By the triangle inequality no vector of a partition is nearer to a query than the query's distance
from the pivot leaves room for. A first round visits a query's nearest partitions until they hold n vectors, which
fixes an n-th score; a second round visits those partitions alone that may hold a better one. Queries
travel to partitions by a shuffle; a large partition is cut into slices that each get the queries, so a task
holds one slice's vectors and reads the queries as a stream. The driver sees the pivots and a row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import staged

#: Pivots at most; about the square root of the vectors are taken, those of the smallest hashed ids.
PIVOTS = 1024
#: Vectors of a partition that a task holds at once, and queries that are compared with them at once.
SLICE, QUERIES = 65_536, 256
#: What rounding scores to six places and sums in doubles may hide.
ROUNDING = 2e-6


def _rows(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of rows (id, vector) whose vector has ``dims`` finite components, not all zero."""
    rows = [(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if k is not None and v and len(v) == dims and None not in v]
    x = np.array([v for _, v in rows], dtype=np.float64).reshape(-1, dims)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.array([k for k, _ in rows], dtype=np.int64)[good], x[good] / norm[good, None]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (unit @ pivots.T), 0))


SENT = pa.schema([("pivot", pa.int32()), ("slice", pa.int32()), ("query", pa.bool_()), ("id", pa.int64()), ("unit", pa.binary()), ("least", pa.float64())])
_SENT = "pivot int, slice int, query boolean, id long, unit binary, least double"


def _placed(pivots: np.ndarray):
    """(id, unit, pivot, far): each vector with its nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                ids, unit = _rows(whole.slice(at, 1024), pivots.shape[1])
                far = _distances(unit, pivots)
                near = far.argmin(axis=1) if len(ids) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(ids)), near])], names=["id", "unit", "pivot", "far"])

    return run


def _visits(pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray, counts: np.ndarray, n: int, second: bool):
    """Rows for the partitions that queries (id, vector, least) visit: at first the nearest ones that hold n vectors, then the others that may hold one of at least the score ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, unit = _rows(batch, pivots.shape[1])
                least = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                out: list[dict] = []
                for key, u, far in zip(ids.tolist(), unit, _distances(unit, pivots), strict=True):
                    bound = np.maximum(np.maximum(far - outer, inner - far), 0)
                    order = np.argsort(bound + far * 1e-6, kind="stable")
                    first = order[: int(np.searchsorted(np.cumsum(counts[order]), n)) + 1]
                    low = least[key]
                    if second:
                        reach = 4.0 if low is None else np.sqrt(max(2 - 2 * (low - ROUNDING), 0)) + 1e-9
                        chosen = np.setdiff1d(np.flatnonzero(bound <= reach), first)
                    else:
                        chosen = first
                    out += [{"pivot": int(p), "slice": s, "query": True, "id": key, "unit": u.tobytes(), "least": low} for p in chosen if counts[p] for s in range(-(-int(counts[p]) // SLICE))]
                yield pa.RecordBatch.from_pylist(out, schema=SENT)

    return run


FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _best(dims: int, n: int):
    """Each query's n best of a slice, from rows sorted by slice, vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, asked = None, [], [], []
        x = keys = None

        def answered() -> pa.RecordBatch:
            scores = np.round(np.frombuffer(b"".join(u for _, u, _ in asked)).reshape(-1, dims) @ x.T, 6)
            out: list[tuple] = []
            for (query, _, least), score in zip(asked, scores, strict=True):
                floor = -np.inf if len(score) <= n else np.partition(score, len(score) - n)[len(score) - n]
                at = np.flatnonzero(score >= (floor if least is None else max(floor, least)))
                at = at[np.lexsort((keys[at], -score[at]))][:n]
                out += [(query, k, s) for k, s in zip(keys[at].tolist(), score[at].tolist(), strict=True)]
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, FOUND.types, strict=True)], schema=FOUND)

        for batch in batches:
            for pivot, part, query, key, unit, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, part) != now:
                    if asked:
                        yield answered()
                    now, ids, held, x = (pivot, part), [], [], None
                if not query:
                    ids.append(key)
                    held.append(unit)
                elif ids:
                    if x is None:
                        x, keys = np.frombuffer(b"".join(held)).reshape(-1, dims), np.array(ids, dtype=np.int64)
                        held = []
                    asked.append((key, unit, least))
                    if len(asked) == QUERIES:
                        yield answered()
        if asked:
            yield answered()

    return run


def recall(vectors: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((query, id, score), (pivot, vectors, queries)): for each query its n vectors of highest cosine, rounded to six places, ties by id; and how many queries visited each partition.

    Vectors and queries that are null, zero, hold null or non-finite components, have no key, or are of another length than the longest query
    score nothing. Queries that repeat a key are one query if they are equal.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    asked = staged(plain(queries).where("id is not null and size(vector) > 0").distinct(), "queries")
    dims = asked.select(F.max(F.size("vector"))).first()[0]
    empty = spark.createDataFrame([], "query long, id long, score double"), spark.createDataFrame([], "pivot int, vectors long, queries long")
    if not dims:
        return empty
    fit = plain(vectors).where(F.size("vector") == dims)
    count = int(fit.count() ** 0.5) + 1
    # Ordered by hash, so that they are drawn alike whatever the order of the rows.
    drawn = fit.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, count)).select("id", "vector").toArrow()
    pivots = np.concatenate([_rows(b, dims)[1] for b in drawn.to_batches()] or [np.zeros((0, dims))])
    if not len(pivots):
        return empty
    placed = staged(fit.mapInArrow(_placed(pivots), "id long, unit binary, pivot int, far double"), "metric-vectors")
    inner, outer, counts = np.full(len(pivots), np.inf), np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for r in placed.groupBy("pivot").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count("*").alias("n")).collect():  # one row a pivot
        inner[r["pivot"]], outer[r["pivot"]], counts[r["pivot"]] = r["inner"] - 1e-9, r["outer"] + 1e-9, r["n"]
    outer[counts == 0], inner[counts == 0] = -np.inf, np.inf
    slices = F.element_at(F.array(*(F.lit(max(1, -(-int(c) // SLICE))) for c in counts)), F.col("pivot") + 1)
    cut = placed.select("pivot", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"), F.lit(False).alias("query"), "id", "unit", F.lit(None).cast("double").alias("least"))

    def visited(visits: DataFrame) -> DataFrame:
        wanted = [r["pivot"] for r in visits.select("pivot").distinct().collect()]  # of PIVOTS at most
        both = cut.where(F.col("pivot").isin(wanted)).unionByName(visits)
        return both.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice", "query").mapInArrow(_best(dims, n), "query long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))  # each task keeps n of a query
        return found.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")

    rounds = lambda rows, second: staged(rows.select("id", "vector", "least").mapInArrow(_visits(pivots, inner, outer, counts, n, second), _SENT), "visits")
    early = rounds(asked.withColumn("least", F.lit(None).cast("double")), False)
    first = staged(best(visited(early)), "metric-first")
    known = first.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") >= n, F.min("score")).alias("least"))
    late = rounds(asked.join(known, "id", "left"), True)
    found = best(first.unionByName(visited(late)))
    work = early.unionByName(late).where("slice = 0").groupBy("pivot").agg(F.count("*").alias("queries"))
    sizes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(counts)], "pivot int, vectors long")
    return found, sizes.join(work, "pivot", "left").select("pivot", "vectors", F.coalesce("queries", F.lit(0)).alias("queries"))
