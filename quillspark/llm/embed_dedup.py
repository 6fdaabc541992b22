"""Near-duplicate vectors by an epsilon grid order join.

Two unit vectors of cosine t are sqrt(2 - 2 t) apart, and no projection makes them farther. Unit
vectors are projected on their leading principal directions, put in the lexicographic order of the
grid cells of that width there, and cut into blocks. A pair of blocks whose bounding boxes are
farther apart is never compared; one that may hold links is joined by halving both sequences,
skipping intervals that are provably distant, down to leaves that are compared exactly.

A block is an eighth of all vectors, or as many as fill TILE_BYTES if that is less: up to eight
times TILE_BYTES of vectors what is sent to tasks grows with the vectors alone, beyond with the
number of block pairs within reach. Blocks travel in runs of RUN vectors, so no row is large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .graph import connected_components, local_roots

COSINE = 0.95
DIRECTIONS = 16
#: Blocks that all vectors are cut into at least, and bytes of vectors in a block at most.
BLOCKS, TILE_BYTES = 8, 16 << 20
#: Vectors in a row that is sent, and in an interval that is compared without further halving.
RUN, LEAF = 1024, 512


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, high, low, vector): high and low are the 128 bits of a hash of the vector's values, null where it links with nothing."""
    for batch in batches:
        ids, vectors = [], []
        for v in batch.column(1).to_pylist():
            x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
            good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            ids.append(np.frombuffer(hashlib.md5(x.tobytes()).digest(), dtype="<i8").tolist() if good else (None, None))
            vectors.append(x if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "high", "low", "vector"])


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                u = np.hstack([_units(rows), np.ones((len(rows), 1))])
                total += u.T @ u
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def principal_directions(vectors: DataFrame, dims: int, count: int = DIRECTIONS) -> np.ndarray:
    """dims x count orthonormal columns, of the covariance of all unit vectors; it has dims squared numbers whatever the rows."""
    sums = vectors.where(F.size("vector") == dims).select("vector").mapInArrow(_moments(dims), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dims + 1, dims + 1))
    for r in sums:
        m[r["i"], r["j"]] = r["s"]
    n = max(m[dims, dims], 1.0)
    mean = m[:dims, dims] / n
    return np.linalg.eigh(m[:dims, :dims] / n - np.outer(mean, mean))[1][:, ::-1][:, : min(count, dims)]


def _celled(directions: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            cells = np.floor(_units(rows) @ directions / width).astype(np.int32) if rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def _cut(directions: np.ndarray):
    """Runs of rows in grid order, with their bounding boxes on the principal directions."""

    def block(ids: list, copies: list, rows: list, number: int) -> pa.RecordBatch:
        at = _units(rows) @ directions
        first = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first]), pa.array([len(ids)]), pa.array([at.min(axis=0)], pa.list_(pa.float64())), pa.array([at.max(axis=0)], pa.list_(pa.float64())),
                *(pa.array([np.array(x, dtype=t).tobytes()], pa.binary()) for x, t in ((ids, np.int64), (copies, np.int64), (rows, np.float64))),
            ],
            names=["run", "size", "low", "high", "ids", "copies", "rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, rows, number = [], [], [], 0
        for batch in batches:
            ids += batch.column("id").to_pylist()
            copies += batch.column("n").to_pylist()
            rows += batch.column("vector").to_pylist()
            while len(ids) >= RUN:
                yield block(ids[:RUN], copies[:RUN], rows[:RUN], number)
                ids, copies, rows, number = ids[RUN:], copies[RUN:], rows[RUN:], number + 1
        if ids:
            yield block(ids, copies, rows, number)

    return run


def _numbered(runs: DataFrame, size: int) -> DataFrame:
    """(run, block): neighbouring runs put together until a block has about ``size`` rows, so that the number of blocks follows the rows and not the tasks."""
    # One window over narrow rows: one for each task and RUN vectors.
    return runs.select("run", F.expr(f"coalesce(sum(size) over (order by run rows between unbounded preceding and 1 preceding), 0) div {size}").alias("block"))


def _boxes(runs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(block, low, high): the bounding box of each block's runs."""
    parts = runs.select("run", "low", "high").join(numbers, "run").groupBy("block").agg(F.collect_list(F.struct("low", "high")).alias("p"))
    side = lambda name, pick: f"aggregate(slice(p.{name}, 2, size(p)), p.{name}[0], (a, b) -> zip_with(a, b, (x, y) -> {pick}(x, y)))"
    return parts.select("block", F.expr(side("low", "least")).alias("low"), F.expr(side("high", "greatest")).alias("high"))


class _Join:
    """Links between two blocks (or within one), found by halving both."""

    def __init__(self, directions: np.ndarray, cosine: float, a: tuple, b: tuple, same: bool, leaf: int = LEAF):
        dims = directions.shape[0]
        self.cosine, self.reach, self.same, self.leaf, self.compared = cosine, 2 - 2 * cosine + 1e-9, same, leaf, 0
        self.ids, self.copies = ([np.frombuffer(x[i], dtype=np.int64) for x in (a, b)] for i in (0, 1))
        self.raw = [np.frombuffer(x[2], dtype=np.float64).reshape(-1, dims) for x in (a, b)]
        self.unit = [_units(x) for x in self.raw]
        self.at = [u @ directions for u in self.unit]
        self.links = [np.zeros(len(x), dtype=np.int64) for x in self.ids]
        self.forest: list[tuple[np.ndarray, np.ndarray]] = []
        self.visit(0, len(self.ids[0]), 0, len(self.ids[1]))

    def visit(self, a: int, b: int, c: int, d: int) -> None:
        if self.same and c >= b and a >= d or self.same and d <= a:
            return  # the mirror image is visited
        x, y = self.at[0][a:b], self.at[1][c:d]
        gap = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
        if (gap * gap).sum() > self.reach:
            return
        if b - a <= self.leaf and d - c <= self.leaf:
            return self.compare(a, b, c, d)
        firsts = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > self.leaf else [(a, b)]
        seconds = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > self.leaf else [(c, d)]
        for f in firsts:
            for s in seconds:
                self.visit(*f, *s)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        self.compared += (b - a) * (d - c)
        dots = self.unit[0][a:b] @ self.unit[1][c:d].T
        linked = dots >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(dots - self.cosine) < 1e-12), strict=True):  # too close to call by sums in any order
            x, y = self.raw[0][a + i], self.raw[1][c + j]
            linked[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= self.cosine
        if self.same:
            linked &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        i, j = np.nonzero(linked)
        if len(i):
            np.add.at(self.links[0], a + i, self.copies[1][c + j])
            np.add.at(self.links[0 if self.same else 1], c + j, self.copies[0][a + i])
            nodes, roots = local_roots(self.ids[0][a + i], self.ids[1][c + j])
            self.forest.append((nodes, roots))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, root) of what has links here."""
        if not self.forest:
            return (np.zeros(0, dtype=np.int64),) * 3
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*self.forest, strict=True)))
        ids = np.concatenate(self.ids[:1] if self.same else self.ids)
        links = np.concatenate(self.links[:1] if self.same else self.links)
        has = links > 0
        return ids[has], links[has], roots[np.searchsorted(nodes, ids[has])]


def _joined(directions: np.ndarray, cosine: float, leaf: int):
    """Links of each tile, from rows (tile, side, run, ids, copies, rows) sorted by tile and side; side 1 is empty where a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def solve() -> pa.RecordBatch:
            sides = [tuple(b"".join(r[i] for r in side) for i in range(3)) for side in held if side]
            found = _Join(directions, cosine, sides[0], sides[-1], len(sides) == 1, leaf).result()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "links", "root"])

        for batch in batches:
            for i, (tile, side) in enumerate(zip(batch.column("tile").to_pylist(), batch.column("side").to_pylist(), strict=True)):
                if tile != now:
                    if now is not None:
                        yield solve()
                    now, held = tile, ([], [])
                held[side].append([batch.column(c)[i].as_py() for c in ("ids", "copies", "rows")])
        if now is not None:
            yield solve()

    return run


def _block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """(block, block_b), block <= block_b, whose boxes are within reach; met by the cells of the first direction that they span."""
    width = math.sqrt(2 - 2 * cosine)
    box = blocks.select("block", "low", "high", F.floor(F.element_at("low", 1) / width).alias("from"), F.floor(F.element_at("high", 1) / width).alias("to"))
    own = box.select("block", "low", "high", F.explode(F.sequence("from", "to")).alias("cell"))
    near = box.select(F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell"))
    gap = "aggregate(zip_with(zip_with(low, high_b, (x, y) -> greatest(x - y, 0D)), zip_with(low_b, high, (x, y) -> greatest(x - y, 0D)), (x, y) -> greatest(x, y)), 0D, (s, g) -> s + g * g)"
    return own.join(near, "cell").where(F.col("block") <= F.col("block_b")).where(F.expr(gap) <= 2 - 2 * cosine + 1e-9).select("block", "block_b").distinct()


def embedding_components(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS, leaf: int = LEAF) -> DataFrame:
    """One row for each row of vectors: key, n_links, component.

    Rows link at a cosine of at least ``cosine``; vectors that are null, empty or zero, or hold null
    or non-finite components link with nothing, nor do vectors of different lengths with each other.
    n_links counts other rows; equal vectors are joined once and counted as often as they occur.
    component is the smallest key reachable, null for components of null keys only. Other columns are ignored.
    """
    rows = staged(vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("vector")).mapInArrow(_valid, "key long, high long, low long, vector array<double>"), "vectors")
    # A number for each distinct vector; written once, so it stays.
    kinds = staged(rows.where("high is not null").groupBy("high", "low").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("id", F.monotonically_increasing_id()), "vector-kinds")
    found = None
    for dims in sorted(r[0] for r in kinds.select(F.size("vector")).distinct().collect()):
        part = kinds.where(F.size("vector") == dims)
        directions = principal_directions(part, dims)
        celled = staged(part.select("id", "n", "vector").mapInArrow(_celled(directions, math.sqrt(2 - 2 * cosine)), "id long, n long, vector array<double>, cells array<int>"), "vector-cells")
        rows_a_block = max(leaf, min(-(-celled.count() // blocks), TILE_BYTES // (8 * dims)))
        tasks = max(1, -(-celled.count() // (4 * rows_a_block)))
        ordered = celled.repartitionByRange(tasks, "cells", "id").sortWithinPartitions("cells", "id").select("id", "n", "vector")
        runs = staged(ordered.mapInArrow(_cut(directions), "run long, size long, low array<double>, high array<double>, ids binary, copies binary, rows binary"), "vector-runs")
        numbers = staged(_numbered(runs, rows_a_block), "vector-blocks")
        pairs = _block_pairs(staged(_boxes(runs, numbers), "vector-boxes"), cosine)
        tiles = staged(pairs.withColumn("tile", F.concat_ws(",", "block", "block_b")), "vector-tiles")
        sides = tiles.select("tile", "block", F.lit(0).alias("side")).unionAll(tiles.where("block <> block_b").select("tile", F.col("block_b").alias("block"), F.lit(1).alias("side")))
        # What is joined to the runs is narrow; each run goes once to each tile of its block.
        body = runs.select("run", "ids", "copies", "rows").join(numbers.join(sides, "block").select("run", "tile", "side"), "run")
        sent = body.repartition(max(1, tiles.count()), "tile").sortWithinPartitions("tile", "side", "run").select("tile", "side", "ids", "copies", "rows")
        links = sent.mapInArrow(_joined(directions, cosine, leaf), "id long, links long, root long")
        found = links if found is None else found.unionAll(links)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    found = staged(found, "vector-links")
    roots = connected_components(found, "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = kinds.select("id", "high", "low", "least", "n").join(links, "id", "left").join(roots, kinds["id"] == roots["node"], "left").select("high", "low", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", kinds["id"]).alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component")), "root").select("high", "low", "n_links", "component")
    return rows.join(named, ["high", "low"], "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("high").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
