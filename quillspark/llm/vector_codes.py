"""Compression of vectors to codes: product codebooks fitted by Lloyd's rounds with heaps.

A vector's components become integers; it is cut into PARTS pieces, each coded by the nearest entry of
its position's codebook. Rounds of assigning and averaging move the entries. A piece knows bounds: the
distance to its entry (upper) and to the next best (lower). Entries move, so the upper bound may rise by
its entry's own movement and the lower fall by the largest movement of any other; what an entry has so
lost in all rounds is its cumulative drift. Each block of vectors keeps a heap per entry of its pieces,
keyed by lower less upper plus the drift when they came, so those that may have got nearer to another
entry are at the top: they are popped while the key is within the drift, and only these are compared with
all entries again, exactly, in integers.

Blocks and their heaps are rows of a table in the shared folder, one table a round; the tables before are
removed as soon as the next is written. What moves to the driver is the sums of what changed, for each
entry and component, so a codebook's size whatever the vectors.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, scratch_path, slices, staged, tagged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors and bytes of integers in a block at most. Neither changes a result.
BLOCK, BLOCK_BYTES = 8192, 4 << 20
#: Rows whose distances to all entries are held at once.
STEP = 4096
#: Bits of a limb in which sums are carried, so that they are exact whatever their size.
LIMB = 40
_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.string())), *((c, pa.binary()) for c in ("values", "assigned", "keys", "rows", "sizes", "delta")), ("rescanned", pa.int64())])
STATE = "ids array<long>, tags array<string>, values binary, assigned binary, keys binary, rows binary, sizes binary, delta binary, rescanned long"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as the narrowest integers that hold them, or as Python's own."""
    scaled = np.floor(x * SCALE) if len(x) == 0 or np.abs(x).max() < 2.0**40 else None
    if scaled is None:
        return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    most = int(np.abs(scaled).max()) if scaled.size else 0
    return scaled.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _largest(x: np.ndarray) -> int:
    return int(max(abs(x.max()), abs(x.min()))) if x.size else 0


def scanned(x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, lowest index first; exact squared distance; that of the next best, infinite if there is none) of each row."""
    bound = x.shape[1] * (2 * max(_largest(x), _largest(code))) ** 2
    kind = np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object
    best, nearest, second = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object if kind is object else np.int64), np.full(len(x), math.inf)
    code = code.astype(kind)
    for at in range(0, len(x), STEP if kind is np.float64 else 64):
        some = x[at : at + (STEP if kind is np.float64 else 64)].astype(kind)
        if kind is np.float64:  # sums of whole numbers below 2 ** 53: exact
            d = (some * some).sum(axis=1)[:, None] - 2 * (some @ code.T) + (code * code).sum(axis=1)[None, :]
        else:
            gap = some[:, None, :] - code[None, :, :]
            d = (gap * gap).sum(axis=2)
        rows = np.arange(len(some))
        b = d.argmin(axis=1)
        best[at : at + len(some)], nearest[at : at + len(some)] = b, d[rows, b]
        if len(code) > 1:
            rest = np.minimum(d, 2**1000).astype(np.float64) if kind is object else d.astype(np.float64)
            rest[rows, b] = math.inf
            second[at : at + len(some)] = rest.min(axis=1)
    return best, nearest, second


def _slack(nearest: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Lower less upper bound, rounded down; whatever is too large for a double is never trusted."""
    if nearest.dtype == object:
        return np.where(np.isinf(second), math.inf, -math.inf)
    low, high = np.sqrt(second), np.sqrt(nearest.astype(np.float64))
    return low - high - 1e-9 * (1 + np.where(np.isinf(low), 0, low))


class Block:
    """Some vectors' pieces, the entries they are assigned to, and for each part and entry a heap of (key, row)."""

    def __init__(self, values: np.ndarray, entries: int):
        self.values, self.n, self.entries = values, len(values), entries
        self.pieces = np.split(values, PARTS, axis=1)
        self.assigned = np.zeros((PARTS, self.n), dtype=np.uint8)
        self.heaps: list[list] = [[] for _ in range(PARTS * entries)]
        self.rescanned = 0

    def delta(self) -> np.ndarray:
        return np.zeros((PARTS, self.entries, self.values.shape[1] // PARTS + 1), dtype=object if self.values.dtype == object else np.int64)

    def begin(self, codebooks: list[np.ndarray]) -> np.ndarray:
        """Assigns all, builds the heaps, and gives the sums and counts of each entry."""
        out = self.delta()
        for p, code in enumerate(codebooks):
            best, nearest, second = scanned(self.pieces[p], code)
            self.assigned[p] = best
            keys = _slack(nearest, second)
            for row, (e, key) in enumerate(zip(best.tolist(), keys.tolist(), strict=True)):
                self.heaps[p * self.entries + e].append((key, row))
            self._moved(out[p], np.arange(self.n), p, best, 1)
        for h in self.heaps:
            heapq.heapify(h)
        self.rescanned = PARTS * self.n
        return out

    def go_on(self, codebooks: list[np.ndarray], drift: np.ndarray) -> np.ndarray:
        """Pops the pieces whose bounds the drift has violated, assigns them again, and gives what changed in the sums and counts."""
        out = self.delta()
        self.rescanned = 0
        for p, code in enumerate(codebooks):
            rows: list[int] = []
            for e in range(self.entries):
                heap, limit = self.heap(p * self.entries + e), float(drift[p, e])
                while heap and heap[0][0] <= limit:
                    rows.append(heapq.heappop(heap)[1])
            if not rows:
                continue
            at = np.array(rows)
            best, nearest, second = scanned(self.pieces[p][at], code)
            keys = _slack(nearest, second) + drift[p, best]
            for row, e, key in zip(rows, best.tolist(), keys.tolist(), strict=True):
                heapq.heappush(self.heap(p * self.entries + e), (key, row))
            old = self.assigned[p, at].astype(np.int64)
            changed = old != best
            self._moved(out[p], at[changed], p, old[changed], -1)
            self._moved(out[p], at[changed], p, best[changed], 1)
            self.assigned[p, at] = best
            self.rescanned += len(rows)
        return out

    def heap(self, k: int) -> list:
        """A heap as a list of pairs; one that is still two arrays, in heap order, and has nothing to pop stays so until it is asked for."""
        if isinstance(self.heaps[k], tuple):
            keys, rows = self.heaps[k]
            self.heaps[k] = list(zip(keys.tolist(), rows.tolist(), strict=True))
        return self.heaps[k]

    def _moved(self, sums: np.ndarray, rows: np.ndarray, p: int, entries: np.ndarray, sign: int) -> None:
        pieces = self.pieces[p][rows]
        np.add.at(sums, (entries, slice(None, -1)), sign * (pieces if pieces.dtype == object else pieces.astype(np.int64)))
        np.add.at(sums, (entries, -1), sign)

    def errors(self, codebooks: list[np.ndarray]) -> np.ndarray:
        """The exact squared distances to the assigned entries, summed over the parts."""
        total = np.zeros(self.n, dtype=object if self.values.dtype == object or any(c.dtype == object for c in codebooks) else np.int64)
        for p, code in enumerate(codebooks):
            bound = code.shape[1] * (2 * max(_largest(self.pieces[p]), _largest(code))) ** 2
            kind = object if total.dtype == object or bound >= 2**60 else np.int64
            gap = self.pieces[p].astype(kind) - code.astype(kind)[self.assigned[p]]
            total = total + (gap * gap).sum(axis=1)
        return total

    def written(self, ids, tags, delta: np.ndarray) -> pa.RecordBatch:
        heaps = [h if isinstance(h, tuple) else (np.array([k for k, _ in h]), np.array([r for _, r in h], dtype=np.int32)) for h in self.heaps]
        sizes = np.array([len(k) for k, _ in heaps], dtype=np.int32)
        keys, rows = (np.concatenate([h[i] for h in heaps]).astype(t) for i, t in ((0, np.float64), (1, np.int32)))
        body = [_packed(self.values), self.assigned.tobytes(), keys.tobytes(), rows.tobytes(), sizes.tobytes(), _packed(delta)]
        return pa.RecordBatch.from_arrays([ids, tags, *(pa.array([x], pa.binary()) for x in body), pa.array([self.rescanned], pa.int64())], schema=_STATE)

    @classmethod
    def read(cls, row: dict, entries: int) -> Block:
        out = cls(_unpacked(row["values"]), entries)
        out.assigned = np.frombuffer(row["assigned"], dtype=np.uint8).reshape(PARTS, out.n).copy()
        keys, rows, sizes = (np.frombuffer(row[c], dtype=t) for c, t in (("keys", np.float64), ("rows", np.int32), ("sizes", np.int32)))
        ends = np.cumsum(sizes)
        out.heaps = [(keys[b - s : b], rows[b - s : b]) for s, b in zip(sizes, ends, strict=True)]
        return out


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(pickle.dumps(x, protocol=5), codec="zstd", asbytes=True) + len(pickle.dumps(x, protocol=5)).to_bytes(8, "little")


def _unpacked(raw: bytes) -> np.ndarray:
    return pickle.loads(pa.decompress(raw[:-8], decompressed_size=int.from_bytes(raw[-8:], "little"), codec="zstd", asbytes=True))


def _blocks(codebooks: list[np.ndarray], dims: int):
    """Rows (key, tag, vector) as blocks after their first assignment. Vectors with null or non-finite components, or of another length, end here."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, tags = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        made = Block(integers(np.concatenate([h[2] for h in held])), len(codebooks[0]))
        lists = [pa.ListArray.from_arrays(pa.array([0, made.n], pa.int32()), x) for x in (ids, tags)]
        return made.written(*lists, made.begin(codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
        held, n = [], 0
        for batch in batches:
            whole = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(2)), dims), False))
            x = whole.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            whole, x = whole.filter(pa.array(good)), x[good]
            at = 0
            while at < len(x):
                take = min(most - n, len(x) - at)
                held.append((whole.column(0).slice(at, take), whole.column(1).slice(at, take), x[at : at + take]))
                at, n = at + take, n + take
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _round(codebooks: list[np.ndarray], drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block.read({c: row.column(c)[0].as_py() for c in ("values", "assigned", "keys", "rows", "sizes")}, len(codebooks[0]))
                yield block.written(row.column("ids"), row.column("tags"), block.go_on(codebooks, drift))

    return run


def _coded(codebooks: list[np.ndarray], drift: np.ndarray):
    """The last assignment: (key, tag, code, error) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                block = Block.read({c: batch.column(c)[i].as_py() for c in ("values", "assigned", "keys", "rows", "sizes")}, len(codebooks[0]))
                block.go_on(codebooks, drift)
                text = np.ascontiguousarray(block.assigned.T).tobytes().hex()
                codes = [text[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(block.n)]
                # Errors go as text, for they may be longer than any number column.
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), batch.column("tags").slice(i, 1).flatten(), pa.array(codes), pa.array([str(e) for e in block.errors(codebooks).tolist()])], names=["key", "tag", "code", "error"])

    return run


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums over its blocks: (cell, limb, value) of those that aren't zero."""
    total = None
    for batch in batches:
        for raw in batch.column(0):
            delta = _unpacked(raw.as_py()).astype(object) if total is not None and total.dtype == object else _unpacked(raw.as_py())
            total = delta if total is None else total + delta if delta.dtype != object else total.astype(object) + delta
    cells, limbs, values = [], [], []
    for cell, v in enumerate(total.ravel().tolist() if total is not None else ()):
        sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
        while v:
            cells.append(cell)
            limbs.append(limb)
            values.append(sign * (v & ((1 << LIMB) - 1)))
            v, limb = v >> LIMB, limb + 1
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["cell", "limb", "value"])


def _gathered(state: DataFrame, sums: np.ndarray) -> None:
    """Adds to sums what the blocks of a state changed."""
    found = state.select("delta").mapInArrow(_changes, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    flat = sums.reshape(-1)
    for r in found.collect():
        flat[r["cell"]] += int(r["value"]) << (LIMB * r["limb"])


def _updated(codebooks: list[np.ndarray], sums: np.ndarray, drift: np.ndarray) -> list[np.ndarray]:
    """Entries as the floor of their pieces' mean; those without a piece stay. Adds the movement to the drift."""
    out = []
    for p, code in enumerate(codebooks):
        new = code.astype(object)
        for e in range(len(code)):
            count = sums[p, e, -1]
            if count:
                new[e] = [s // count for s in sums[p, e, :-1]]
        far = [math.inf if (d := sum(int(g) ** 2 for g in row)) > 2**1000 else math.sqrt(d) * (1 + 1e-9) for row in new - code.astype(object)]
        first, second = (sorted(far, reverse=True) + [0.0])[:2]
        drift[p] += np.array([f + (second if f == first else first) for f in far]) if len(far) > 1 else 0
        out.append(new.astype(np.int64) if _largest(new) < 2**62 else new)
    return out


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """((key, tag, code, error), the codebooks of the parts, pieces compared with all entries in each assignment).

    code has two hex digits a part, error is the decimal text of the sum of squared distances, tag is the label as text that sets
    null apart. Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those
    of another length than the row of the smallest key has among vectors of a multiple of PARTS components. The first
    codebooks are the pieces of the rows of the ``entries`` smallest keys, null keys last, equal keys by their
    vectors; of fewer rows there are as many entries. Repeated rows count each. Other columns are ignored. Numbers are
    exact whatever their size.
    """
    spark = vectors.sparkSession
    rows = bounded_batches(vectors).select(F.col(key).cast("long").alias("key"), tagged(label).alias("tag"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.where((F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & finite).select("key", "vector")
    order = [F.asc_nulls_last("key"), F.asc("vector")]
    head = valid.orderBy(*order).select(F.size("vector")).first()
    if head is None:
        return rows.select("key", "tag", F.lit("").alias("code"), F.lit("0").alias("error")).where("false"), [], []
    dims = head[0]
    firsts = np.array([r["vector"] for r in valid.where(F.size("vector") == dims).orderBy(*order).limit(entries).collect()])
    codebooks = [c.copy() for c in np.split(integers(firsts), PARTS, axis=1)]
    count = len(firsts)
    sums = np.zeros((PARTS, count, dims // PARTS + 1), dtype=object)
    drift = np.zeros((PARTS, count))
    compared = []
    path = scratch_path(spark, "codes-0")
    state = staged(rows.mapInArrow(_blocks(codebooks, dims), STATE), "codes-0", path)
    for i in range(1, rounds + 1):
        compared.append(state.agg(F.sum("rescanned")).first()[0])
        _gathered(state, sums)
        codebooks = _updated(codebooks, sums, drift)
        with scratch(spark) as over:  # what this round read goes when its own table is written
            after = staged(state.mapInArrow(_round(codebooks, drift), STATE), f"codes-{i}", new := scratch_path(spark, f"codes-{i}")) if i < rounds else staged(state.mapInArrow(_coded(codebooks, drift), "key long, tag string, code string, error string"), "codes", new := scratch_path(spark, "codes"))
            over[:] = [path]
        state, path = after, new
    return state, codebooks, compared


def codebooks_text(codebooks: list[np.ndarray]) -> str:
    """All components in decimal, by part, entry and position, joined by commas."""
    return ",".join(str(int(v)) for code in codebooks for row in code for v in row)


def codes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each kept row; label_error sums the errors of equal labels, nulls together. See ``compress``.

    Errors beyond a long are null in these two columns.
    """
    found, codebooks, _ = compress(vectors, key, embedding, label)
    exact = found.select("key", "tag", "code", F.col("error").cast("decimal(38,0)").alias("error"))
    labels = exact.groupBy("tag").agg(F.sum("error").alias("label_error"))  # a label with a third of the rows is one row of each task
    longs = lambda c: F.expr(f"try_cast({c} as long)").alias(c)
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return exact.join(labels, "tag").select(F.col("key").alias(key), "code", longs("error"), longs("label_error"), F.lit(digest).alias("codebooks_sha256"))
