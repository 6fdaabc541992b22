"""Packing tokenized documents into sequences of a fixed capacity.

Only the number of pieces of each length matters to a packing, so the plan is made over the
histogram of lengths, which has no more rows than the capacity whatever the corpus. The longest
length left opens a pattern; its gap is closed by exact complements: one length equal to the gap,
a pair or a triple whose sum is the gap, looked up in indexes of lengths and sums and checked
against what is available. Where no combination fits exactly, the single or pair that leaves least
is taken and the rest of the gap is tried again. A pattern is applied as often as its lengths
allow at once. Pieces then take the places of their length in order of their rank, which is
counted by task and length, so neither a long window nor a shuffle of texts is needed.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, staged

CAPACITY = 2048
SEPARATOR = 0
SPECIAL = "<|endoftext|>"
CACHED_WORDS = 300_000
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class WordCache(dict):
    """Token ids of a word with the space before it, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class Tokenizer:
    """Byte-level BPE ids of whole texts. Such a tokenizer splits before any single space that a non-space follows, so words are encoded apart and cached."""

    def __init__(self, json: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = WordCache(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary)
        self.json, self.full = json, None

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            from tokenizers import Tokenizer as Full

            self.full = self.full or Full.from_file(self.json)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        chunks = [first]
        for word in rest:
            if word and not word[0].isspace():
                chunks.append(" " + word)
            else:  # a longer run of white space: its end belongs to what follows
                chunks[-1] += " " + word
        return b"".join(map(self.words.__getitem__, chunks))


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def _pieces(json: str, ranks: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get((json, ranks)) or _tokenizers.setdefault((json, ranks), Tokenizer(json, ranks))
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    held = ids[4 * a : 4 * b]
                    rows.append((key, i, a, b - a, crc32(held), part, seen[b - a], np.frombuffer(held, dtype="<u4").astype(np.int32) if keep_ids else None))
                    seen[b - a] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], names=["key", "piece", "start", "length", "ids_crc32", "part", "k", "ids"])

    return run


class LengthIndex:
    """Available lengths, and of how many ordered pairs of them each sum consists."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.live = self.left > 0
        at = self.live.astype(np.float64)
        self.pairs = np.rint(np.convolve(at, at)).astype(np.int64)

    def take(self, used: Counter, times: int) -> None:
        for x, n in used.items():
            self.left[x] -= n * times
            if not self.left[x]:
                self.live[x] = False
                self.pairs[x + np.flatnonzero(self.live)] -= 2
                self.pairs[2 * x] -= 1

    def free(self, used: Counter, *lengths: int) -> bool:
        want = Counter(lengths)
        return all(self.left[x] - used[x] >= n for x, n in want.items())

    def pair(self, total: int, used: Counter) -> tuple[int, ...]:
        """Two available lengths of that sum, the most unequal ones; or none."""
        if total < 2 or not self.pairs[total]:
            return ()
        for a in np.flatnonzero(self.live[1 : total // 2 + 1]) + 1:
            if self.live[total - a] and self.free(used, int(a), int(total - a)):
                return int(total - a), int(a)
        return ()

    def exact(self, gap: int, used: Counter) -> tuple[int, ...]:
        if self.free(used, gap):
            return (gap,)
        if found := self.pair(gap, used):
            return found
        lengths = np.flatnonzero(self.live[: gap - 1])
        for a in lengths[self.pairs[gap - lengths] > 0][::-1]:
            more = used + Counter([int(a)])
            if self.free(used, int(a)) and (found := self.pair(gap - int(a), more)):
                return int(a), *found
        return ()

    def best(self, gap: int, used: Counter) -> tuple[int, ...]:
        """The single or the pair that leaves least of the gap; or none fits."""
        one = next((int(a) for a in np.flatnonzero(self.live[: gap + 1])[::-1] if self.free(used, int(a))), 0)
        for total in np.flatnonzero(self.pairs[one + 1 : gap + 1])[::-1] + one + 1:
            if found := self.pair(int(total), used):
                return found
        return (one,) if one else ()


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, times): patterns that place all pieces, each length at most capacity."""
    index = LengthIndex(counts, capacity)
    plan = []
    while (top := np.flatnonzero(index.live)).size:
        pattern = [int(top[-1])]
        used = Counter(pattern)
        while (gap := capacity - sum(pattern)) and (more := index.exact(gap, used) or index.best(gap, used)):
            pattern += more
            used.update(more)
        times = int(min(index.left[x] // n for x, n in used.items()))
        index.take(used, times)
        plan.append((pattern, times))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by first rank: (rank, times a sequence, first sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, n in Counter(pattern).items():
            rows.setdefault(length, []).append((rank[length], n, base, offset))
            rank[length] += n * times
            offset += n * length
        base += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) for length, found in rows.items()}


def _placed(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                first, n, base, begin = places[int(x)]
                at = np.flatnonzero(length == x)
                e = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[e]
                sequence[at], offset[at] = base[e] + nth // n[e], begin[e] + nth % n[e] * x
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, json: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids (array<int>).

    A document is its ids and the id 0; only one longer than capacity is cut, its first piece taking
    what is over. A null or empty text is the id 0 alone. Rows are packed as they are: null or
    repeated keys matter to nothing, other columns are ignored, an empty table gives an empty one.
    """
    json, ranks = json or public_tokenizers.path(JSON), ranks or public_tokenizers.path(RANKS)
    schema = "key long, piece int, start long, length long, ids_crc32 long, part int, k long, ids array<int>"
    cut = bounded_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_pieces(json, ranks, capacity, keep_ids), schema)
    pieces = staged(cut if keep_ids else cut.drop("ids"), "pieces")
    sizes = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-sizes")
    plan = packing_plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The bases grow with lengths times parts, so they are joined by a shuffle of narrow rows and never broadcast.
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("k") + F.col("base"))
    columns = [*("key", "piece", "start", "length", "ids_crc32"), *(["ids"] if keep_ids else [])]
    types = {"key": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>"}
    out = ranked.select(*columns, "rank").mapInArrow(_placed(_places(plan)), ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
