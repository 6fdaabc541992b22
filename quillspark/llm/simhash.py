"""Near-duplicate groups of texts by SimHash.

A fingerprint has 64 bits; two fingerprints link at RADIUS or fewer differing bits. To find the
links without comparing all pairs, each fingerprint is embedded as the bit counts of its 32
two-bit segments, kept as thermometer codes (0: 00, 1: 01, 2: 11), so that the Manhattan
distance of two embeddings is the number of differing code bits. A changed fingerprint bit
changes one count by one at most: Manhattan distance never exceeds Hamming distance. With a
radius of 3, one half of the counts is then within Manhattan distance 1, so the pair meets in a
grid of unit cells over that half: one side is put in its own cell, the other in its own and the
neighbouring cells. What meets is tested on the whole Manhattan bound and then exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, staged
from .graph import connected_components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, unsigned; 0 where it has no words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        return digest(join(parts), SEED)
    return fingerprint_of(np.array([digest(join(s), SEED) for s in zip(*(parts[i:] for i in range(words)))], dtype=np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, repeats counting as often; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text never holds all its bits at once
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, check, fp) for each row of docs: the fingerprint as a signed long, and a hash that tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=[key, "check", "fp"])

    narrow = bounded_batches(docs).select(F.col(key).cast("long").alias(key), F.xxhash64(F.col(text)).alias("check"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"{key} long, check long, fp long")


_LOW = 0x5555555555555555


def _embedded(fps: DataFrame) -> DataFrame:
    """Adds ``counts``: the thermometer codes of the 32 segment bit counts."""
    odd = F.shiftrightunsigned("fp", 1)
    some = F.col("fp").bitwiseOR(odd).bitwiseAND(F.lit(_LOW))
    both = F.col("fp").bitwiseAND(odd).bitwiseAND(F.lit(_LOW))
    return fps.withColumn("counts", some.bitwiseOR(F.shiftleft(both, 1)))


def _halves(fps: DataFrame) -> DataFrame:
    """Two rows a fingerprint: half 0 or 1 and ``cell``, the codes of that half's 16 counts."""
    low = F.col("counts").bitwiseAND(F.lit(0xFFFFFFFF))
    return fps.select("fp", "counts", F.posexplode(F.array(low, F.shiftrightunsigned("counts", 32))).alias("half", "cell"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs in column fp that differ in 1 to RADIUS bits. May repeat a pair."""
    own = _halves(_embedded(fps.select("fp")))
    # From count 0 or 2 one step leads to 1 (flip the low or the high code bit); from 1 to 0 or 2.
    steps = "transform(sequence(0, 15), i -> case shiftright(cell, 2 * i) & 3 when 0 then cell ^ shiftleft(1L, 2 * i) else cell ^ shiftleft(2L, 2 * i) end)"
    back = "transform(filter(sequence(0, 15), i -> shiftright(cell, 2 * i) & 3 = 1), i -> cell ^ shiftleft(1L, 2 * i))"
    near = own.select(F.col("fp").alias("b"), F.col("counts").alias("counts_b"), "half", F.explode(F.expr(f"concat(array(cell), {steps}, {back})")).alias("cell"))
    left = own.select(F.col("fp").alias("a"), F.col("counts").alias("counts_a"), "half", "cell")
    bound = F.bit_count(F.col("counts_a").bitwiseXOR(F.col("counts_b"))) <= RADIUS
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    same = (left["half"] == near["half"]) & (left["cell"] == near["cell"])
    # Spark takes a Generate's rows to be as many as its input's, and would broadcast some fifty cells a fingerprint.
    return left.join(near.hint("merge"), same & (F.col("a") < F.col("b")) & bound & exact).select("a", "b")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, check, fp, component (the smallest key reachable over links).

    Null texts and texts without words have fingerprint zero and link like any other. Rows with
    a null key take part and keep it; a component of such rows only has a null component. Equal
    fingerprints always belong together, so only distinct ones are joined. Other columns are ignored.
    """
    fps = staged(fingerprints(docs, key, text), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct), "a", "b")
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component"))
    named = of.join(smallest, "root").select("fp", "component")
    return fps.join(named, "fp").select(key, "check", "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest key (null keys last), of equal rows any one."""
    found = simhash_components(docs, key, text)
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("check").alias("check"))
    group = F.struct(F.col("component").isNull().alias("none"), F.coalesce("component", "fp").alias("id"))
    kept = found.groupBy(group.alias("group")).agg(F.min(first).alias("one")).select(F.coalesce("one.key", F.lit(-1)).alias("_k"), F.col("one.none").alias("_n"), F.col("one.check").alias("_c"))
    keyed = docs.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-1)), "_n": F.col(key).isNull(), "_c": F.xxhash64(F.col(text))})
    return keyed.join(kept, ["_k", "_n", "_c"], "left_semi").dropDuplicates(["_k", "_n", "_c"]).select(*docs.columns)
