"""Near-duplicate groups of texts by the exact similarity of their word shingles.

SimHash alone can't serve a similarity of 0.8: fingerprints then differ in about 10 of 64 bits, a
radius at which unrelated texts meet as well. So the pairs to test come from two searches: SimHash
links of the five-word fingerprints (see ``simhash``), which find the closest texts, and bands of
minimum hashes, which find a pair of similarity s in one of BANDS bands with a probability of
1 - (1 - s ** ROWS) ** BANDS: all but one in 40,000 at 0.8. Every pair is then tested on the exact
Jaccard similarity of the shingle sets, so no link is wrong.

Texts of equal words are one class, so copies are never paired. A band's bucket isn't expanded
into pairs either: its members are tested against one hub, the member that meets most others
over all bands. Only members outside the hub's component are then tested against the rest of the
bucket, and only where the triangle inequality of the Jaccard distance leaves a link possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, staged
from .graph import connected_components
from .simhash import SEED, fingerprint_of, links

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Rows of a key table that is broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_RANDOM = np.random.default_rng(SEED)
_MASK, _ODD = (_RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) for _ in range(2))
_ODD |= np.uint32(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` lower-cased words, repeats included; of fewer words, of them all; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(parts[i:] for i in range(words))) if len(parts) > words else [parts] if parts else []
    return np.array([digest(join(s), SEED) for s in runs], dtype=np.uint64)


def band_keys(unique: np.ndarray) -> list[int]:
    """One long for each band: a hash of its ROWS minimum hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (unique ^ (unique >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), 4096):
        low = np.minimum(low, ((short[at : at + 4096] ^ _MASK) * _ODD).min(axis=1))
    return [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kinds, prints, sizes, bands = [], [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(text)
            unique = np.unique(hashes)
            kinds.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63))
            prints.append(fingerprint_of(hashes))
            sizes.append(len(unique))
            bands.append(band_keys(unique) if len(unique) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "check", "kind", "fp", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [np.unique(shingle_hashes(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["kind", "s"])


def _possible(n: str, m: str, similarity: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - F.lit(1e-9)


def _shingle_sets(texts: DataFrame, at: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """(kind, s) for the wanted kinds, of one text each; at says where such a text is."""
    where = staged(at.join(wanted, "kind", "left_semi"), f"{label}-at")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("check") == F.col("c"))
    found = texts.join(F.broadcast(where) if where.count() <= BROADCAST_ROWS else where, same).select("kind", "text")
    return staged(found.mapInArrow(_sets, "kind long, s array<long>").dropDuplicates(["kind"]), f"{label}-sets")


def _verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """pairs (a, b) with their exact similarity j."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return staged(common.select("a", "b", (F.col("common") / (F.col("total") - F.col("common"))).alias("j")), label)


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: key, check (a hash of the text), kind, root.

    kind: equal for texts of the same words in the same order; root: equal for texts that are connected over
    pairs whose five-word shingle sets have a Jaccard similarity of at least ``similarity``. Null texts and texts
    without words are one kind, linked with nothing else. Fewer than five words are one shingle.
    Null keys, equal keys and repeated rows take part; other columns are ignored; an empty table gives an empty one.
    """
    narrow = bounded_batches(docs).select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("check"), F.col(text).alias("text"))
    rows = staged(narrow.mapInArrow(_described, "key long, check long, kind long, fp long, n long, bands array<long>"), "near-rows")
    kinds = staged(rows.where("n > 0").groupBy("kind").agg(F.min(F.struct("key", "check")).alias("of"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-kinds")
    at = kinds.select("kind", F.col("of.key").alias("k"), F.col("of.check").alias("c"))

    # Hubs: of each bucket the member whose buckets are the largest.
    put = kinds.select(F.explode("bands").alias("band"), "kind", "n")
    shared = put.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(put.join(shared, "band"), "near-members")
    weight = members.groupBy("kind").agg(F.sum("members").alias("weight"))
    weighed = members.join(weight, "kind")
    hubs = staged(weighed.groupBy("band").agg(F.max(F.struct("weight", "kind", "n")).alias("hub")).select("band", F.col("hub.kind").alias("hub"), F.col("hub.n").alias("hub_n")), "near-hubs")
    stars = members.join(hubs, "band").where("kind <> hub").where(_possible("n", "hub_n", similarity)).select(F.col("kind").alias("a"), F.col("hub").alias("b"))

    # SimHash: classes of one fingerprint meet the smallest of them, and those meet over the grid.
    prints = staged(kinds.groupBy("fp").agg(F.min("kind").alias("one")), "near-prints")
    equal = kinds.select("fp", "kind").join(prints, "fp").where("kind <> one").select(F.col("kind").alias("a"), F.col("one").alias("b"))
    grid = links(prints).join(prints.toDF("a", "a_kind"), "a").join(prints.toDF("b", "b_kind"), "b").select(F.col("a_kind").alias("a"), F.col("b_kind").alias("b"))

    first = staged(stars.unionAll(equal).unionAll(grid).distinct(), "near-first")
    paired = first.select(F.explode(F.array("a", "b")).alias("kind")).distinct()
    known = _verified(first, _shingle_sets(narrow, at, paired, "near-tested"), "near-tested")
    sure = known.where(F.col("j") >= similarity).select("a", "b")
    roots = staged(connected_components(sure, "a", "b"), "near-roots")

    # What is outside its hub's component meets the rest of the bucket.
    of = members.select("band", "kind", "n").join(hubs.select("band", "hub"), "band")
    of = of.join(roots.toDF("kind", "root"), "kind", "left").join(roots.toDF("hub", "hub_root"), "hub", "left")
    of = of.select("band", "kind", "n", "hub", F.coalesce("root", "kind").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
    open_bands = of.where("root <> hub_root").select("band").distinct()
    left = staged(of.join(open_bands, "band", "left_semi").join(known.toDF("kind", "hub", "j"), ["kind", "hub"], "left").where("kind <> hub"), "near-open")
    left = left.join(_shingle_sets(narrow, at, left.select("kind").distinct(), "near-open"), "kind").withColumn("out", F.col("root") != F.col("hub_root"))
    outer = left.where("out").select("band", *(F.col(c).alias(f"{c}_a") for c in ("kind", "n", "root", "j", "s")))
    other = left.select("band", "out", *(F.col(c).alias(f"{c}_b") for c in ("kind", "n", "root", "j", "s")))
    apart = (F.col("root_a") != F.col("root_b")) & (~F.col("out") | (F.col("kind_a") < F.col("kind_b")))
    bound = _possible("n_a", "n_b", similarity) & F.coalesce(F.abs(F.col("j_a") - F.col("j_b")) <= 1 - similarity + 1e-9, F.lit(True))
    exact = F.size(F.array_intersect("s_a", "s_b")) * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-9
    more = staged(outer.join(other, "band").where(apart & bound & exact).select(F.col("kind_a").alias("a"), F.col("kind_b").alias("b")).distinct(), "near-more")
    final = connected_components(sure.unionAll(more), "a", "b")
    return rows.select("key", "check", "kind").join(final.toDF("kind", "root"), "kind", "left").select(F.col("key").alias(key), "check", "kind", F.coalesce("root", "kind").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one with the smallest key (null keys last), of equal rows any one."""
    found = similar_components(docs, key, text, similarity)
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("check").alias("check"))
    kept = found.groupBy("root").agg(F.min(first).alias("one")).select(F.coalesce("one.key", F.lit(-1)).alias("_k"), F.col("one.none").alias("_n"), F.col("one.check").alias("_c"))
    keyed = docs.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-1)), "_n": F.col(key).isNull(), "_c": F.xxhash64(F.col(text))})
    return keyed.join(staged(kept, "near-kept"), ["_k", "_n", "_c"], "left_semi").dropDuplicates(["_k", "_n", "_c"]).select(*docs.columns)
