"""Finding benchmark items in documents, with DataFrame operations only.

A window is item-sized: as many word shingles as the item has. Shingles a document shares with an
item are found first; since all windows of one size weigh the same, the best window can be taken
to begin at a shared shingle or to end the document, and only windows with enough shared
shingles for the similarity asked can reach it. These are the windows that are fingerprinted by
SimHash; which item one of them may hold is found by the fingerprints alone: an index over
BLOCKS blocks of bits lists, for the items of each size, all values within RADIUS // BLOCKS bits of
each block. By the pigeonhole principle a window meets every item within RADIUS bits. What is
found is verified by its exact weighted similarity: the multisets' intersection over their union.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 10 bits of 64 on average, with a deviation of 3.
RADIUS, BLOCKS = 23, 6
#: Rows of a key or shingle table that is broadcast at most (some 30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingles(of: str) -> Column:
    """Hashes of all runs of WORDS words of an array column; of fewer words, the one of them all; none for no words."""
    run = ", ".join(f"{of}[i + {k}]" for k in range(WORDS))
    return F.expr(f"case when size({of}) >= {WORDS} then transform(sequence(0, size({of}) - {WORDS}), i -> xxhash64({run})) when size({of}) > 0 then array(xxhash64(array_join({of}, ' '))) else cast(array() as array<bigint>) end")


def simhash(of: str) -> Column:
    """64-bit SimHash of an array of hashes, repeats weighing as often: bit sums in 32 packed pairs of lanes."""
    parts = []
    for r in range(32):
        total = f"aggregate({of}, 0L, (s, x) -> s + (shiftrightunsigned(x, {r}) & 4294967297L))"
        parts.append(f"(case when 2 * ({total} & 4294967295L) > size({of}) then {1 << r}L else 0L end) | (case when 2 * shiftrightunsigned({total}, 32) > size({of}) then shiftleft({1 << r}L, 32) else 0L end)")
    return F.expr(" | ".join(parts))


def _listed(block: int, bits: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), bits.bitwiseXOR(mask).alias("bits"))


def _blocks(fp: str, near: int = 0) -> Column:
    """BLOCKS blocks of a fingerprint's bits, as structs (block, bits); near: with all values of a block within so many bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    parts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        bits = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        masks = [sum(1 << k for k in which) for n in range(near + 1) for which in combinations(range(b - a), n)]
        parts.append(F.transform(F.lit(masks).cast("array<bigint>"), _listed(i, bits)))
    return F.flatten(F.array(*parts))


def within_radius(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(m, fp, item): all pairs of prints (m, fp) and items (item, m, item_fp) of one size whose fingerprints differ in RADIUS bits or fewer.

    The items' side of the index has some 1,300 rows an item, whatever the documents; it is broadcast if small enough.
    """
    listed = staged(items.select("item", "m", "item_fp", F.explode(_blocks("item_fp", RADIUS // BLOCKS)).alias("b")).select("item", "m", "item_fp", "b.*"), "bench-index")
    probes = prints.select("m", "fp", F.explode(_blocks("fp")).alias("b")).select("m", "fp", "b.*")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return probes.join(_small(listed), ["m", "block", "bits"]).where(close).select("m", "fp", "item").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, a staged table, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, item, check, similarity, start, windows): each document and each item of which it holds a window similar enough.

    similarity and start are of the best window (the first of equals), start counted in words;
    check is a hash of the text, telling rows of equal keys apart. Rows equal in key and text give one row. Texts and items that are
    null or without words match nothing; those of fewer than WORDS words match as a whole. Null keys
    take part. Items of equal text are all reported. Other columns are ignored.
    """
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("check"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("w")).select("item", shingles("w").alias("s"))
    items = staged(items.select("item", "s", F.size("s").alias("m"), simhash("s").alias("item_fp")), "bench-items").where("m > 0")
    weights = staged(items.select("item", F.explode("s").alias("h")).groupBy("item", "h").agg(F.count("*").alias("weight")), "bench-weights")
    known = weights.select("h", "item")

    shingled = keyed.select("key", "check", words(F.col("text")).alias("w")).select("key", "check", shingles("w").alias("s"))
    places = shingled.select("key", "check", F.size("s").alias("size"), F.posexplode_outer("s").alias("at", "h"))  # outer: else an inferred filter would split each text again for each shingle
    hits = places.join(_small(known), "h").select("key", "check", "item", "size", "at").join(_small(items.select("item", "m")), "item")
    grouped = hits.groupBy("key", "check", "item", "size", "m").agg(F.sort_array(F.collect_set("at")).alias("p"))
    # Windows of least(m, size) shingles; one with n shared shingles has a similarity of n / (m + window - n) at most.
    need = F.ceil(F.lit(similarity) * (F.col("m") + F.least("m", "size")) / (1 + similarity) - 1e-9).cast("int")
    enough = grouped.withColumn("need", F.greatest(need, F.lit(1))).where("size(p) >= need").withColumn("final", F.expr("greatest(size - m, 0)"))
    starts = F.expr("array_distinct(concat(filter(p, (x, i) -> i + need - 1 < size(p) and p[i + need - 1] < x + m and x <= final), case when size(filter(p, x -> x >= final)) >= need then array(final) else cast(array() as array<int>) end))")
    windows = staged(enough.select("key", "check", "m", "final", F.explode(starts).alias("start")).distinct(), "bench-windows")

    wanted = staged(windows.select("key", "check").distinct(), "bench-documents")
    same = F.col("key").eqNullSafe(F.col("key_w")) & (F.col("check") == F.col("check_w"))
    texts = keyed.join(_small(wanted.toDF("key_w", "check_w")), same, "left_semi").select("key", "check", words(F.col("text")).alias("w")).select("key", "check", shingles("w").alias("s")).dropDuplicates(["key", "check"])
    right = windows.toDF("key_w", "check_w", "m", "final", "start")
    cut = texts.join(right, same).select("key", "check", "m", "final", "start", F.expr("slice(s, start + 1, m)").alias("s"))
    printed = staged(cut.withColumn("fp", simhash("s")), "bench-prints")

    # Windows of one fingerprint are sought once, however many documents hold them.
    found = staged(within_radius(printed.select("m", "fp").distinct(), items.select("item", "m", "item_fp")), "bench-found")
    pairs = printed.join(_small(found), ["m", "fp"]).join(_small(items.select("item", F.col("s").alias("item_s"))), "item")
    # The windows of an item are those that begin at one of its shingles, and the last one.
    parts = pairs.where((F.col("start") == F.col("final")) | F.array_contains("item_s", F.col("s")[0]))
    counted = parts.select("key", "check", "item", "m", "start", F.size("s").alias("size"), F.explode("s").alias("h")).groupBy("key", "check", "item", "m", "start", "size", "h").agg(F.count("*").alias("n"))
    common = counted.join(_small(weights), ["item", "h"]).groupBy("key", "check", "item", "m", "start", "size").agg(F.sum(F.least("n", "weight")).alias("common"))
    exact = common.withColumn("similarity", F.col("common") / (F.col("m") + F.col("size") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = exact.groupBy("key", "check", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"), F.count("*").alias("windows"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "check", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    found = staged(contaminated(docs, benchmark, key, text, **how).select(F.col(key).alias("_k"), F.col("check").alias("_c")).distinct(), "bench-found")
    bad = F.col(key).cast("long").eqNullSafe(F.col("_k")) & (F.xxhash64(F.col(text)) == F.col("_c"))
    return docs.join(_small(found), bad, "left_anti")
