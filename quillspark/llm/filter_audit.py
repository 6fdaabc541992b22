"""How filters interact: what each removes in every order of applying them, by Walsh-Hadamard sums.

A row fails some of five filters: a mask of five bits. For each part and label, 32 parity sums are
aggregated, the s-th adding a row where it fails an even number of the filters of s and taking it
off otherwise. The transform is its own inverse up to a factor of 32, so the sums give the exact
number of rows of each mask, and those give every order, step and Shapley value without the rows:
a filter that a row fails along with k - 1 others removes it in 120 / k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\f\r"  # with the space itself, what parts words
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: A is the lowest bit."""
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " +"), lambda w: w != "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))[0]
    bit = lambda condition, k: F.when(condition, 1 << k).otherwise(0)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    held = F.transform(F.array(counted), lambda c: bit(c["n"] < LEAST_WORDS, 0) + bit(100 * c["kinds"] < LEAST_DISTINCT * c["n"], 1))[0]
    return held + bit(100 * upper > MOST_UPPER * F.length(text), 2) + bit(text.rlike(r"[#$%&*|]"), 3)


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of each key: whether any of its labels says so."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): how many rows of docs fail just the filters of a mask, in several rows.

    Equal texts fail the same of A to D, so they are counted together before they are sent: by SHA-256, key
    and part, then without the key. Of equal texts, the rows of the smallest key pass E.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_text"))
    rows = rows.select("_key", "part", failures(F.col("_text")).alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"))
    # No key is smaller or larger than a null one, and none labels it.
    lone = rows.where("_key is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    each = rows.where("_key is not null").groupBy("digest", "mask", "_key", "part").agg(F.count("*").alias("n"))
    marked = each.join(_labelled(labels), "_key", "left").select("digest", "mask", "_key", "part", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    together = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("_key").alias("least"), F.min_by("n", "_key").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))  # at most a row for each part and label
    split = together.withColumn("_own", F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("_own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("_own")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0").unionByName(lone)


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed sums of each part and label."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    sums = counted.groupBy("part", "good", "toxic").agg(*(F.sum(sign(s) * F.col("n")).alias(f"_{s}") for s in range(MASKS)))
    return sums.select("part", "good", "toxic", F.array(*(F.col(f"_{s}") for s in range(MASKS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each part the number of rows of each mask, of all and of those labelled so; 32 numbers each."""
    inverse = f"transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L, (a, s) -> a + (1 - 2 * (bit_count(m & s) % 2)) * sums[s]) div {MASKS})"
    found = sums.withColumn("_cells", F.expr(inverse))
    of = lambda when: [F.sum(F.when(when, F.col("_cells")[m]).otherwise(0)) for m in range(MASKS)]
    return found.groupBy("part").agg(F.array(*of(F.lit(True))).alias("all"), F.array(*of(F.col("good"))).alias("good"), F.array(*of(F.col("toxic"))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the part of the empty string. Rows of a null key fail no E and have no
    label; of rows that repeat key and text none fails E for the others. A key has a label if any of its
    rows in labels (doc_id, quality, toxic) gives it. Other columns are ignored; an empty table gives no rows.
    """
    counted = cells(parity_sums(masks(docs, labels, key, text, part)))
    # What a filter removes depends on the set of those before it alone: 80 cases, each met in several orders.
    cases: dict[tuple[int, int], list[str]] = {}
    for o in ORDERS:
        for k, f in enumerate(o):
            cases.setdefault((sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(f)), []).append(o)
    steps = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit"), F.split(F.lit(",".join(orders)), ",").alias("orders")) for (b, f), orders in cases.items()))
    total = lambda of, when, weight="1": F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> case when {when} then a + {of}[m] * {weight} else a end)")
    fails, alone = "m & bit <> 0", "m & bit <> 0 and m & before = 0"
    numbers = counted.select("part", "all", "good", "toxic", F.inline(steps)).select(
        "part", "orders", (F.bit_count("before") + 1).alias("step"),
        total("all", "m & (before | bit) = 0").alias("kept"), total("all", alone).alias("removed"),
        total("all", f"{fails} and m & before <> 0").alias("redundant"), total("all", "m = bit").alias("unique_fails"),
        total("good", alone).alias("good_lost"), total("toxic", alone).alias("toxic_lost"),
        total("all", fails, f"({len(ORDERS)} div bit_count(m))").alias("shapley"),
    )
    return numbers.select("part", F.explode("orders").alias("filter_order"), *numbers.columns[2:])
