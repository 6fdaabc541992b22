"""Words of text that is written without spaces: a dictionary learned from the corpus, and the most probable path over the graph of its words.

A string of characters is a word where it holds together and its surroundings are free: its cohesion is
the least pointwise mutual information of any cut through it, its freedom the lesser entropy of what stands before
and after it. Both come from counts of all substrings up to a length, which Spark sums over the whole corpus.
A run of characters is then cut where the product of its words' frequencies is largest. Single characters
are always words; what the dictionary doesn't know is cut into them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a word at most, occurrences at least, and the bounds of cohesion and freedom (in nats). Two words that follow each other by chance
#: cohere by about the logarithm of a word's mean length, so the bound of cohesion must be above that: these are for Chinese.
LONGEST, LEAST, COHESION, FREEDOM = 4, 5, 1.0, 0.7
#: Words of a dictionary at most, the most frequent ones: it is held by every task.
WORDS = 500_000
#: Marks before and after a run.
BEGIN, END = "\x02", "\x03"


def unspaced_runs(c: Column) -> Column:
    """Runs of Chinese characters."""
    return F.regexp_extract_all(c, F.lit(r"([一-鿿]+)"), 1)


def joined_runs(c: Column) -> Column:
    """Runs of lower-cased letters once all white space is gone; other characters part them."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(r"(\p{L}+)"), 1)


def gram_counts(docs: DataFrame, runs: Column, longest: int = LONGEST) -> DataFrame:
    """(gram, n): how often each substring of up to longest + 1 characters stands in the runs, their marks included. Null texts have no runs."""
    # One pass: each task sums its own substrings before any are sent.
    marked = docs.select(F.explode(runs).alias("run")).select(F.concat(F.lit(BEGIN), "run", F.lit(END)).alias("run"))
    starts = marked.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    pieces = starts.select("run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest + 1), F.length("run") - F.col("i") + 1))).alias("len"))
    return pieces.select(F.expr("substring(run, i, len)").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def candidates(counts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(word, n, cohesion, freedom) of strings of 2 to longest characters that occur ``least`` times. counts: (gram, n), read several times, so staged."""
    own = counts.where(~F.col("gram").rlike(f"[{BEGIN}{END}]"))
    single = own.where(F.length("gram") == 1).agg(F.sum("n").cast("double").alias("total"))  # one row
    words = own.where(F.length("gram").between(2, longest) & (F.col("n") >= least))
    cuts = words.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k")).select("gram", "n", F.expr("left(gram, k)").alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    # Parts of a string that occurs so often do so too.
    parts = own.where((F.length("gram") < longest) & (F.col("n") >= least))
    both = cuts.join(parts.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(parts.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(single))
    cohesion = both.groupBy("gram", "n").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("cohesion"))

    def entropy(side: str, name: str) -> DataFrame:
        """Of the characters on one side of each string: from the counts of the strings one longer."""
        longer = counts.where(F.length("gram") >= 3).select(F.expr("left(gram, length(gram) - 1)" if side == "after" else "substring(gram, 2)").alias("gram"), "n").where(~F.col("gram").rlike(f"[{BEGIN}{END}]"))
        return longer.groupBy("gram").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))

    free = cohesion.join(entropy("after", "after"), "gram").join(entropy("before", "before"), "gram")
    return free.select(F.col("gram").alias("word"), "n", "cohesion", F.least("after", "before").alias("freedom"))


def dictionary(counts: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM, most: int = WORDS) -> dict[str, float]:
    """Words with the logarithm of their frequency: candidates beyond both bounds, and all single characters; ``most`` of them, the most frequent first."""
    kept = candidates(counts, longest, least).where((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom)).select("word", "n")
    single = counts.where((F.length("gram") == 1) & ~F.col("gram").isin(BEGIN, END)).select(F.col("gram").alias("word"), "n")
    rows = kept.unionByName(single).orderBy(F.desc("n"), "word").limit(most).collect()
    total = sum(r["n"] for r in rows)
    return {r["word"]: math.log(r["n"] / total) for r in rows}


def best_path(run: str, words: dict[str, float], longest: int) -> list[str]:
    """The cut of a run of which the sum of logarithms is largest; of equal ones that with the longer last words. Unknown characters stand alone."""
    unknown = min(words.values(), default=0.0) - 10.0
    best, last = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        best[end], last[end] = -math.inf, end - 1
        for at in range(max(0, end - longest), end):
            weight = words.get(run[at:end], unknown if end - at == 1 else None)
            if weight is not None and best[at] + weight > best[end]:
                best[end], last[end] = best[at] + weight, at
    out, end = [], len(run)
    while end:
        out.append(run[last[end] : end])
        end = last[end]
    return out[::-1]


def segmented(docs: DataFrame, runs: Column, words: dict[str, float], key: str = "doc_id") -> DataFrame:
    """(key, words): the words of each row's runs, in order; an empty list where there are none. The dictionary goes to the tasks once."""
    longest = max(map(len, words), default=1)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[w for r in found or [] for w in best_path(r, held.value, longest)] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=[key, "words"])

    return docs.select(F.col(key).cast("long").alias(key), runs.alias("_runs")).mapInArrow(run, f"{key} long, words array<string>")


def refined(docs: DataFrame, runs: Column, words: dict[str, float], rounds: int = 2, least: int = LEAST, most: int = WORDS) -> dict[str, float]:
    """The dictionary with the frequencies that its words have in the corpus as it cuts it, round by round: strings that occur only inside longer words fade. Single characters stay."""
    for _ in range(rounds):
        cut = segmented(docs.select(F.lit(0).alias("_key"), runs.alias("_r")), F.col("_r"), words, "_key")
        counts = cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
        rows = {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}
        rows |= {w: 1 for w in words if len(w) == 1 and w not in rows}
        total = sum(rows.values())
        words = {w: math.log(n / total) for w, n in rows.items()}
    return words


def boundary_score(found: DataFrame, given: DataFrame, key: str = "doc_id") -> DataFrame:
    """(precision, recall) of the inner word boundaries of found (key, words) against given (key, words): of words at the same places."""

    def places(df: DataFrame, name: str) -> DataFrame:
        ends = F.expr("aggregate(words, named_struct('at', 0, 'ends', cast(array() as array<string>)), (a, w) -> named_struct('at', a.at + length(w), 'ends', concat(a.ends, array(concat(cast(a.at as string), '-', cast(a.at + length(w) as string))))), a -> a.ends)")
        return df.select(key, ends.alias(name))

    both = places(found, "f").join(places(given, "g"), key).select(F.size("f").alias("nf"), F.size("g").alias("ng"), F.size(F.array_intersect("f", "g")).alias("hit"))
    return both.agg((F.sum("hit") / F.sum("nf")).alias("precision"), (F.sum("hit") / F.sum("ng")).alias("recall"))
