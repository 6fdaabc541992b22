"""An inverted index of texts, and keyword search for many questions at once.

The index is written once: a posting for each word and text, with the word's places, and for each word and
block of texts the largest gain that any of the block's texts has from it. A word's gain depends on how often it
stands in a text, so texts are put in blocks by length: those with large gains share blocks, and the bounds
of the others are low. A question's score in a block is at most the sum of its words' gains there, so
blocks are visited from the highest bound on, and those below a question's n-th score are never read.

Words, postings and bounds are joined by shuffles; nothing of a question or a text goes through the driver but
a histogram of lengths and the numbers of the buckets that hold the asked words, which prune the files read.
A frequent word is spread over many buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval
from quillspark.sources.scratch import staged

#: Texts in a block, about; blocks of one word that share a bucket; bytes of text for which there is a bucket, and buckets at most.
BLOCK, SPREAD, BUCKET_BYTES, BUCKETS = 64, 1 << 14, 128 << 20, 4096
#: Blocks of the highest bounds that set a question's first n-th score.
SEEDS = 4
#: What rounding to six places may add to a score.
ROUNDING = 1e-6


@dataclass
class Index:
    postings: DataFrame
    maxima: DataFrame
    buckets: int
    spreads: int

    def of(self, part: DataFrame, words: DataFrame) -> DataFrame:
        """The rows of postings or maxima in buckets that may hold the words (term)."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(self.spreads - 1)))
        found = words.select("term").distinct().select("term", spread.alias("s")).select(_bucket(F.col("term"), F.col("s"), self.buckets).alias("b")).distinct()
        return part.where(F.col("bucket").isin([r["b"] for r in found.collect()]))


def _bucket(term: Column, spread: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term, spread.cast("long")), F.lit(buckets)).cast("int")


def _gain(n: str) -> Column:
    """1 + 1/4 + ... + 1/n**2; beyond a thousand by its expansion, exact to a double."""
    return F.expr(f"case when {n} <= 1000 then aggregate(sequence(1, {n}), 0D, (s, j) -> s + 1D / (j * j)) else pi() * pi() / 6 - 1D / {n} + 1D / (2D * {n} * {n}) - 1D / (6D * {n} * {n} * {n}) end")


_WORDS = "term string, block long, id long, copy long, places array<int>"
#: Postings that a task passes on at once, about.
PASSED = 1 << 15


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of each text (id, copy, block, words), so that no word's place is shuffled on its own."""
    names = [c.split(" ")[0] for c in _WORDS.split(", ")]
    for batch in batches:
        terms, places, ends, of = [], [], [0], []
        for i in range(batch.num_rows):
            found: dict[str, list[int]] = {}
            for at, word in enumerate(batch.column(3)[i].as_py(), 1):
                found.setdefault(word, []).append(at)
            for word, at in found.items():
                terms.append(word)
                places += at
                ends.append(len(places))
            of += [i] * len(found)
            if terms and (len(terms) >= PASSED or i + 1 == batch.num_rows):
                rows = batch.select([0, 1, 2]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), rows.column(2), rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))], names=names)
                terms, places, ends, of = [], [], [0], []


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of docs below a path: ``postings`` (bucket, term, block, id, copy, n, gain, places) and ``maxima`` (bucket, term, block, gain, docs).

    copy is a hash of the text: rows of one key and different texts are texts of their own, equal rows one text.
    Rows without a key, and null texts, are not indexed. Other columns are ignored.
    """
    size_class = F.floor(4 * F.log2(1 + F.octet_length("text"))).cast("int")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").withColumn("class", size_class)
    lengths = sorted(rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect(), key=lambda r: -r["class"])  # a row for each quarter of a power of two
    first, at = {}, 0
    for r in lengths:
        first[r["class"]] = (at, -(-r["n"] // BLOCK))
        at += first[r["class"]][1]
    buckets = int(min(BUCKETS, 1 + sum(r["bytes"] for r in lengths) // BUCKET_BYTES))
    known = lambda i: F.create_map(*(F.lit(x) for c, v in first.items() for x in (c, v[i])))[F.col("class")] if first else F.lit(1)
    block = (known(0) + F.pmod(F.xxhash64("id"), known(1))).cast("long")
    spread = F.floor(F.col("block") / SPREAD)
    grouped = rows.select("id", F.xxhash64("text").alias("copy"), block.alias("block"), T.tokens(F.col("text")).alias("words")).mapInArrow(_words, _WORDS)
    dealt = grouped.withColumn("bucket", _bucket(F.col("term"), spread, buckets)).repartition("bucket").sortWithinPartitions("bucket", "term", "block", "id", "copy")
    once = dealt.dropDuplicates(["bucket", "term", "block", "id", "copy"])  # equal rows are one text; neither shuffled nor sorted again
    whole = once.select("bucket", "term", "block", "id", "copy", F.size("places").alias("n"), "places").withColumn("gain", _gain("n"))
    whole.sortWithinPartitions("bucket", "term", "block", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = docs.sparkSession.read.schema(whole.schema).parquet(f"{path}/postings")
    best = postings.groupBy("bucket", "term", "block").agg(F.max("gain").alias("gain"), F.count("*").alias("docs"))
    best.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/maxima")
    return Index(postings, docs.sparkSession.read.schema(best.schema).parquet(f"{path}/maxima"), buckets, max(1, -(-at // SPREAD)))


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was written before."""
    postings, maxima = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/maxima")
    last, buckets = maxima.agg(F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.max("bucket"), F.lit(0)) + 1).first()
    return Index(postings, maxima, buckets, last // SPREAD + 1)


def asked(questions: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(q, term, k): the distinct keywords of each question, and how many it has. Rows of one key are one question; those without a key or a keyword ask nothing."""
    words = questions.select(F.col(key).cast("long").alias("q"), F.explode(T.keywords(F.col(text))).alias("term")).where("q is not null").distinct()
    return words.withColumn("k", F.count("*").over(Window.partitionBy("q")).cast("int"))


def _best(scored: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "copy"))  # each task keeps n of a question
    return scored.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def _every(index: Index, words: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """(q, id, copy, score) of the n best texts with all of a question's words. Places are read of such texts alone."""
    postings = index.of(index.postings, words)
    full = met.where("words = k").select("q", "block").join(words, "q")
    counted = postings.select("term", "block", "id", "copy").join(full, ["term", "block"]).groupBy("q", "k", "block", "id", "copy").agg(F.count("*").alias("c")).where("c = k").drop("c")
    whole = staged(counted, "every-word")
    placed = postings.select("term", "block", "id", "copy", "places", "gain").join(whole.join(words, ["q", "k"]), ["term", "block", "id", "copy"])
    found = placed.groupBy("q", "k", "id", "copy").agg(F.collect_list(F.struct(F.col("term").alias("t"), F.col("places").alias("p"))).alias("w"), F.sum("gain").alias("gain"))
    flat = found.withColumn("found", F.expr("array_sort(flatten(transform(w, x -> transform(x.p, i -> struct(i as i, x.t as t)))))"))
    score = F.when(F.col("k") < 2, F.col("gain") * (retrieval.WEIGHT / retrieval.ZETA2)).otherwise(retrieval.every_rank("found"))
    return _best(flat.select("q", "id", "copy", F.round(score, 6).alias("score")), n)


def _any(index: Index, words: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(q, id, copy, score) of the n best texts with any of a question's words in some blocks (q, block)."""
    wanted = blocks.select("q", "block").join(words, "q")
    gains = index.of(index.postings, words).select("term", "block", "id", "copy", "gain").join(wanted, ["term", "block"]).groupBy("q", "k", "id", "copy").agg(F.sum("gain").alias("gain"))
    return _best(gains.select("q", "id", "copy", F.round(F.col("gain") * (retrieval.WEIGHT / retrieval.ZETA2) / F.col("k"), 6).alias("score")), n)


def recall(index: Index, questions: DataFrame, n: int = retrieval.RECALL, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((query, id, score), (query, postings, visited)): for each question its n best texts, and how many postings its words have and how many of these were read.

    A question's texts are those with all of its words, or with any where none has all; scores are those of
    ``retrieval.keyword_recall``, ties go by id. The choice is made for each question on its own.
    """
    words = staged(asked(questions, key, text), "asked")
    gains = index.of(index.maxima, words).join(words, "term")
    bound = F.sum("gain") * (retrieval.WEIGHT / retrieval.ZETA2) / F.first("k")
    met = staged(gains.groupBy("q", "block").agg(bound.alias("bound"), F.count("*").alias("words"), F.first("k").alias("k"), F.sum("docs").alias("docs")), "bounds")
    every = staged(_every(index, words, met, n), "every-best")
    open_words = staged(words.join(every.select("q").distinct(), "q", "left_anti"), "open")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    ranked = met.join(open_words.select("q").distinct(), "q", "left_semi")
    seeds = staged(ranked.withColumn("_r", place).where(F.col("_r") <= SEEDS).select("q", "block"), "seeds")
    first = staged(_any(index, open_words, seeds, n), "first-best")
    least = first.groupBy("q").agg(F.when(F.count("*") == n, F.min("score")).otherwise(0.0).alias("least"))
    more = staged(ranked.join(seeds, ["q", "block"], "left_anti").join(least, "q").where(F.col("bound") + ROUNDING >= F.col("least")).select("q", "block"), "more")
    best = _best(first.unionByName(_any(index, open_words, more, n)).unionByName(every), n)
    visits = seeds.unionByName(more).unionByName(met.where("words = k").join(every.select("q").distinct(), "q", "left_semi").select("q", "block"))
    work = met.join(visits.withColumn("v", F.lit(True)), ["q", "block"], "left").groupBy(F.col("q").alias("query")).agg(F.sum("docs").alias("postings"), F.coalesce(F.sum(F.when(F.col("v"), F.col("docs"))), F.lit(0)).alias("visited"))
    return best.select(F.col("q").alias("query"), "id", "score"), work
