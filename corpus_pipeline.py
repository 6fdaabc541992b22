"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, packing, similar, suffix_dedup
from quillspark.llm.common import scratch, scratch_path, staged, table


#: Bytes that a repeated passage has at least, of the strings its anchors are chosen by, and the words that a cut run has at least. 99 of 100 passages of 51 words are longer.
PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS = 240, 60, 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and texts without a letter, or all if none could be learned."""
    net = langid.train(docs.where(~langid.held_out()))
    kept = langid.predict(docs, net, keep_text=True).where(F.col("_lang_pred") != langid.UNKNOWN)
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group linked at a similarity of 0.8 or more of five-word shingles."""
    return similar.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of PASSAGE bytes that repeat out of the texts, in runs of PASSAGE_WORDS words or more, as far as whole characters go; documents stay, n_chars follows."""
    return suffix_dedup.without_repeats(docs, span=PASSAGE, gram=PASSAGE_GRAM, words=PASSAGE_WORDS).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long"))).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Hashing, training and tokenizing aren't expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. A stage's scratch tables are removed when its rows are written, and the rows it read when it was the last to read them."""
    docs = table(spark, sf_dir, "documents")
    outputs: list[str] = []
    for name, stage in STAGES[:-1]:
        outputs.append(scratch_path(spark, name))
        with scratch(spark) as made:
            docs = staged(stage(spark, docs, sf_dir), name, outputs[-1])
            made += outputs[-2:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
