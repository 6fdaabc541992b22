"""The pipeline, stage by stage and as a whole."""

import os
import random
from collections import Counter

import corpus_pipeline
from quillspark.llm.common import shared_dir, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "some words", "en", "s", 10), (2, None, None, None, None)], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert [x["doc_id"] for x in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()] == [1]


def test_stages(spark, tmp_path):
    r = random.Random(11)
    text = lambda n: " ".join(f"word{r.randrange(5000)}" for _ in range(n))
    leak, shared = text(40), text(120)
    texts = [text(100) for _ in range(30)]
    texts += [texts[0], texts[0], None, "123 !!", text(30) + " " + leak + " " + text(30), text(40) + " é" + shared, text(40) + shared]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, str(tmp_path)), name)
        assert now.columns == COLUMNS
        ids.append(Counter(x["doc_id"] for x in now.collect()))
    everything = Counter(range(len(texts))) + Counter([3])
    assert ids[0] == everything - Counter([32, 33])
    assert ids[1] == Counter(set(ids[0]) - {30, 31})
    assert ids[2] == ids[1]
    assert ids[3] == ids[2] - Counter([34])
    left = {x["doc_id"]: x for x in now.collect()}
    assert shared not in left[35]["text"] and shared not in left[36]["text"] and left[5]["text"] == texts[5]
    assert left[35]["n_chars"] == len(left[35]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(left)


def test_scratch_is_removed(spark, tmp_path):
    """Of all that the stages wrote only the last one's input and the last one's own tables are left."""
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 20, "en", "s", 10) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 8
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before} == {"decontamination", "pieces", "piece-sizes"}
