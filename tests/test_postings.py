"""The inverted index and search for many questions, against the search of one question at a time and against plain loops."""

import math
import random
import re

import pyarrow as pa
import pytest

from quillspark.functions import text as T
from quillspark.operators import postings, retrieval
from quillspark.plans import catalog

STOP = set(T.STOP_WORDS)


def plain_recall(docs, questions, n):
    """Ranks of every text for every question."""
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts = sorted({(k, t) for k, t in docs if k is not None and t is not None})
    out = []
    for q in sorted({k for k, t in questions if k is not None}):
        words = {w for k, t in questions if k == q and t for w in tokens(t) if len(w) > 1 and w not in STOP}
        hits = []
        for key, text in texts:
            places = [(i, w) for i, w in enumerate(tokens(text)) if w in words]
            kinds = {w for _, w in places}
            if not kinds:
                continue
            every = kinds == words
            score = sum(sum(1 / j**2 for j in range(1, sum(x == w for _, x in places) + 1)) for w in kinds) * 0.1 / 1.64493406685 / len(words)
            if every and len(words) > 1:
                rest = 1.0
                for i, w in places:
                    for j, x in places:
                        if x < w and abs(i - j) <= 100:
                            rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(i - j) / 1.5 - 2)))
                score = 1 - rest
            hits.append((not every, -round(score, 6), key))
        if any(not h[0] for h in hits):
            hits = [h for h in hits if not h[0]]
        out += [(q, key, -score) for _, score, key in sorted(hits)[:n]]
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 300}"  # noqa: E731  a few words are in nearly every text
    docs = [(i, " ".join(word() for _ in range(r.choice([5, 20, 60, 400])))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "w1 w2 w3"), (3, docs[3][1]), (7, "w250 w251 other text of one key"), (600, "W1 w1 " * 900), (601, "alpha beta " * 3 + "gamma"), (602, "gamma " * 70 + "alpha beta")]
    questions = [(q, " ".join(word() for _ in range(r.randrange(1, 9)))) for q in range(0, 500, 50)] + [(1000, "w1"), (1050, "alpha gamma the of"), (1100, "nowhere"), (1150, ""), (1200, None), (None, "w1"), (1250, "beta"), (1250, "gamma")]
    return docs, questions


@pytest.mark.parametrize("block, seeds", [(64, 4), (3, 1)])
def test_many_questions(spark, tmp_path, monkeypatch, corpus, block, seeds):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SEEDS", seeds)
    monkeypatch.setattr(postings, "SPREAD", 16)
    monkeypatch.setattr(postings, "BUCKET_BYTES", 20_000)
    docs, questions = corpus
    postings.build(spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, term int").repartition(3), str(tmp_path / "i"))
    index = postings.opened(spark, str(tmp_path / "i"))
    got, work = postings.recall(index, spark.createDataFrame(questions, "item_id long, text string"), 10)
    want = plain_recall(docs, questions, 10)
    rounded = lambda rows: sorted((q, k, round(s, 5)) for q, k, s in rows)
    assert rounded(map(tuple, got.collect())) == rounded(want) and len(want) > 80
    visits = {r["query"]: (r["postings"], r["visited"]) for r in work.collect()}
    assert all(v <= p for p, v in visits.values())
    if block == 3:
        assert sum(v for _, v in visits.values()) < 0.8 * sum(p for p, _ in visits.values())


def test_as_one_question_at_a_time(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(4)
    got, _ = postings.recall(postings.build(docs, str(tmp_path / "i")), items, 20)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).append((r["id"], round(r["score"], 5)))
    for item in items.select("item_id", T.keywords(items["text"]).alias("w")).collect():
        assert sorted(found[item["item_id"]]) == sorted((r["id"], round(r["score"], 5)) for r in retrieval.keyword_recall(docs, item["w"], 20).collect())


def test_empty_index_and_no_questions(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert postings.recall(postings.build(empty, str(tmp_path / "a")), items)[0].count() == 0
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert postings.recall(postings.build(docs, str(tmp_path / "b")), items.where("false"))[0].count() == 0


def test_many_questions_fused_and_cut(spark):
    row = "query long, id long, score double"
    dense = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (2, 10, 0.4)], row)
    sparse = spark.createDataFrame([(1, 11, 0.05), (2, 12, 0.07), (3, 12, 0.01)], row)
    fused = {(r["query"], r["id"]): (r["score"], r["rrf"]) for r in retrieval.fuse(dense, sparse, by="query").collect()}
    assert fused[1, 11] == (0.2, round(0.7 / 62 + 0.3 / 61, 9)) and fused[3, 12] == (0.01, round(0.3 / 61, 9)) and len(fused) == 5
    top = retrieval.top_k(retrieval.fuse(dense, sparse, by="query"), 1, 0.05, by="query")
    assert sorted((r["query"], r["id"]) for r in top.collect()) == [(1, 10), (2, 10)]


def test_places_of_a_word_travel_together():
    """A text gives a row for each of its words, not for each place."""
    columns = [pa.array([1, 2, 3]), pa.array([7, 8, 9]), pa.array([0, 0, 1]), pa.array([["a", "b", "a"], [], ["b"]])]
    rows = [r for b in postings._words(iter([pa.RecordBatch.from_arrays(columns, names=["id", "copy", "block", "words"])])) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in rows] == [("a", 0, 1, 7, [1, 3]), ("b", 0, 1, 7, [2]), ("b", 1, 3, 9, [1])]


def test_every_item_asks(spark, tmp_path):
    """Items whose ids 50 does not divide are questions too: 1 by its vector, 7 by its words alone, 51 by neither, 50 by both."""
    rows = {
        "documents": ([(1, "red " * 30), (2, "alpha beta " * 30), (3, "gamma delta " * 30)], "doc_id long, text string"),
        "embeddings": ([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (50, [0.6, 0.8]), (9, [-1.0, 0.0])], "vec_id long, embedding array<float>"),
        "benchmark": ([(1, "nowhere"), (7, "alpha beta"), (50, "gamma delta"), (51, "unheard")], "item_id long, text string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r["query"], r["id"], round(r["score"], 4)) for r in catalog.queries()["hybrid_topk_many"](spark, str(tmp_path)).collect())
    by_words = {(q, k): round(s, 4) for q, k, s in plain_recall(rows["documents"][0], rows["benchmark"][0], 20)}
    assert got == sorted([(1, 1, 1.0), (1, 50, 0.6), (7, 2, by_words[7, 2]), (50, 1, 0.6), (50, 2, 0.8), (50, 3, by_words[50, 3]), (50, 50, 1.0)])
