"""Learned dictionaries and the path over the graph of words."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import segmentation as S
from quillspark.sources.scratch import staged


def plain_path(run, words):
    """Of all cuts the one of the largest weight, by trying each."""
    if not run:
        return 0.0, []
    floor = min(words.values()) - 10
    options = [(words.get(run[:k], floor if k == 1 else None), k) for k in range(1, len(run) + 1)]
    return max(((w + plain_path(run[k:], words)[0], [run[:k], *plain_path(run[k:], words)[1]]) for w, k in options if w is not None), key=lambda x: x[0])


def test_best_path():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))): -r.random() * 9 for _ in range(25)} | {"a": -3.1, "b": -3.2}
    for _ in range(60):
        run = "".join(r.choice("abcd") for _ in range(r.randrange(0, 10)))
        got = S.best_path(run, words, 4)
        floor = min(words.values()) - 10
        assert "".join(got) == run and math.isclose(sum(words.get(w, floor) for w in got), plain_path(run, words)[0], abs_tol=1e-9)
    assert S.best_path("xyz", {}, 1) == ["x", "y", "z"]


def test_counts_and_candidates(spark):
    """Counts, cohesion and freedom equal plain loops."""
    r = random.Random(5)
    vocabulary = ["索引", "失效", "常见", "场景", "数据库", "的", "和", "在"]
    texts = ["".join(r.choice(vocabulary) for _ in range(12)) + r.choice(["。", ",x", ""]) + r.choice(vocabulary) for _ in range(80)] + [None, "", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = staged(S.gram_counts(docs, S.unspaced_runs(F.col("text"))), "counts")
    runs = [S.BEGIN + x + S.END for t in texts if t for x in "".join(c if "一" <= c <= "鿿" else " " for c in t).split()]
    want = Counter(x[i : i + n] for x in runs for i in range(len(x)) for n in range(1, 6) if i + n <= len(x))
    assert {x["gram"]: x["n"] for x in counts.collect()} == want
    total = sum(n for g, n in want.items() if len(g) == 1 and g not in (S.BEGIN, S.END))
    entropy = lambda c: -sum(n / sum(c) * math.log(n / sum(c)) for n in c)
    expect = {}
    for g, n in want.items():
        if 2 <= len(g) <= 4 and n >= 5 and not {S.BEGIN, S.END} & set(g):
            cohesion = min(math.log(n * total / (want[g[:k]] * want[g[k:]])) for k in range(1, len(g)))
            sides = [[m for x, m in want.items() if len(x) == len(g) + 1 and cut(x) == g] for cut in (lambda x: x[:-1], lambda x: x[1:])]
            expect[g] = (n, round(cohesion, 6), round(min(map(entropy, sides)), 6))
    assert {x["word"]: (x["n"], round(x["cohesion"], 6), round(abs(x["freedom"]), 6)) for x in S.candidates(counts).collect()} == {g: (n, c, abs(f)) for g, (n, c, f) in expect.items()}
    words = S.dictionary(counts)
    assert {"索引", "失效", "常见", "场景", "数据库"} <= set(words)
    held = spark.createDataFrame([(1, "索引失效的常见场景"), (2, None), (3, "数据库x索引")], "doc_id long, text string")
    assert {x["doc_id"]: x["words"] for x in S.segmented(held, S.unspaced_runs(F.col("text")), words).collect()} == {1: ["索引", "失效", "的", "常见", "场景"], 2: [], 3: ["数据库", "索引"]}


def test_held_out_boundaries(spark):
    """Words are found back in held-out texts whose spaces are removed, far better than by cutting at every character."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randrange(3, 8))) for _ in range(120)]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (i + 5) for i in range(120)], k=60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = staged(S.gram_counts(docs.where("doc_id % 5 <> 0"), S.joined_runs(F.col("text")), 9), "counts")
    # Words that merely follow each other cohere by about the logarithm of a word's length, five letters here.
    first = S.dictionary(counts, 9, cohesion=0.3 + math.log(5))
    words = S.refined(docs.where("doc_id % 5 <> 0"), S.joined_runs(F.col("text")), first)
    held = docs.where("doc_id % 5 = 0")
    given = held.select("doc_id", F.split("text", " ").alias("words"))
    score = S.boundary_score(S.segmented(held, S.joined_runs(F.col("text")), words), given).first()
    letters = S.boundary_score(S.segmented(held, S.joined_runs(F.col("text")), {}), given).first()
    before = S.boundary_score(S.segmented(held, S.joined_runs(F.col("text")), first), given).first()
    assert score["precision"] >= before["precision"] > 0.6 and score["precision"] > 0.7 and score["recall"] > 0.8, (before, score)
    assert letters["precision"] < 0.05


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    counts = staged(S.gram_counts(none, S.unspaced_runs(F.col("text"))), "counts")
    assert S.dictionary(counts) == {} and S.segmented(none, S.unspaced_runs(F.col("text")), {}).count() == 0
