"""Filter audit, vector codes and the quality classifier: brute force, gradients, held-out labels, awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import filter_audit, quality, vector_codes
from quillspark.llm import queries as llm_queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, mask int, good int"


def plain_audit(docs, labels):
    """Every order applied to every row."""
    good = {k for k, q, _ in labels if q == 1} - {None}
    toxic = {k for k, _, t in labels if t == 1} - {None}
    fails = []
    for key, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A"} if len(words) < 50 else set()
        f |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if key is not None and any(k is not None and k < key and (t or "") == text for k, t, *_ in docs) else set()
        fails.append(f)
    parts = sorted({d[3] or "" for d in docs})
    out, removed_in_all = [], Counter()
    for part in parts:
        at = [i for i, d in enumerate(docs) if (d[3] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = set(at)
            for step, f in enumerate(order, 1):
                failing = {i for i in at if f in fails[i]}
                removed, redundant = failing & alive, failing - alive
                alive -= failing
                removed_in_all[part, f] += len(removed)
                keys = [docs[i][0] for i in removed]
                out.append([part, order, step, len(alive), len(removed), len(redundant), sum(fails[i] == {f} for i in at), sum(k in good for k in keys), sum(k in toxic for k in keys), (part, f)])
    return sorted((*r[:-1], removed_in_all[r[-1]]) for r in out)


def test_audit(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    texts = [None, "", " \t\n", "A", "#", "É" * 20 + "A", "A" + "b" * 18, "A" + "b" * 19, " ".join(["x"] * 60), " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50))]
    texts += [" ".join(word() for _ in range(r.randrange(20, 90))) + r.choice(["", " AB CD EF GH", " 100%", " |"]) for _ in range(30)]
    texts += [" ".join(["a b c d e f g h i j k l m"] * 5), " ".join(f"v{i}" for i in range(65)) + " v0" * 35, " ".join(f"v{i}" for i in range(64)) + " v0" * 36]
    docs = [(i, t, "en", None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}", 1, 7, 9) for i, t in enumerate(texts)]
    docs += [(100 + i, t, "en", "s1", 1, 7, 9) for i, t in enumerate([texts[12], texts[12], None, "A"])] + [docs[20]] * 2 + [(None, texts[12], None, "s1", None, None, None)] * 2 + [(None, None, None, None, None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(3, 0, 0), (5, None, None), (None, 1, 1), (101, 1, 1), (999, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain_audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 600 * len({d[3] or "" for d in docs})
    empty = spark.createDataFrame([], DOC)
    assert filter_audit.audit(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    some = filter_audit.audit(spark.createDataFrame(docs[:3], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, some.collect())) == plain_audit(docs[:3], [])


def plain_codes(rows, entries=256, rounds=4):
    """Lloyd's rounds in Python's integers."""
    ok = [(k, x, label) for k, x, label in rows if x and len(x) % 4 == 0 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(order[0][1])] if ok else []
    order = [r for r in order if len(r[1]) == len(order[0][1])] if ok else []
    ints = lambda x: [int(v) * 1024 if abs(v) > 2**60 else math.floor(v * 1024) for v in x]
    size = len(order[0][1]) // 4 if ok else 0
    cut = lambda x: [tuple(x[p * size : (p + 1) * size]) for p in range(4)]
    books = [[cut(ints(x))[p] for _, x, _ in order[:entries]] for p in range(4)]
    pieces = [cut(ints(x)) for _, x, _ in ok]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(piece[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(4)] for piece in pieces]

    for _ in range(rounds):
        now = assign()
        for p in range(4):
            for e in range(len(books[p])):
                mine = [pieces[i][p] for i in range(len(ok)) if now[i][p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    last = assign()
    error = [sum(d for d, _ in x) for x in last]
    by_label = Counter()
    for (_, _, label), e in zip(ok, error, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((k, "".join(f"{e:02x}" for _, e in x), str(err), str(by_label[label]), digest) for (k, _, label), x, err in zip(ok, last, error, strict=True)), key=str)


VEC = "vec_id long, embedding array<double>, label int, code string"


def shown(df):
    return sorted(((r["vec_id"], r["code"], str(r["error"]), str(r["label_error"]), r["codebooks_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", [0.5, 3e5, 1e9])
def test_codes(spark, monkeypatch, scale):
    """Also over many small blocks, with ties, repeats, odd vectors, and numbers that need longer integers."""
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    r = np.random.default_rng(4)
    centre = r.normal(size=(30, 8)) * scale
    vectors = [list(map(float, centre[i % 30] + r.normal(size=8) * scale * 0.3)) for i in range(300)]
    odd = [None, [], [1.0] * 7, [1.0] * 4, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("-inf")] + [0.0] * 7, [0.0] * 8, [-0.0005] * 8, vectors[3], vectors[3]]
    rows = [(i, v, None if i % 7 == 0 else i % 3, "x") for i, v in enumerate(vectors + odd)]
    rows += [rows[5], (None, vectors[9], None, None), (2, vectors[8], 1, "")]
    df = spark.createDataFrame(rows, VEC).repartition(5)
    few = lambda n: vector_codes.compress(df, entries=n)
    found, books, compared = few(20)
    want = plain_codes([(k, v, label) for k, v, label, _ in rows], 20)
    assert sorted((x["key"], x["code"], x["error"]) for x in found.where("key is not null").collect()) == sorted(w[:3] for w in want if w[0] is not None)
    assert hashlib.sha256(vector_codes.codebooks_text(books).encode()).hexdigest() == want[0][4]
    assert len(compared) == 4 and compared[0] == 4 * len(want)
    if scale == 0.5:
        assert shown(vector_codes.codes(df)) == plain_codes([(k, v, label) for k, v, label, _ in rows])


def test_codes_without_rows(spark):
    assert vector_codes.codes(spark.createDataFrame([], VEC)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1, ""), (2, [], 1, "")], VEC)).collect() == []
    one = [(7, [1.5, -2.0, 0.0, 0.25], 1, "")]
    assert shown(vector_codes.codes(spark.createDataFrame(one, VEC))) == plain_codes([(7, one[0][1], 1)])


def test_heaps_skip_what_cannot_change():
    """On clusters that have settled few pieces are compared again, and what is left alone is still right."""
    r = np.random.default_rng(6)
    values = vector_codes.integers(np.repeat(r.normal(size=(16, 8)) * 50, 100, axis=0) + r.normal(size=(1600, 8)) * 0.1)
    books = [c.copy() for c in np.split(values[::100], 4, axis=1)]
    block = vector_codes.Block(values, 16)
    sums, drift, compared = block.begin(books).astype(object), np.zeros((4, 16)), []
    for _ in range(4):
        books = vector_codes._updated(books, sums, drift)
        sums += block.go_on(books, drift)
        compared.append(block.rescanned)
        for p in range(4):
            assert (vector_codes.scanned(block.pieces[p], books[p])[0] == block.assigned[p]).all()
    assert compared[0] < 0.2 * 4 * 1600 and compared[-1] < 100


def test_large_components():
    x = np.array([[3e38, -3e38, 1e300, 2.0**60, -1e-300, 0.75, -5.5, 2.0**53]])
    assert vector_codes.integers(x).tolist() == [[int(v) * 1024 if abs(v) >= 2**53 else math.floor(v * 1024) for v in x[0].tolist()]]


def test_passages():
    for n in (0, 1, 511, 512, 513, 1024, 1025, 99_999):
        raw = bytes(i % 251 for i in range(n))
        cut = quality.passages_of(raw)
        assert b"".join(cut) == raw and len(cut) == max(1, -(-n // quality.PASSAGE)) and max(map(len, cut)) <= quality.PASSAGE and max(map(len, cut)) - min(map(len, cut)) <= 1


def test_features_stand_alone():
    """A passage's numbers don't depend on its neighbours."""
    r = random.Random(2)
    passages = [bytes(r.randrange(97, 105) for _ in range(n)) for n in (0, 1, 2, 5, 6, 100, 512)]
    together = quality.features(passages)
    for i, p in enumerate(passages):
        assert np.array_equal(together[i], quality.features([p])[0])


def test_attention_gradients():
    r = np.random.default_rng(1)
    net = quality.Attention({k: v.astype(np.float64) for k, v in quality.Attention.fresh().weights.items()})
    x = r.normal(size=(9, quality.FEATURES)) * 0.1
    first, y, weight = np.array([0, 2, 3]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        h, _, _, a = net.encoded(x)
        p = net.scores(h @ net.weights["score"], a, first)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    grads = net.gradients(x, first, y, weight)
    for k, w in net.weights.items():
        for at in [tuple(r.integers(0, n) for n in w.shape) for _ in range(6)]:
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_attention_finds_the_passage():
    """Only one passage of each bag tells the label; attention learns to weigh it."""
    r = random.Random(5)
    plain = lambda: bytes(r.choice(b"abcdefgh ") for _ in range(300))
    bags, y = [], []
    for i in range(200):
        passages = [plain() for _ in range(6)]
        if i % 2 == 0:
            passages[r.randrange(6)] = bytes(r.choice(b"#$%&*") for _ in range(300))
        bags.append(quality.features(passages))
        y.append(i % 2)
    net = quality.Attention.fresh().train(bags[:150], np.array(y[:150]))
    for bag, label in zip(bags[150:], y[150:], strict=True):
        h, _, _, a = net.encoded(bag)
        assert (net.scores(h @ net.weights["score"], a, np.array([0]))[0] > 0.5) == bool(label)


def test_quality_on_held_out_labels(spark):
    found = {r["doc_id"]: r for r in llm_queries.op12_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    labels = [(found[r["doc_id"]], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["doc_id"] in found]
    out = [(r["predicted"], q) for r, q in labels if r["held_out"]]
    assert len(out) > 60 and sum(p == q for p, q in out) >= 0.95 * len(out) and all(p for p, q in out if q)


def test_quality_awkward_rows(spark):
    rows = [(1, "fine words " * 30, "en"), (2, "#$%& " * 40, None), (3, None, "en"), (4, "", ""), (None, "é" * 5000, "x"), (2, "#$%& " * 40, None), (5, "tail " * 9000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (5, 1), (77, 0)], "doc_id long, quality int")
    open_keys = [k for k in (1, 2, 4, 5) if crc32(str(k).encode()) % 4 != 2]
    assert {1, 2} & set(open_keys)
    out = quality.score(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "_score"] and out.count() == len(rows) and out.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert quality.score(docs.where("false"), quality.train(docs, labels)).count() == 0
    assert [r["_score"] for r in quality.score(docs.limit(1), quality.train(docs, labels.where("false"))).collect()] == [0.5]
    assert [r["_score"] for r in quality.score(docs.limit(1), quality.train(docs, labels.where(F.col("quality") == 1))).collect()] == [1.0]
