"""The corpus operators against brute force and on awkward rows."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillspark.llm import decontaminate, embed_dedup, langid, lm_score, packing, sharding, simhash, similar, suffix_dedup, url_filter, warc
from quillspark.llm.graph import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows_of(texts, r=None):
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    """Copies, near copies, shared passages, nulls, empties, repeated rows, null keys, a long text."""
    r = random.Random(5)
    shared = words(r, 90)
    texts = [None, "", "   \n", "é!", "one", "one two", *(words(r, r.randrange(3, 300)) for _ in range(40))]
    texts += [texts[10]] * 3 + [texts[11] + " tail"] + [words(r, 30) + " " + shared + " " + words(r, 30) for _ in range(12)] + [words(r, 20000), "ab" * 3000]
    rows = rows_of(texts)
    return [*rows, rows[12], rows[12], (None, texts[13], None, None, None), (None, None, None, None, None)]


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def least(keys, root):
    low = {}
    for k, g in zip(keys, root, strict=True):
        if k is not None:
            low[g] = min(low.get(g, k), k)
    return [low.get(g) for g in root]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(150)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    expected = least(nodes, roots(len(nodes), [(at[a], at[b]) for a, b in edges]))
    assert got == {n: e for n, e in zip(nodes, expected, strict=True) if n != e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sharding(spark, docs):
    df = spark.createDataFrame(docs, DOC).withColumnRenamed("n_chars", "rank")
    out = sharding.interleave(df, 8, "source", "doc_id", ties=("text",)).collect()
    sizes = Counter(x["shard"] for x in out)
    assert len(out) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(sizes[s]))
        for source in ("s0", "s1", "s2", None):
            whole = sum(d[3] == source for d in docs)
            assert abs(sum(x["shard"] == s and x["source"] == source for x in out) - whole / 8) <= 2
    assert sharding.interleave(df.where("false"), 8, "source", "doc_id").count() == 0


def test_sharding_of_a_table_with_the_same_names(spark, docs):
    """An input column named like a result is replaced by it."""
    df = spark.createDataFrame(docs, DOC).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "slot")
    out = sharding.interleave(df, 4, "source", "doc_id", ties=("text",))
    assert sorted(out.columns) == ["doc_id", "shard", "slot", "source", "text"] and {x["shard"] for x in out.select("shard").collect()} == {0, 1, 2, 3}


def test_warc_of_awkward_tables(spark, tmp_path):
    """An empty table, and columns named like the operator's own over more than one block of a file."""
    schema = "page_id long, url string, html string, digest string, first string, block string, key string"
    warc.write_warc(spark.createDataFrame([], schema), f"file://{tmp_path}/none")
    assert warc.read_pages(spark, f"file://{tmp_path}/none").count() == 0
    r = random.Random(21)
    bodies = [warc.MAGIC + "".join(r.choices("abcdefgh ", k=300_000)) + warc.MAGIC + "Content-Length: 9\r\n\r\n" for _ in range(40)]
    rows = [(i, "u", bodies[i % 37], "d", "f", "b", "k") for i in range(70)]
    warc.write_warc(spark.createDataFrame(rows, schema).coalesce(1), f"file://{tmp_path}/big")
    got = {x["page_id"]: (x["payload_bytes"], x["record_type"], x["refers_to"], x["payload_digest"]) for x in warc.read_pages(spark, f"file://{tmp_path}/big").collect()}
    assert len(got) == 70
    for i in range(70):
        body = bodies[i % 37].encode()
        assert got[i] == (len(body), "response" if i < 37 else "revisit", None if i < 37 else i - 37, hashlib.sha256(body).hexdigest())


@pytest.mark.parametrize("block", [warc.BLOCK, 700])
def test_warc_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    r = random.Random(2)
    magic = warc.MAGIC
    payloads = ["", None, "x" * 99, "y" * 100, "z" * 5000, magic + "Content-Length: 5\r\n\r\nhello\r\n\r\n" + magic, magic * 40 + "é" * 200]
    rows = [(r.choice([i, i, None, 7]), r.choice(["http://a/\r\nb", None]), r.choice(payloads)) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    raw = [(k, (t or "").encode()) for k, _, t in rows]
    first, times = {}, Counter(b for _, b in raw)
    for k, b in raw:
        if len(b) >= 100 and k is not None:
            first[b] = min(first.get(b, k), k)
    expected = []
    for k, b in raw:
        to = first.get(b) if times[b] > 1 else None
        again = to is not None and k != to
        expected.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None))
    for size in ("128m", "900"):  # the second splits files inside records
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        path = f"file://{tmp_path}/{size}"
        warc.write_warc(df, path)
        got = warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def removed(raws, span):
    seen = Counter(hash(b[i : i + span]) for b in raws for i in range(len(b) - span + 1))
    for b in raws:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - span + 1):
            if seen[hash(b[i : i + span])] > 1:
                gone[i : i + span] = True
        yield bytes(np.frombuffer(b, dtype=np.uint8)[~gone]), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


@pytest.mark.parametrize("bucket", [4096, 3])
def test_suffix_dedup(spark, docs, bucket):
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOC + ", bucket string")
    rows = [(d[0], (d[1] or "").encode()) for d in docs]
    expected = sorted(((k, len(b), kept, n) for (k, b), (kept, n) in zip(rows, removed([b for _, b in rows], 400), strict=True)), key=str)
    got = suffix_dedup.remove_repeats(df, bucket=bucket).collect()
    assert sorted(((x["doc_id"], x["n_bytes"], bytes(x["kept"]), len(x["removed"])) for x in got), key=str) == expected
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def test_suffix_dedup_over_pieces(spark):
    """A text over two pieces, with copies across a piece's edge, in itself and elsewhere."""
    r = np.random.default_rng(4)
    long = bytearray(r.integers(97, 123, (1 << 20) + 9000, dtype=np.uint8))
    edge = 2 * suffix_dedup.PIECE
    long[3000:4000] = long[edge - 500 : edge + 500]
    texts = [bytes(long).decode(), bytes(long[edge - 700 : edge + 100]).decode(), bytes(long[edge + 1 : edge + 401]).decode(), bytes(long[2000:2399]).decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, kept, n) for i, (kept, n) in enumerate(removed([t.encode() for t in texts], 400))]
    assert sorted((x["doc_id"], bytes(x["kept"]), len(x["removed"])) for x in suffix_dedup.remove_repeats(df).collect()) == want


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_windows_survive_collisions(monkeypatch, collide):
    """Equal to brute force where the hashes are good, and where all strings of one length have the same hash."""
    if collide:
        monkeypatch.setattr(suffix_dedup, "_TABLE", np.ones(256, dtype=np.uint64))
    r = np.random.default_rng(6)
    span, base = 20, r.integers(97, 99, 400).astype(np.uint8).tobytes()
    offset, windows, contexts, group = [], [], [], []
    for _ in range(60):
        before, behind, at = r.integers(0, 12), r.integers(20, 32), r.integers(12, 300)
        contexts.append(base[at - before : at + behind])
        offset.append(before)
        windows.append(before + behind - span + 1)
        group.append(r.integers(0, 3))
    got = suffix_dedup.repeated_windows(contexts, np.array(group), np.array(offset), np.array(windows), span)
    seen = Counter((group[i], x, contexts[i][offset[i] - x : offset[i] - x + span]) for i in range(60) for x in range(max(0, offset[i] - windows[i] + 1), offset[i] + 1))
    for i in range(60):
        for x in range(got.shape[1]):
            possible = offset[i] - windows[i] < x <= offset[i]
            assert got[i, x] == (possible and seen[group[i], x, contexts[i][offset[i] - x : offset[i] - x + span]] > 1)


def test_suffix_order_is_exact():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 400)
    end = np.minimum(start + r.integers(0, 90, 400), 3000)
    group = r.integers(0, 9, 400)
    order, shared = suffix_dedup.suffix_order(data, group, start, end)
    want, extension = suffix_dedup._order_by_bytes(data, group, start, end)
    piece = lambda i: (group[i], data[start[i] : end[i]].tobytes())
    assert [piece(i) for i in order] == [piece(i) for i in want] and (shared == extension).all()
    assert suffix_dedup._verified(data, order, shared, start)


def test_packing(spark, docs):
    texts = ["a  b\n c", "\t x", "<|endoftext|> y", " 's", "漢 字 1 2"]
    df = spark.createDataFrame([*docs, *((9000 + i, t, None, None, None) for i, t in enumerate(texts))], DOC)
    out = packing.pack(df, keep_ids=True).collect()
    full = Tokenizer.from_file(public_tokenizers.path(packing.JSON))
    expected = Counter((d["doc_id"], tuple([*full.encode(d["text"] or "", add_special_tokens=False).ids, 0])) for d in df.collect())
    for p in out:
        assert p["ids_crc32"] == crc32(np.array(p["ids"], dtype="<u4").tobytes()) and len(p["ids"]) == p["length"] <= 2048
    single = {k: ids for k, ids in expected if sum(n for (x, _), n in expected.items() if x == k) == 1}
    for k, ids in single.items():
        pieces = sorted((p for p in out if p["doc_id"] == k), key=lambda p: p["piece"])
        assert [i for p in pieces for i in p["ids"]] == list(ids) and all(p["length"] == 2048 for p in pieces[1:])
    by = {}
    for p in out:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by.values():
        places.sort()
        assert all(a == sum(n for _, n in places[:i]) for i, (a, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
    assert packing.pack(df.where("false")).count() == 0


def test_packing_plan():
    r = random.Random(4)
    counts = Counter(min(2048, int(r.expovariate(1 / 700)) + 1) for _ in range(5000))
    plan = packing.packing_plan(counts)
    placed = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 2048
        for x in pattern:
            placed[x] += times
    assert placed == counts
    assert sum(t for _, t in plan) <= 1.01 * sum(k * n for k, n in counts.items()) / 2048 + 1


def test_langid(spark):
    r = random.Random(6)
    alphabet = {"aa": "abcdef ", "bb": "uvwxyz ", "cc": "éèàçab "}
    rows = [(i, "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(40, 900))), lang) for i, lang in enumerate(list(alphabet) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ..", None), (902, "", "bb"), (None, "uvw xyz zzyx", None)], "doc_id long, text string, lang string")
    net = langid.train(df.where(~langid.held_out()))
    got = {x["doc_id"]: x for x in langid.predict(df, net).collect()}
    assert all(got[k]["_lang_pred"] == "und" and got[k]["_score"] == 0 for k in (900, 901, 902))
    tested = [(i, lang) for i, _, lang in rows if crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["_lang_pred"] == lang for i, lang in tested) >= 0.95 * len(tested)
    assert langid.train(df.where("false")) is None
    assert {x["_lang_pred"] for x in langid.predict(df, None).collect()} == {"und"}


def test_langid_forward_passes_and_gradients():
    """Both forward passes agree, with a plain loop too, and the gradients are those of the loss."""
    r = np.random.default_rng(7)
    net = langid.ByteNet.fresh(["a", "b", "c"], 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, labels, weight = r.integers(0, 256, (5, 24)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 1.0])

    def logits(n):
        return np.tanh(n._pooled(windows)[0]) @ n.weights["out"] + n.weights["out_bias"]

    e = np.exp(logits(net))
    assert np.allclose(net.probabilities(windows), e / e.sum(axis=1, keepdims=True))
    embedded, at = net.weights["embedding"][windows[2]], 0
    for width in langid.WIDTHS:
        conv = net.weights[f"conv{width}"]
        plain = [max(embedded[i : i + width].ravel() @ conv[:, f] for i in range(24 - width + 1)) + net.weights[f"bias{width}"][f] for f in range(langid.FILTERS)]
        assert np.allclose(net._pooled(windows)[0][2, at : at + langid.FILTERS], plain)
        at += langid.FILTERS

    def loss():
        z = logits(net)
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -(weight * z[np.arange(5), labels]).sum() / 5

    grads = net._gradients(windows, labels, weight)
    for name, w in net.weights.items():
        for _ in range(6):
            place = tuple(r.integers(0, n) for n in w.shape) if name != "embedding" else (int(windows[r.integers(0, 5), r.integers(0, 24)]), int(r.integers(0, langid.EMBEDDED)))
            before, step = w[place], 1e-6
            w[place] = before + step
            up = loss()
            w[place] = before - step
            down = loss()
            w[place] = before
            assert abs((up - down) / (2 * step) - grads[name][place]) < 1e-5, name


def test_langid_sample(spark, monkeypatch):
    """The sample is the documents of the smallest hashed keys of each language, a language of few texts with letters among them."""
    rows = [(i, "uvw" if i % 3 else ("abc" if i % 30 == 0 else "123"), "aa" if i % 3 else "bb") for i in range(6000)]
    df = spark.createDataFrame([*rows, (None, "abc", "cc"), (7000, "abc", "dd")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid.ByteNet, "train", lambda net, windows, labels: seen.append((net.classes, np.bincount(labels).tolist(), windows)) or net)
    langid.train(df, docs_a_language=50)
    classes, counts, windows = seen[0]
    assert classes == ["aa", "bb", "dd"] and counts == [50, 50, 1]
    texts = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{i}", "aa") for i in range(3000)], "doc_id long, text string, lang string")
    langid.train(texts, docs_a_language=20)
    want = sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:20]
    assert sorted(w.tobytes().rstrip(b"\0") for w in seen[1][2]) == sorted(f"{chr(97 + i % 26)}{i}".encode() for i in want)


def test_langid_of_awkward_rows(spark):
    """Very long texts, repeated rows and columns named like the operator's own."""
    r = random.Random(8)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [(i, text("abcd " if i % 2 else "wxyz ", 200), "one" if i % 2 else "two", "x", 0.5) for i in range(120)]
    rows += [rows[3], rows[3], (500, text("abcd ", 1_500_000), "one", None, None), (501, text("wxyz ", 700_000), None, "y", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _letter string, rank double")
    out = langid.predict(df, langid.train(df)).collect()
    got = {x["doc_id"]: x["_lang_pred"] for x in out}
    assert len(out) == len(rows) and got[500] == "one" and got[501] == "two" and all(got[i] == ("one" if i % 2 else "two") for i in range(120))


def test_lm_score_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    df = spark.createDataFrame([(0, "a b c " * 300_000, 1, True), (1, "a b c", 2, None), (1, "a b c", 2, None)], "doc_id long, text string, block long, good boolean")
    out = {(x["doc_id"], x["n_tokens"]) for x in lm_score.cross_entropy_difference(df, labels).collect()}
    assert out == {(0, 900_001), (1, 4)}
    assert lm_score.cross_entropy_difference(df.where("false"), labels).count() == 0
    assert all(x["score"] is not None for x in lm_score.cross_entropy_difference(df, labels.where("false")).collect())


def plain_losses(rows, good):
    """Counts of both sides, the larger drawn from, without the document itself."""

    def tokens(t):
        split = "".join(f" {c} " if c in "北京," else c for c in t).split()
        return ["<", "<", *split, ">"]

    def counts(w):
        c = Counter(tuple(w[i - k + 1 : i + 1]) for i in range(2, len(w)) for k in (1, 2, 3))
        c.update([("<",), ("<", "<")])
        c["all"] += len(w) - 2
        return c

    docs = [(k, x, tokens(x), k in good) for k, x in rows if x is not None]
    own = [counts(w) for _, _, w, _ in docs]
    size = [sum(len(w) - 2 for _, _, w, g in docs if g == side) for side in (True, False)]
    rate = {True: size[1] / size[0] if size[0] else 0, False: size[0] / size[1] if size[1] else 0}
    role = [g if lm_score.drawn(k, x) < rate[g] else None for k, x, _, g in docs]
    both = {side: sum((c for c, r in zip(own, role, strict=True) if r == side), Counter()) for side in (True, False)}
    base = sum(own, Counter())

    def loss(i, side):
        w, c = docs[i][2], Counter(both[side])
        if role[i] == side:
            c.subtract(own[i])
        total = 0
        for x, y, z in zip(w, w[1:], w[2:], strict=False):
            p = (c[z,] + 4 * base[z,] / base["all"]) / (c["all"] + 4)
            p = (c[y, z] + 4 * p) / (c[y,] + 4)
            total -= math.log((c[x, y, z] + 4 * p) / (c[x, y] + 4))
        return total / (len(w) - 2)

    return [(k, len(w) - 2, loss(i, True), loss(i, False)) for i, (k, _, w, _) in enumerate(docs)] + [(k, 0, None, None) for k, x in rows if x is None], set(role)


@pytest.mark.parametrize("share, small", [(3, False), (3, True), (1.2, False)])
def test_lm_score(spark, monkeypatch, share, small):
    """Equal to plain counts over several blocks, whichever side is larger, and where the n-grams are dealt out in several passes; documents of the same words in another order score apart."""
    if small:
        for name, value in (("RADIX", 2), ("MERGED", 300), ("BUCKET", 40), ("BLOCK", 900)):
            monkeypatch.setattr(lm_score, name, value)
    r = random.Random(3)
    rows = [(i, words(r, r.randrange(1, 60), 30)) for i in range(40)] + [(2, None), (None, "w1 w2 w3"), (41, ""), (42, "北京 a_b c,d\n"), (0, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {int(i * share) for i in range(40) if i * share < 40}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(min(set(range(40)) - good), 0), (None, 1)], "doc_id long, quality int")
    want, roles = plain_losses(rows, good)
    assert roles == {True, False, None}
    order = lambda x: (x[0] is None, x[0] or 0, x["n_tokens"] if hasattr(x, "n_tokens") else x[1])
    got = lm_score.cross_entropy_difference(df, labels).collect()
    for x, y in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert (x["doc_id"], x["n_tokens"]) == y[:2] and (x["score"] is None) == (y[2] is None)
        assert y[2] is None or (abs(x["loss_target"] - y[2]) < 1e-9 and abs(x["loss_background"] - y[3]) < 1e-9)


def test_lm_score_by_order(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    same = [(0, "ab cd. ef gh. " * 5), (1, "ef cd. ab gh. " * 5), (2, "ab cd. ef gh. "), (3, "ef cd. ab gh. ")]
    apart = {x["doc_id"]: x["score"] for x in lm_score.cross_entropy_difference(spark.createDataFrame(same, "doc_id long, text string"), labels).collect()}
    assert apart[2] + 0.1 < apart[3]


def plain_fingerprint(text):
    b = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not b:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(b[i : i + 3]), 42) for i in range(max(1, len(b) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_simhash(spark, docs):
    df = spark.createDataFrame(docs, DOC).withColumnRenamed("lang", "fp")
    fps = [plain_fingerprint(d[1]) for d in docs]
    group = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    expected = Counter((d[0], f, c) for d, f, c in zip(docs, fps, least([d[0] for d in docs], group), strict=True))
    assert Counter((x["doc_id"], x["fp"] % (1 << 64), x["component"]) for x in simhash.simhash_components(df).collect()) == expected
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(group))
    assert simhash.simhash_components(df.where("false")).count() == 0


def test_simhash_links_by_grid(spark):
    r = random.Random(8)
    fps = []
    for _ in range(150):
        fps.append(r.getrandbits(64))
        for _ in range(3):
            fps.append(fps[-1] ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 5))))
    fps = sorted({f - (f >> 63 << 64) for f in [*fps, 0, 1, 7, 15]})
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want


def test_simhash_cells_are_not_broadcast(spark):
    """However small Spark takes the fingerprints' some fifty cells each to be, they don't pass through the driver."""
    found = simhash.links(spark.createDataFrame([(1,), (2,), (64,)], "fp long"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def plain_shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar(spark, docs):
    """Edited copies around, across and below the threshold, templates of which few link, and the awkward rows."""
    r = random.Random(9)

    def edited(text, n):
        w = text.split()
        for i in r.sample(range(len(w)), n):
            w[i] = f"x{r.random()}"
        return " ".join(w)

    texts = []
    for _ in range(6):
        base = words(r, r.choice([60, 240, 700]))
        texts += [base, base.upper(), base.replace(" ", "  "), *(edited(base, max(1, len(base.split()) * k // 240)) for k in range(1, 9) for _ in range(3))]
    template = words(r, 240)
    texts += [edited(template, 5) for _ in range(60)] + [edited(texts[-1], 2)]
    rows = [*docs, *((5000 + i, t, "en", "s", 1) for i, t in enumerate(texts)), (None, texts[0], None, None, None)]
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("lang", "kind")
    sets = [plain_shingles(d[1]) for d in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)  # noqa: E731  two empty sets are alike
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bool(sets[i]) == bool(sets[j]) and alike(sets[i], sets[j])])
    found = {}
    for x in similar.similar_components(df).collect():
        found.setdefault(x["root"], Counter())[x["doc_id"]] += 1
    want = {}
    for d, g in zip(rows, group, strict=True):
        want.setdefault(g, Counter())[d[0]] += 1
    fixed = lambda groups: sorted(sorted(c.items(), key=str) for c in groups.values())
    assert sorted(map(str, fixed(found))) == sorted(map(str, fixed(want)))
    kept = similar.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert similar.similar_components(df.where("false")).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://com/en/", "x.net/de/", None, "ftp://sub.example.net/de/80#f", "http://example.net/de/9", "s://o.org/es/", "http://bad.io/x", "http://bad.io/y", "http://new.bad.io/", "http://fine.uk/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.io/{i}", None) for i in range(60)] + [(300 + i, f"http://fine.uk/{i}", None) for i in range(60)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(100 + i, 1, 1) for i in range(60)] + [(300 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.filter_urls(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2][:3] == ("", "", None) and got[3][:3] == ("", "", None)
    assert got[4] == ("sub.example.net", "/de/80", "example.net/de/8", "block")
    assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7][3] == "block" and got[10][3] == "allow" and got[11][:2] == ("b:", "//c/d")
    assert len(got) == len(urls) + 120
    assert url_filter.filter_urls(pages.where("false"), labels).count() == 0


def plain_reputation(rows, labels):
    """Bounds of hosts by the formulas, level by level; rows are (host, labelled, bad)."""

    def parts(h):
        name = h.rsplit("@", 1)[-1].split(":")[0]
        p = name.split(".")
        k = 3 if ".".join(p[-2:]) in url_filter.SUFFIXES else 2
        return (name, "") if name.replace(".", "").isdigit() and len(p) == 4 else (".".join(p[-k:]), ".".join(p[-k + 1 :]))

    def add(keyed):
        out = {}
        for key, n, b in keyed:
            a = out.setdefault(key, [0, 0])
            a[0] += n
            a[1] += b
        return out

    host = add((h, int(known), int(bad)) for h, known, bad in rows)
    domain = add((parts(h), n, b) for h, (n, b) in host.items())
    suffix = add((d[1], n, b) for d, (n, b) in domain.items())
    n, b = sum(x for x, _ in suffix.values()), sum(x for _, x in suffix.values())

    def level(counts, prior):
        seen = sum(n * (b / n - prior[k]) ** 2 for k, (n, b) in counts.items() if n)
        sampling = sum(prior[k] * (1 - prior[k]) for k, (n, _) in counts.items() if n)
        whole = sum(n * prior[k] * (1 - prior[k]) for k, (n, _) in counts.items() if n)
        rho = (seen - sampling) / (whole - sampling) if whole > sampling else 0
        strength = 1000 if rho <= 0 else min(max(1 / rho - 1, 1), 1000)
        return strength, {k: (b + strength * prior[k]) / (n + strength) for k, (n, b) in counts.items()}

    _, means = level(suffix, dict.fromkeys(suffix, b / n if n else 0))
    _, means = level(domain, {d: means[d[1]] for d in domain})
    strength, means = level(host, {h: means[parts(h)] for h in host})
    return {h: m - (m * (1 - m) / (host[h][0] + strength + 1)) ** 0.5 for h, m in means.items()}


def test_url_reputation(spark):
    """Bounds equal a plain computation; ties at the threshold are allowed; empty labels and repeated rows."""
    r = random.Random(17)
    hosts = [f"{a}.{b}.{c}" for a in "abc" for b in ("x", "y", "z") for c in ("com", "co.uk", "net")] + ["10.0.0.1", "10.0.0.2:80", "u@x.com", "single"]
    rate = {h: r.random() for h in hosts}
    rows, marks = [], []
    for i in range(900):
        h = r.choice(hosts)
        bad = r.choice([None, int(r.random() < rate[h])])
        rows.append((i, f"http://{h}/{i}"))
        marks += [(i, 1, bad)] if bad is not None else []
    rows += [rows[0], rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    toxic = {i: t for i, _, t in marks}
    want = plain_reputation([(u.split("/")[2], i in toxic, toxic.get(i) == 1) for i, u in rows], marks)
    got = url_filter.filter_urls(pages, labels).collect()
    assert len(got) == len(rows) and len(set(want.values())) > 5
    for x in got:
        assert abs(x["bound"] - want[x["host"]]) < 1e-6
    assert {x["verdict"] for x in got} == {"allow", "block"}
    edge = sorted(want.values())[len(want) // 2]
    exact = {x["host"]: x["bound"] for x in got}
    edge = min(exact.values(), key=lambda b: abs(b - edge))
    assert {x["host"] for x in url_filter.filter_urls(pages, labels, threshold=edge).collect() if x["verdict"] == "block" and x["rule"] is None} == {h for h, b in exact.items() if b > edge}
    assert {x["verdict"] for x in url_filter.filter_urls(pages, labels.where("false")).collect()} == {"allow"}


def test_url_reputation_by_level(spark):
    """Of labelled pages a tenth is bad, but for one host, one registered domain and one suffix. What has no labels of its own follows its domain, or its suffix."""
    r = random.Random(21)
    rate = lambda h: 0.9 if h == "bad.mixed.com" or h.endswith("spam.net") or h.endswith(".zz") else 0.1
    labelled = ["bad.mixed.com", "good.mixed.com", *(f"h{i}.spam.net" for i in range(6)), *(f"w{i}.fine{i}.net" for i in range(10)), *(f"www.d{i}.zz" for i in range(12)), *(f"www.e{i}.com" for i in range(30)), *(f"www.f{i}.net" for i in range(30))]
    rows, marks = [], []
    for h in labelled:
        for _ in range(25):
            rows.append((len(rows), f"http://{h}/{len(rows)}"))
            marks.append((len(marks), int(r.random() < rate(h))))
    new = {"new.spam.net": "block", "new.mixed.com": "allow", "www.unheard.zz": "block", "www.unheard.com": "allow", "www.unheard.net": "allow", "other.org": "allow"}
    rows += [(10_000 + i, f"https://{h}/") for i, h in enumerate(new)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, toxic int"), rules=()).collect()
    verdict = {x["host"]: x["verdict"] for x in got}
    assert {h: v for h, v in verdict.items() if h in new} == new
    assert {h for h, v in verdict.items() if v == "block"} - set(new) == {h for h in labelled if rate(h) > 0.5}


def plain_leaks(texts, items):
    import re

    def shingles(t):
        w = [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    for i, t in enumerate(texts):
        s = shingles(t)
        for j, item in enumerate(items):
            want = Counter(m := shingles(item))
            for a in range(max(1, len(s) - len(m) + 1)):
                part = Counter(s[a : a + len(m)])
                if m and s and (part & want).total() >= 0.8 * (part | want).total() - 1e-12:
                    yield i, j
                    break


def test_decontaminate(spark):
    r = random.Random(9)
    items = [words(r, n, 300) for n in (12, 15, 38, 60, 3)] + ["", None]
    items.append(items[1])
    texts = [None, "", items[4], items[4].upper() + "!"]
    for item in items[:4]:
        w = item.split()
        for edits in (0, 1, 2, 3, 6):
            changed = list(w)
            for k in r.sample(range(len(w)), edits):
                changed[k] = "edited"
            texts.append(words(r, r.randrange(0, 80), 300) + " " + " ".join(changed) + " " + words(r, r.randrange(0, 80), 300))
        texts += [" ".join([*w[:7], "inserted", *w[7:]]), " ".join(w[: len(w) // 2])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, texts[6], "y")], "doc_id long, text string, item string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got if x["doc_id"] is not None} == set(plain_leaks(texts, items))
    long = spark.createDataFrame([(0, words(r, 150_000, 9000) + " " + items[2] + " " + words(r, 50_000, 9000), "x")], "doc_id long, text string, item string")
    assert [(x["item_id"], x["similarity"], x["start"]) for x in decontaminate.contaminated(long, benchmark).collect()] == [(2, 1.0, 150_000)]
    clean = decontaminate.decontaminate(docs, benchmark)
    bad = {i for i, _ in plain_leaks(texts, items)}
    assert sorted({x["doc_id"] for x in clean.where("doc_id is not null").collect()}) == [i for i in range(len(texts)) if i not in bad]
    assert decontaminate.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_decontaminate_index(spark):
    """The index finds all pairs of one size within the radius, those at its very edge too, and no others."""
    r = random.Random(12)
    items = [(i, i % 3, r.getrandbits(64)) for i in range(30)]
    prints = set()
    for _, m, fp in items:
        for bits in (0, 1, 12, 22, 23, 24, 25):
            prints.add((m, fp ^ sum(1 << k for k in r.sample(range(64), bits))))
    prints |= {(m, r.getrandbits(64)) for m in range(4) for _ in range(40)}
    signed = lambda x: x - (x >> 63 << 64)
    want = {(m, signed(fp), i) for m, fp in prints for i, n, item in items if m == n and (fp ^ item).bit_count() <= decontaminate.RADIUS}
    got = decontaminate.within_radius(spark.createDataFrame([(m, signed(fp)) for m, fp in prints], "m int, fp long"), spark.createDataFrame([(i, m, signed(fp)) for i, m, fp in items], "item long, m int, item_fp long"))
    assert {tuple(x) for x in got.select("m", "fp", "item").collect()} == want and len(want) > 100


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_embeddings_over_blocks(spark, spread):
    """Links within, across and between many blocks, some within a rounding of the threshold; in narrow data most pairs of intervals are skipped."""
    r = np.random.default_rng(13)
    base = r.normal(size=(500, 24)) * np.concatenate([[6, 4, 2], np.full(21, spread)])
    near = base[r.integers(0, 500, 300)]
    rows = np.concatenate([base, near + r.normal(size=near.shape) * 0.1 * spread, near * r.uniform(0.5, 2, (300, 1))])
    edge = np.zeros((3, 24))
    edge[0, 0] = edge[1, 0] = edge[2, 0] = 1
    edge[1, 3], edge[2, 3] = math.tan(math.acos(0.95)) * (1 - 1e-15), math.tan(math.acos(0.95)) * (1 + 1e-9)
    rows = np.concatenate([rows, edge])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    for i, j in zip(*np.nonzero(np.abs(unit @ unit.T - 0.95) < 1e-12), strict=True):
        x, y = rows[i], rows[j]
        linked[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= 0.95
    np.fill_diagonal(linked, False)
    ids = [int(x) for x in r.permutation(len(rows))]
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(linked), strict=True)]
    component = least(ids, roots(len(rows), pairs))
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x["vec_id"], x["n_links"], x["component"]) for x in embed_dedup.embedding_components(df, blocks=12, leaf=32).collect())
    assert got == sorted((ids[i], int(linked[i].sum()), component[i]) for i in range(len(rows)))


def test_embeddings_skip_distant_intervals():
    r = np.random.default_rng(14)
    x = np.cumsum(np.ones(2000)) / 100
    rows = np.stack([np.cos(x / 7), np.sin(x / 7), r.normal(size=2000) * 0.01], axis=1)
    order = np.argsort(rows[:, 0])
    body = (np.arange(2000).tobytes(), np.ones(2000, dtype=np.int64).tobytes(), rows[order].tobytes())
    join = embed_dedup._Join(np.eye(3)[:, :2], 0.95, body, body, True, 32)
    assert join.compared < 0.5 * 2000 * 2000 / 2 and len(join.result()[0]) == 2000


def test_embeddings(spark):
    r = np.random.default_rng(10)
    centre = r.normal(size=(20, 8))
    vectors = [list(map(float, c + r.normal(size=8) * s)) for c in centre for s in (0, 0, 0.1, 0.2, 0.3, 0.5, 0.5)]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 1) for i, v in enumerate([*vectors, *odd])] + [(3, vectors[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.95]
    degree = Counter(i for i, _ in pairs)
    component = least([x[0] for x in rows], roots(len(rows), pairs))
    got = sorted((x["vec_id"], x["n_links"], x["component"]) for x in embed_dedup.embedding_components(df).collect())
    assert got == sorted((rows[i][0], degree[i], component[i]) for i in range(len(rows)))
    assert embed_dedup.embedding_components(df.where("false")).count() == 0
