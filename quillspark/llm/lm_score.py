"""Scoring documents by cross-entropy difference.

Word trigram models of target and background, backing off to bigrams and words, are counted without any bound on
their size. The models are matched: of the target's documents and the others, the side with more words is drawn from by a hash of
the keys, at the rate that gives it as many words as the other side. Both share one vocabulary, the words of
the whole corpus with their frequencies, which either backs off to. A document's score is the mean over its words
of the target model's loss less the background model's; the lower, the more it is like the target.
A document's own n-grams are taken out of the counts it is scored by.

Documents are packed into blocks; a block's distinct n-grams, with their counts, are dealt out by
hash, summed over all blocks, and the sums sent back to the blocks that hold the n-gram. So nothing
is collected or broadcast, and an n-gram of every document is one row of a block, not one of each
document. A block sends at most 2 ** RADIX rows: where more buckets are needed, rows of one bucket are merged into blocks
of their own that are dealt out again by further bits, and the sums come back the same way, so the rows grow with the
corpus and not with its square. The blocks are a table bucketed by block, so the sums are shuffled to the
texts and the texts never.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, slices, staged

#: Weight of the next shorter context's estimate, in observations.
PRIOR = 4.0
#: Target keys broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Characters of text in a block, and for which one bucket of n-grams is summed; neither changes a score.
BLOCK = 6 << 20
BUCKET = 8 << 20
#: Bits by which n-grams are dealt out at once, and n-grams that are merged into a block for the next bits.
RADIX, MERGED = 13, 1 << 20
#: Scripts written without spaces, a word being a character there.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|[^\s]")
#: Bits of an n-gram's hash beyond those of the corpus's size in bytes, and at least: about one n-gram in 200,000 shares another's.
SPARE_BITS, LEAST_BITS = 16, 40
START, END, TOTAL = (np.uint64(x) for x in (1, 2, 3))


def _targets(labels: DataFrame) -> DataFrame:
    good = staged(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("key")).distinct(), "lm-targets")
    return F.broadcast(good) if good.count() <= BROADCAST_KEYS else good


def _shrunk(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers of ``width`` bytes byte plane by byte plane, compressed."""
    return pa.compress(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def _grown(raw: bytes, n: int, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=width * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel()


def drawn(key: int | None, text: str | None) -> float:
    """A number from 0 to 1 that decides whether a document is background: by its key, or by its text where it has none."""
    return int(hashlib.md5((text or "" if key is None else str(key)).encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / 2**32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as words, once: a block's documents (key, good, draw, n), the hashes of its distinct words, its words as numbers of these, and how many words to predict are in target documents and in others."""
    task, at, size = TaskContext.get().partitionId(), 0, 0
    rows: list[tuple] = []
    words: dict[str, int] = {}
    ids: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        docs = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.float64(), pa.int64()), strict=True)], names=["key", "good", "draw", "n"])
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        # Small numbers are kept for the marks.
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 4 for w in words), np.uint64, len(words))
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        sizes = [sum(n for _, good, _, n in rows if good == side) for side in (True, False)]
        row = [pa.array([(task << 32) | at], pa.int64()), pa.array([len(flat)], pa.int64()), *(pa.array([x], pa.int64()) for x in sizes), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), hashes.tobytes(), _shrunk(flat, 4)))]
        return pa.RecordBatch.from_arrays(row, names=["block", "n", "n_target", "n_rest", "docs", "words", "ids"])

    for batch in slices(batches):
        for key, text, good in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = WORD.findall(text) if text is not None else []
            rows.append((key, good, drawn(key, text), 0 if text is None else len(found) + 1))
            if found:
                ids.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found)))
            size += len(text or "")
            if size >= BLOCK:
                yield block()
                rows, words, ids, size, at = [], {}, [], 0, at + 1
    if rows:
        yield block()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _read(block: dict, bits: int, rates: tuple[float, float]):
    """A block's document keys, numbers of predicted words (0 for a null text), n-grams of orders 1, 2, 3 by position, and each position's role and document.

    A text stands as two start marks, its words and an end mark. The first mark has no n-grams,
    the second has none of order 3 (0 there): it is a context, but not predicted. Roles are 1 for target, 2 for background, else 0.
    """
    docs = pa.ipc.open_stream(block["docs"]).read_all()
    keys, n = docs.column("key").to_pylist(), docs.column("n").to_numpy()
    good = docs.column("good").to_numpy()
    role = np.where(docs.column("draw").to_numpy() < np.where(good, *rates), np.where(good, 1, 2), 0).astype(np.uint64)
    length = np.where(n > 0, n + 2, 0)
    ends = np.cumsum(length)[n > 0]
    first = ends - length[n > 0]
    x = np.zeros(int(length.sum()), dtype=np.uint64)
    x[first], x[first + 1], x[ends - 1] = START, START, END
    x[x == 0] = np.frombuffer(block["words"], dtype=np.uint64)[_grown(block["ids"], block["n"], 4)]
    one = _mixed(x * np.uint64(3) + np.uint64(1))
    two = _mixed(np.roll(one, 1) * np.uint64(5) + one)
    three = _mixed(np.roll(two, 1) * np.uint64(7) + one)
    orders = [k >> np.uint64(64 - bits) for k in (one, two, three)]
    for k in orders:
        k[first] = 0
    orders[2][first + 1] = 0
    return keys, n, orders, np.repeat(role, length), np.repeat(np.arange(len(n)), length)


COUNTS = ("a", "t", "b")


def _distinct(n: np.ndarray, orders: list, role: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted n-grams of a block, and their counts: ``a`` in all documents, of single words alone, ``t`` in those of the target, ``b`` of the background. TOTAL counts the predicted words."""
    x = np.sort(np.concatenate([((k << np.uint64(3)) | np.uint64(4 * (i == 0)) | role)[k > 0] for i, k in enumerate(orders)]))
    key = x >> np.uint64(3)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(key)).astype(np.int64) if len(key) else starts
    counts = []
    for marks in (x & np.uint64(4) > 0, x & np.uint64(3) == 1, x & np.uint64(3) == 2):
        upto = np.concatenate([[0], np.cumsum(marks.astype(np.int64))])
        counts.append(upto[ends] - upto[starts])
    key = key[starts]
    predicted = orders[2] > 0
    at = int(np.searchsorted(key, TOTAL))
    totals = (n.sum(), (predicted & (role == 1)).sum(), (predicted & (role == 2)).sum())
    return np.insert(key, at, TOTAL), [np.insert(c, at, int(v)) for c, v in zip(counts, totals, strict=True)]


def _dealt(block: int, grams: np.ndarray, counts: list[np.ndarray], bits: int, at: int, step: int, prefix: int = 0) -> Iterator[dict]:
    """A row for each bucket that holds some of a block's n-grams, which share their first ``at`` bits; buckets go by the next ``step``."""
    shift = np.uint64(bits - at - step)
    edges = np.append(np.searchsorted(grams, (np.arange(1 << step, dtype=np.uint64) + np.uint64(prefix << step)) << shift), len(grams))
    for k in np.flatnonzero(np.diff(edges)):
        i, z = edges[k], edges[k + 1]
        yield {"bucket": (prefix << step) + int(k), "block": block, "n": int(z - i), "grams": _shrunk(np.diff(grams[i:z], prepend=np.uint64(0))), **{c: _shrunk(v[i:z]) for c, v in zip(COUNTS, counts, strict=True)}}


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _sent(bits: int, step: int, rates: tuple[float, float]):
    """The rows that the blocks of texts deal out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                _, n, orders, role, _ = _read({c: batch.column(c)[i].as_py() for c in ("n", "docs", "words", "ids")}, bits, rates)
                yield from _batched(_dealt(block, *_distinct(n, orders, role), bits, 0, step), SENT)

    return run


_BINARY = pa.binary()
SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), *((c, _BINARY) for c in ("grams", *COUNTS))])
MERGE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), *((c, _BINARY) for c in ("grams", *COUNTS, "sources", "place"))])
BACK = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), *((c, _BINARY) for c in COUNTS)])
SCORED = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "double": "double", "binary": "binary"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of some rows, each row's places among them, and the sums of their counts."""
    keys = np.concatenate([np.cumsum(_grown(r["grams"], r["n"]), dtype=np.uint64) for r in rows])
    grams, place = np.unique(keys, return_inverse=True)
    del keys
    return grams, place, [np.bincount(place, weights=np.concatenate([_grown(r[c], r["n"]) for r in rows]), minlength=len(grams)).astype(np.uint64) for c in COUNTS]


def _summed(sent: pa.Table) -> pa.Table:
    """Sums of a bucket's n-grams over all blocks, for each block in the order it sent them."""
    rows = sent.to_pylist()
    _, place, totals = _joined(rows)
    ends = np.cumsum([r["n"] for r in rows])
    out = [{"block": r["block"], "bucket": r["bucket"], "n": r["n"], **{c: _shrunk(v[place[e - r["n"] : e]]) for c, v in zip(COUNTS, totals, strict=True)}} for r, e in zip(rows, ends, strict=True)]
    return pa.Table.from_pylist(out, schema=BACK)


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket as blocks of one bucket, of MERGED n-grams or a little more, that know where each came from."""
    task, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def block() -> pa.RecordBatch:
        grams, place, totals = _joined(held)
        sources = np.array([(r["block"], r["n"]) for r in held], dtype=np.int64)
        row = {"block": task + number, "bucket": held[0]["bucket"], "n": len(grams), "grams": _shrunk(np.diff(grams, prepend=np.uint64(0))), **{c: _shrunk(v) for c, v in zip(COUNTS, totals, strict=True)}, "sources": sources.tobytes(), "place": _shrunk(place, 4)}
        return pa.RecordBatch.from_pylist([row], schema=MERGE)

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["bucket"] != held[0]["bucket"] or size >= MERGED):
                yield block()
                held, size, number = [], 0, number + 1
            held.append(row)
            size += row["n"]
    if held:
        yield block()


def _dealt_again(bits: int, at: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = np.cumsum(_grown(row["grams"], row["n"]), dtype=np.uint64)
                yield from _batched(_dealt(row["block"], grams, [_grown(row[c], row["n"]) for c in COUNTS], bits, at, step, row["bucket"]), SENT)

    return run


def _in_order(back: pa.Table) -> list[np.ndarray]:
    """A block's sums, put together from its buckets."""
    back = back.sort_by("bucket")
    sizes = back.column("n").to_pylist()
    return [np.concatenate([_grown(raw.as_py(), m) for raw, m in zip(back.column(c), sizes, strict=True)]) for c in COUNTS]


def _returned(merged: pa.Table, back: pa.Table) -> pa.Table:
    """The sums of a merged block, for each of the blocks that it was made of."""
    row = merged.to_pylist()[0]
    totals = _in_order(back)
    sources = np.frombuffer(row["sources"], dtype=np.int64).reshape(-1, 2)
    ends = np.cumsum(sources[:, 1])
    place = _grown(row["place"], int(ends[-1]), 4)
    out = [{"block": int(b), "bucket": row["bucket"], "n": int(n), **{c: _shrunk(v[place[e - n : e]]) for c, v in zip(COUNTS, totals, strict=True)}} for (b, n), e in zip(sources, ends, strict=True)]
    return pa.Table.from_pylist(out, schema=BACK)


def _exchanged(sent: DataFrame, bits: int, parts: int, at: int) -> DataFrame:
    """(block, bucket, n, a, t, b): what blocks sent by their first ``at`` bits, summed over all blocks. ``parts`` bits make the buckets small enough."""
    if at >= parts:
        return sent.groupBy("bucket").applyInArrow(_summed, _ddl(BACK))
    merged = staged(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merging, _ddl(MERGE)), "lm-merged")
    step = min(RADIX, parts - at)
    back = _exchanged(merged.mapInArrow(_dealt_again(bits, at, step), _ddl(SENT)), bits, parts, at + step)
    return merged.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_returned, _ddl(BACK))


def _places(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted n-gram stands in sorted ones; sought in order, which is many times faster."""
    order, out = np.argsort(wanted), np.empty(len(wanted), dtype=np.int32)
    out[order] = np.searchsorted(grams, wanted[order])
    return out


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each position's n-gram stands in its own document."""
    pair = (doc.astype(np.int64) << 32) | place
    order = np.argsort(pair, kind="stable")
    sorted_ = pair[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(pair), dtype=np.int32)
    out[order] = np.repeat(np.diff(np.append(starts, len(pair))), np.diff(np.append(starts, len(pair))))
    return out


def _scored(docs: pa.Table, back: pa.Table, bits: int, rates: tuple[float, float]) -> pa.Table:
    """Losses of a block's documents by the counts of the whole corpus less their own."""
    keys, n, orders, role, doc = _read({c: docs.column(c)[0].as_py() for c in ("n", "docs", "words", "ids")}, bits, rates)
    grams, _ = _distinct(n, orders, role)
    everywhere, *models = _in_order(back)
    if len(everywhere) != len(grams):
        raise ValueError(f"{len(grams)} n-grams in the block, {len(everywhere)} counted")
    at = np.flatnonzero(orders[2])
    places = [_places(grams, k) for k in orders]
    own = [_own(doc, p) for p in places]
    del orders
    total_at = np.searchsorted(grams, TOTAL)
    base = everywhere[places[0][at]].astype(np.float64) / float(everywhere[total_at])
    some = n[n > 0]
    losses = []
    for side, count in enumerate(models, 1):
        count, mine = count.astype(np.float64), role[at] == side
        left = lambda order, i: count[places[order][i]] - np.where(mine, own[order][i], 0)  # noqa: B023, E731
        p1 = (left(0, at) + PRIOR * base) / (count[total_at] - np.where(mine, n[doc[at]], 0) + PRIOR)
        p2 = (left(1, at) + PRIOR * p1) / (left(0, at - 1) + PRIOR)
        p3 = (left(2, at) + PRIOR * p2) / (left(1, at - 1) + PRIOR)
        mean = np.zeros(len(n))
        mean[n > 0] = (np.add.reduceat(-np.log(p3), np.cumsum(some) - some) if len(some) else np.zeros(0)) / some
        losses.append(pa.array(mean, mask=n == 0))
    return pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array(n), *losses], schema=SCORED)


def _word_scores(bits: int, rates: tuple[float, float]):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        return _scored(docs, back, bits, rates)

    return run


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """blocks written to the shared folder in buckets of ``block``: a group of it needs no shuffle."""
    spark, name = blocks.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").bucketBy(buckets, "block").option("path", scratch_path(spark, "lm-blocks")).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the files are scratch like any other, and the plan knows them
    return found


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, score (target less background), loss_target, loss_background, n_tokens.

    labels: (doc_id, quality); a document is a target if any label of its key has quality 1. A null
    text has no tokens and null losses; an empty one has the end mark alone. Rows with null keys
    are no targets. Other columns are ignored, an empty table gives an empty one.

    A token is a run of letters, digits and underscores, a character of a script written without
    spaces, or any other character but a space; case counts. Each order gives the next shorter one
    PRIOR observations, down to words; both word models give them to the frequencies of the whole corpus, so
    where one side has no document, either model is these and all scores are 0. The side of fewer words is counted whole; of the
    other, the documents whose ``drawn`` number is below the share of words that it may have. A model without
    the document itself scores a document that it was counted from; its words stay in the shared frequencies.
    """
    rows = bounded_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(50, max(LEAST_BITS, int(size).bit_length() + SPARE_BITS))
    parts = max(3, int(size // BUCKET).bit_length())
    flagged = rows.join(_targets(labels).withColumn("good", F.lit(True)), "key", "left").select("key", "text", F.coalesce("good", F.lit(False)).alias("good"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (4 * BLOCK))
    packed = _bucketed(flagged.mapInArrow(_blocks, "block long, n long, n_target long, n_rest long, docs binary, words binary, ids binary"), min(buckets, 100_000))
    target, rest = (int(x or 0) for x in packed.agg(F.sum("n_target"), F.sum("n_rest")).first())
    step = min(RADIX, parts)
    rates = (min(1.0, rest / target) if target else 0.0, min(1.0, target / rest) if rest else 0.0)
    back = _exchanged(packed.mapInArrow(_sent(bits, step, rates), _ddl(SENT)), bits, parts, step)
    found = packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_word_scores(bits, rates), _ddl(SCORED))
    return found.select(F.col("key").alias(key), (F.col("loss_target") - F.col("loss_background")).alias("score"), "loss_target", "loss_background", "n_tokens")
