"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of which only the bag is labelled. Each passage of its bytes is encoded by a
small layer over byte counts, counts of hashed pairs and how much of it repeats; a gated attention, a tanh
layer times a sigmoid one, weighs the passages, its weights learned from the documents' labels alone; the
weighted mean of the encodings is scored by a logistic unit. Trained here, in numpy, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, staged

#: Bytes of a passage at most; a text is cut into the fewest such passages, all about as long.
PASSAGE = 512
#: Cells that byte pairs are hashed to, and in which a passage's distinct runs of 3 and 6 bytes are counted.
PAIRS, RUNS = 512, {3: 1024, 6: 2048}
FEATURES = 256 + PAIRS + len(RUNS) + 1
ENCODED, ATTENTION = 16, 8
#: The training sample: at most so many documents of a label, and passages of each, spread evenly.
DOCS_A_LABEL, PASSAGES_A_DOC = 1000, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 32, 0.005, 1e-4, 12
THRESHOLD = 0.7


def passages_of(raw: bytes) -> list[bytes]:
    """All bytes in as few passages as there can be, of nearly equal lengths; an empty text is one empty passage."""
    n = max(1, -(-len(raw) // PASSAGE))
    edges = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def features(passages: list[bytes]) -> np.ndarray:
    """A row of FEATURES numbers for each passage."""
    count = len(passages)
    size = np.array([len(p) for p in passages])
    flat = np.frombuffer(b"".join(passages), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(count), size)
    share = 1 / np.maximum(size, 1)[:, None]
    out = [np.sqrt(np.bincount(owner * 256 + flat, minlength=count * 256).reshape(count, 256) * share)]

    def hashed(width: int, cells: int) -> np.ndarray:
        n = len(flat) - width + 1
        if n <= 0:
            return np.zeros((count, cells), dtype=np.int64)
        run = np.zeros(n, dtype=np.int64)
        for i in range(width):
            run = run * 257 + flat[i : i + n]
        inside = owner[:n] == owner[width - 1 :]
        cell = (run * 0x9E3779B1 & 0xFFFFFFFF) >> 8 & (cells - 1)
        return np.bincount((owner[:n] * cells + cell)[inside], minlength=count * cells).reshape(count, cells)

    out.append(np.sqrt(hashed(2, PAIRS) * share))
    for width, cells in RUNS.items():
        kinds = (hashed(width, cells) > 0).sum(axis=1)
        out.append((kinds / np.maximum(size - width + 1, 1))[:, None])
    out.append(np.log1p(size)[:, None] / np.log1p(PASSAGE))
    return np.concatenate(out, axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """The network, or a constant share where there weren't two labels to tell apart."""

    weights: dict[str, np.ndarray]
    share: float | None = None

    @classmethod
    def fresh(cls, seed: int = SEED) -> Attention:
        r = np.random.default_rng(seed)
        shapes = {"encode": (FEATURES, ENCODED), "tanh": (ENCODED, ATTENTION), "gate": (ENCODED, ATTENTION), "attend": (ATTENTION,), "score": (ENCODED,)}
        w = {k: r.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()} | {"encode_bias": np.zeros(ENCODED), "score_bias": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(encoding, tanh layer, gate, attention before the softmax) of passages."""
        h = np.tanh(x @ self.weights["encode"] + self.weights["encode_bias"])
        t, g = np.tanh(h @ self.weights["tanh"]), _sigmoid(h @ self.weights["gate"])
        return h, t, g, (t * g) @ self.weights["attend"]

    def scores(self, h_score: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of bags whose passages begin at ``first``: h_score is the score of each encoding, a its attention."""
        size = np.diff(np.append(first, len(a)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, first), size))
        return _sigmoid(np.add.reduceat(e * h_score, first) / np.add.reduceat(e, first) + float(self.weights["score_bias"][0]))

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy of some bags."""
        w = self.weights
        size = np.diff(np.append(first, len(x)))
        h, t, g, a = self.encoded(x)
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, first), size))
        alpha = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        d = weight * (_sigmoid(z @ w["score"] + w["score_bias"]) - labels) / len(labels)
        back = np.repeat(d, size)[:, None] * w["score"]
        along = (back * h).sum(axis=1)
        da = alpha * (along - np.repeat(np.add.reduceat(alpha * along, first), size))
        dt, dg = da[:, None] * w["attend"] * g * (1 - t * t), da[:, None] * w["attend"] * t * g * (1 - g)
        dh = (alpha[:, None] * back + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
        return {"encode": x.T @ dh, "encode_bias": dh.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ da, "score": z.T @ d, "score_bias": d.sum(keepdims=True)}

    def train(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Attention:
        """Adam with weight decay; both labels weigh the same."""
        r = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=2)
        weight = (len(labels) / (2 * np.maximum(counts, 1)))[labels].astype(np.float32)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                sizes = np.array([len(bags[i]) for i in some])
                grads = self.gradients(np.concatenate([bags[i] for i in some]), np.cumsum(sizes) - sizes, labels[some], weight[some])
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (RATE * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + DECAY * self.weights[k])).astype(np.float32)
        return self


def held_out(key: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PASSAGES_A_DOC passages spread evenly over each text."""
    for batch in slices(batches):
        rows = []
        for key, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            whole = passages_of(text.encode("utf-8", "surrogatepass"))
            rows += [(key, label, i, whole[i]) for i in sorted({int(x) for x in np.linspace(0, len(whole) - 1, PASSAGES_A_DOC)})]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["key", "label", "at", "passage"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", docs_a_label: int = DOCS_A_LABEL) -> Attention:
    """A network fitted to labels (doc_id, quality) of keys that aren't held out.

    A key counts as 1 if any of its labels is. It sees a bounded sample: of each label the docs_a_label keys of the
    smallest hash, of a key's texts the least, and PASSAGES_A_DOC passages of each. Labels of null keys, null labels and those without a
    document teach nothing. Where both labels aren't met, the score is the share of ones, 0.5 if there is none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marks = known.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max((F.col(label) == 1).cast("int")).alias("label")).withColumn("hash", F.md5(F.col("key").cast("string")))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, n in sorted(counts.items()):
        # Hashes below a bound are enough with near certainty, so the ordered rows don't grow with the table.
        share = min(1.0, (docs_a_label + 10 * docs_a_label**0.5 + 100) / n)
        low = marks.where((F.col("label") == value) & (F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / 2**32 <= share))
        best = low.orderBy("hash").limit(docs_a_label).select("key", "label")
        chosen = best if chosen is None else chosen.unionAll(best)
    if chosen is None:
        return Attention({}, 0.5)
    chosen = staged(chosen, "quality-sample")  # at most docs_a_label keys of either label
    texts = bounded_batches(docs).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_sampled, "key long, label int, at long, passage binary").collect()
    rows.sort(key=lambda r: (r["key"], r["at"]))
    bags: dict[int, tuple[int, list[bytes]]] = {}
    for r in rows:
        bags.setdefault(r["key"], (r["label"], []))[1].append(bytes(r["passage"]))
    y = np.array([b[0] for b in bags.values()], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Attention({}, float(y.mean()) if len(y) else 0.5)
    return Attention.fresh().train([features(b[1]) for b in bags.values()], y)


def _scored(net: Attention, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last = batch.num_columns - 1
            first, load, a, v = [], [], [], []

            def encode() -> None:
                h, _, _, attention = net.encoded(features(load))
                a.append(attention.astype(np.float64))
                v.append((h @ net.weights["score"]).astype(np.float64))
                load.clear()

            n = 0
            for text in batch.column(last).to_pylist():
                first.append(n)
                for p in passages_of((text or "").encode("utf-8", "surrogatepass")):
                    load.append(p)
                    n += 1
                    if len(load) == step:
                        encode()
            if load:
                encode()
            score = net.scores(np.concatenate(v), np.concatenate(a), np.array(first)) if first else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(score, pa.float64())], names=[*batch.schema.names[:last], "_score"])

    return run


def score(docs: DataFrame, net: Attention, text: str = "text") -> DataFrame:
    """docs, without the text, with ``_score`` (0 to 1, replacing a column of that name). Whole texts are read; a null one counts as empty."""
    rest = [c for c in docs.columns if c not in (text, "_score")]
    ordered = bounded_batches(docs).select(*rest, F.col(text))
    if net.share is not None:
        return ordered.select(*rest, F.lit(net.share).alias("_score"))
    schema = ordered.select(*rest).withColumn("_score", F.lit(0.0)).schema
    return ordered.mapInArrow(_scored(net), schema)
