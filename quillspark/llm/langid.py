"""Language identification by a small convolutional network over bytes.

Bytes are embedded, convolved by filters of several widths, max-pooled over a window of fixed
length and classed by softmax; the network is trained here, in numpy. A text is cut into windows,
the last one padded, and takes the mean of its windows' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import bounded_batches, slices, staged

WINDOW = 256
EMBEDDED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The training sample: at most so many documents of a language, and windows of each.
DOCS_A_LANGUAGE, WINDOWS_A_DOC = 400, 3
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 5
UNKNOWN = "und"


@dataclass
class ByteNet:
    classes: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, classes: list[str], seed: int = SEED) -> ByteNet:
        r = np.random.default_rng(seed)
        w = {"embedding": r.normal(0, 0.5, (256, EMBEDDED)), "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "out_bias": np.zeros(len(classes))}
        for width in WIDTHS:
            w |= {f"conv{width}": r.normal(0, (1 / (width * EMBEDDED)) ** 0.5, (width * EMBEDDED, FILTERS)), f"bias{width}": np.zeros(FILTERS)}
        return cls(classes, {k: v.astype(np.float32) for k, v in w.items()})

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, dict]:
        embedded = self.weights["embedding"][windows]
        pooled, kept = [], {}
        for width in WIDTHS:
            n = windows.shape[1] - width + 1
            patches = np.concatenate([embedded[:, i : i + n] for i in range(width)], axis=2)
            values = patches.reshape(-1, width * EMBEDDED) @ self.weights[f"conv{width}"]
            values = values.reshape(len(windows), n, FILTERS)
            at = values.argmax(axis=1)
            kept[width] = (patches, at)
            pooled.append(np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + self.weights[f"bias{width}"])
        return np.concatenate(pooled, axis=1), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Class probabilities of windows of bytes."""
        embedded = self.weights["embedding"][windows]
        pooled = []
        for width in WIDTHS:
            n = windows.shape[1] - width + 1
            conv = self.weights[f"conv{width}"].reshape(width, EMBEDDED, FILTERS)
            values = embedded[:, :n] @ conv[0]
            for i in range(1, width):
                values += embedded[:, i : i + n] @ conv[i]
            pooled.append(values.max(axis=1) + self.weights[f"bias{width}"])
        logits = np.tanh(np.concatenate(pooled, axis=1)) @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
        """Adam on the cross entropy, each class weighing the same."""
        r = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(self.classes))
        weight = (len(labels) / (len(self.classes) * np.maximum(counts, 1)))[labels].astype(np.float32)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                grads = self._gradients(windows[some], labels[some], weight[some])
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self._pooled(windows)
        hidden = np.tanh(pooled)
        logits = hidden @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(labels)), labels] -= 1
        d *= weight[:, None] / len(labels)
        grads = {"out": hidden.T @ d, "out_bias": d.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = (d @ self.weights["out"].T) * (1 - hidden * hidden)
        rows = np.arange(len(windows))[:, None]
        for i, width in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            patches, at = kept[width]
            chosen = patches[rows, at]  # window, filter, patch
            grads[f"conv{width}"] = np.einsum("bf,bfp->pf", g, chosen)
            grads[f"bias{width}"] = g.sum(axis=0)
            into = (g[:, :, None] * self.weights[f"conv{width}"].T[None]).reshape(len(windows), FILTERS, width, EMBEDDED)
            for j in range(width):
                np.add.at(grads["embedding"], windows[rows, at + j], into[:, :, j])
        return grads


def windows_of(raw: bytes) -> np.ndarray:
    """All bytes as rows of WINDOW, the last one padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS_A_DOC windows spread evenly over each text."""
    for batch in slices(batches):
        langs, rows = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = windows_of(text.encode("utf-8", "surrogatepass"))
            for i in sorted({int(x) for x in np.linspace(0, len(whole) - 1, WINDOWS_A_DOC)}):
                langs.append(lang)
                rows.append(whole[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])


_HAS_LETTER = r"\p{L}"


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_a_language: int = DOCS_A_LANGUAGE) -> ByteNet | None:
    """A network that knows the non-null values of lang; None where there are none.

    It is fitted on a bounded sample: of each language the docs_a_language documents of the smallest
    hashed keys, and WINDOWS_A_DOC windows of each, so that it costs the same at any size. Rows with a null key are never sampled.
    """
    useful = bounded_batches(labelled).where(F.col(lang).isNotNull() & F.col(text).rlike(_HAS_LETTER)).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    hashed = useful.where("key is not null").select("key", "lang", F.md5(F.col("key").cast("string")).alias("hash"))
    # Of a large language only keys whose hash is below a bound are ranked, so that no task's rows grow with the table.
    counts = bounded_batches(labelled).where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    share = (docs_a_language + 10 * docs_a_language**0.5 + 100) / F.col("n")
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / 2**32
    low = staged(hashed.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(place <= F.col("share")).select("key", "lang", "hash", (F.col("share") >= 1).alias("all")), "lang-sample")
    enough = low.groupBy("lang").agg(F.count("*").alias("n"), F.max("all").alias("all")).where(F.col("all") | (F.col("n") >= docs_a_language)).select("lang")
    # Languages most of whose texts have no letter may have too few: those are ranked whole.
    rest = hashed.join(F.broadcast(enough), "lang", "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "key"))
    chosen = low.join(F.broadcast(enough), "lang", "left_semi").select("key", "lang", "hash").unionAll(rest.select("key", "lang", "hash"))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= docs_a_language).select("key", "lang").distinct()
    # At most docs_a_language keys a language: small by construction.
    rows = useful.join(F.broadcast(chosen), ["key", "lang"]).select("lang", "text").mapInArrow(_sampled, "lang string, window binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    classes = sorted({r["lang"] for r in rows})
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return ByteNet.fresh(classes).train(windows, np.array([classes.index(r["lang"]) for r in rows]))


def _predicted(net: ByteNet, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count = len(batch.schema.names) - 2
            texts, letters = batch.column(count).to_pylist(), batch.column(count + 1).to_pylist()
            sums = np.zeros((len(texts), len(net.classes)))
            sizes = np.zeros(len(texts))
            load, owner = [], []

            def score() -> None:
                windows, of = np.concatenate(load), np.repeat([o for o, _ in owner], [n for _, n in owner])
                for at in range(0, len(windows), step):
                    np.add.at(sums, of[at : at + step], net.probabilities(windows[at : at + step]))
                load.clear()
                owner.clear()

            for i, (text, has) in enumerate(zip(texts, letters, strict=True)):
                if has:
                    load.append(windows_of(text.encode("utf-8", "surrogatepass")))
                    owner.append((i, len(load[-1])))
                    sizes[i] = len(load[-1])
                    if sum(n for _, n in owner) >= 4 * step:
                        score()
            if load:
                score()
            mean = sums / np.maximum(sizes, 1)[:, None]
            best = mean.argmax(axis=1)
            lang = [net.classes[b] if s else UNKNOWN for b, s in zip(best, sizes, strict=True)]
            value = np.where(sizes > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: count + 1], pa.array(lang, pa.string()), pa.array(value)], names=[*batch.schema.names[: count + 1], "_lang_pred", "_score"])

    return run


def held_out(key: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without the text, unless it is kept) with _lang_pred and _score, which replace columns of these names.

    A text that is null or has no letter is ``und`` with score 0, as is all where nothing was learned. Whole texts are read, whatever their length.
    """
    rest = [c for c in docs.columns if c not in (text, "_lang_pred", "_score")]
    ordered = bounded_batches(docs).select(*rest, F.col(text))
    letter = "_letter" + "_" * max(map(len, docs.columns))  # no column's name
    if net is None:
        out = ordered.withColumns({"_lang_pred": F.lit(UNKNOWN), "_score": F.lit(0.0)})
    else:
        schema = StructType(ordered.schema.fields).add("_lang_pred", StringType()).add("_score", DoubleType())
        out = ordered.withColumn(letter, F.coalesce(F.col(text).rlike(_HAS_LETTER), F.lit(False))).mapInArrow(_predicted(net), schema)
    return out if keep_text else out.drop(text)
