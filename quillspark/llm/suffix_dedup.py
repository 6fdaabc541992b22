"""Exact removal of byte passages that repeat, by hash-compared suffix sorting.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else, in the same
text or another. Sorting every suffix of the corpus would move the corpus many times over, so
suffixes are sorted at anchors only: of the GRAM-byte strings inside each SPAN-byte window, the
one of the smallest hash (the leftmost, if equal) is the window's anchor. Equal windows have equal
anchors at equal places, so all copies of a window meet in the bucket of their anchor's hash, and
an anchor stands for a run of neighbouring windows, its context being the bytes they cover.

1. Anchors are counted by bucket. An anchor alone in its bucket repeats nothing; of contexts that
   are equal as a whole every window repeats. Neither kind moves any text.
2. One context of each kind that is left is fetched, and each bucket sorts the suffixes that begin
   at its anchors: a mergesort whose comparisons find the common extension by binary search over
   prefix polynomial hashes. What stands before the anchors is sorted backwards in the same way.
   Neighbours' extensions are verified byte by byte in both orders. Windows x bytes before their
   anchors repeat where the suffixes agree for SPAN - x bytes and the x bytes before agree too.
3. A bucket of more than BUCKET contexts is split instead: its windows are dealt by the bytes they
   all share, in ever smaller runs, until each part is small, or alone, or equal as a whole. With
   runs of one window that always ends, and nothing is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, staged

SPAN = 400
GRAM = 100
BUCKET = 4096
#: Bytes that are hashed, sorted and verified at once in a task; each takes some 50 times as much memory meanwhile.
PIECE, CHUNK, VERIFIED = 1 << 19, 2 << 20, 1 << 20
#: Rows of a class table that is broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(1, dtype=np.uint64)
        step = base
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


class PrefixHashes:
    """Polynomial hashes modulo 2 ** 64 of every substring of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _power(_BASE, n), out=self.sums[1:])
        self.shift = _power(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.shift[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _digests(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each slice of data, as two columns of longs."""
    found = b"".join(hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip(first.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values, from running minima within blocks of w."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % w, np.iinfo(v.dtype).max, dtype=v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (bucket hash, anchor, first window, last window) for each run of windows.

    ends: where each text ends. Windows never cross an end.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < span:
        return none.astype(np.uint64), none, none, none
    hashes = PrefixHashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = mixed(hashes.of(at, at + gram))
    ranked = ((grams >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
    chosen = (_window_min(ranked, span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(chosen))
    whole = ends[np.searchsorted(ends, starts, side="right")] - starts >= span
    breaks = np.flatnonzero((chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1])) + 1
    first = np.concatenate([[0], breaks])
    last = np.concatenate([breaks, [len(chosen)]]) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    anchor = chosen[first]
    return grams[anchor], anchor, first, last


def _pieces(texts: list, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in loads of about PIECE bytes; a longer text in pieces whose windows together are all of its windows."""
    load: list[bytes] = []
    rows: list[int] = []
    bases: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        for base in range(0, max(len(raw) - span + 1, 0), PIECE):
            piece = raw[base : base + PIECE + span - 1]
            load.append(piece)
            rows.append(i)
            bases.append(base)
            size += len(piece)
            if size >= PIECE:
                yield np.frombuffer(b"".join(load), dtype=np.uint8), np.cumsum([len(x) for x in load]), np.array(rows), np.array(bases)
                load, rows, bases, size = [], [], [], 0
    if load:
        yield np.frombuffer(b"".join(load), dtype=np.uint8), np.cumsum([len(x) for x in load]), np.array(rows), np.array(bases)


_ANCHOR = "k long, c long, bucket long, context long, check long, anchor int, first int, last int"


def _scan(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, ends, rows, bases in _pieces(batch.column(2).to_pylist(), span):
                bucket, anchor, first, last = anchors(data, ends, span, gram)
                context = _digests(data.tobytes(), first, last + span)
                piece = np.searchsorted(ends, first, side="right")
                shift = bases[piece] - np.concatenate([[0], ends[:-1]])[piece]
                row = rows[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k[row], c[row], bucket.view(np.int64), context[:, 0], context[:, 1], (anchor + shift).astype(np.int32), (first + shift).astype(np.int32), (last + shift).astype(np.int32))],
                    names=["k", "c", "bucket", "context", "check", "anchor", "first", "last"],
                )

    return run


def _common(hashes: PrefixHashes, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension at i and j, most at most: binary search over prefix hashes."""
    low, high = np.zeros(len(i), dtype=np.int64), most.copy()
    while len(i) and (low < high).any():
        mid = (low + high + 1) >> 1
        same = hashes.of(i, i + mid) == hashes.of(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end] within each group, and each one's extension in common with the one before it.

    A bottom-up mergesort over all groups at once: in each pass every suffix finds its place in the
    sibling run by binary search. A suffix that is another's beginning comes first.
    """
    hashes = PrefixHashes(data)
    padded = np.concatenate([data.astype(np.int16), [-1]])
    order = np.argsort(group, kind="stable")
    g = group[order]
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.concatenate([edges, [len(g)]]))
    base, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
    within = np.arange(len(g)) - base

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        i, j = start[a], start[b]
        most = np.minimum(end[a] - i, end[b] - j)
        n = _common(hashes, i, j, most)
        x = np.where(i + n < end[a], padded[np.minimum(i + n, len(data))], -1)
        y = np.where(j + n < end[b], padded[np.minimum(j + n, len(data))], -1)
        return (x < y) | ((x == y) & or_equal)

    width = 1
    while width < sizes.max(initial=1):
        run = within // width
        left = run % 2 == 0
        sibling = np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(sibling, size), np.minimum(sibling + width, size)
        origin = low.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) >> 1
            other = order[base[at] + mid]
            less = before(other, order[at], ~left[at])  # equal ones of the left run go first
            low[at], high[at] = np.where(less, mid + 1, low[at]), np.where(less, high[at], mid)
        place = base + np.where(left, run, run - 1) * width + (within - run * width) + (low - origin)
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    shared = np.zeros(len(order), dtype=np.int64)
    inner = np.flatnonzero(within > 0)
    a, b = order[inner - 1], order[inner]
    shared[inner] = _common(hashes, start[a], start[b], np.minimum(end[a] - start[a], end[b] - start[b]))
    return order, shared


def _verified(data: np.ndarray, order: np.ndarray, shared: np.ndarray, start: np.ndarray) -> bool:
    """Whether neighbours' common extensions hold byte by byte."""
    at = np.flatnonzero(shared > 0)
    for part in np.array_split(at, max(1, int(shared.sum() // VERIFIED))):
        n = shared[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(start[order[part - 1]], n) + step] != data[np.repeat(start[order[part]], n) + step]).any():
            return False
    return True


def _order_by_bytes(data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as suffix_order() without hashes, for the case that one of them collided."""
    raw = data.tobytes()
    order = np.array(sorted(range(len(group)), key=lambda i: (group[i], raw[start[i] : end[i]])))
    shared = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order)):
        a, b = order[at - 1], order[at]
        if group[a] == group[b]:
            x, y = data[start[a] : end[a]], data[start[b] : end[b]]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            shared[at] = differ[0] if len(differ) else n
    return order, shared


def repeated_windows(contexts: list[bytes], group: np.ndarray, offset: np.ndarray, windows: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which windows repeat: [i, x] is True if context i's window that starts x bytes before its anchor also is another's.

    offset: the anchor's place in each context; windows: how many windows the context has, the first
    at its first byte. Windows are compared within a group only, at the same distance x.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    length = np.array([len(x) for x in contexts])
    end = np.cumsum(length)
    begin = end - length
    anchor = begin + offset
    _, group = np.unique(group, return_inverse=True)
    behind = _exact_order(data, group, anchor, end)
    before = _exact_order(data[::-1], group, len(data) - anchor, len(data) - begin)
    near = offset - windows + 1
    out = np.zeros((len(contexts), int(offset.max(initial=0)) + 1), dtype=bool)
    for x in range(out.shape[1]):
        at = np.flatnonzero((near <= x) & (x <= offset))
        if len(at) < 2:
            continue
        alike = _classes(*behind, span - x)[at] * len(group) + _classes(*before, x)[at]
        _, which, counts = np.unique(alike, return_inverse=True, return_counts=True)
        out[at[counts[which] > 1], x] = True
    return out


def _exact_order(data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """suffix_order() with its extensions verified, and where a group begins in it."""
    order, shared = suffix_order(data, group, start, end)
    if not _verified(data, order, shared, start):
        order, shared = _order_by_bytes(data, group, start, end)
    g = group[order]
    return order, shared, np.concatenate([[True], g[1:] != g[:-1]])


def _classes(order: np.ndarray, shared: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
    """A number for each suffix, equal for those of a group that agree in ``length`` bytes, as far as they are so long."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new | (shared < length)) - 1
    return out


_SPANS = "k long, c long, start int, end int"


def _spans(k: np.ndarray, c: np.ndarray, anchor: np.ndarray, repeated: np.ndarray, span: int) -> pa.RecordBatch:
    """Runs of repeated windows as byte spans of their texts."""
    padded = np.zeros((repeated.shape[0], repeated.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = repeated
    change = np.diff(padded, axis=1)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)  # row by row, in step with the starts
    return pa.RecordBatch.from_arrays(
        [pa.array(k[row]), pa.array(c[row]), pa.array((anchor[row] - (high - 1)).astype(np.int32)), pa.array((anchor[row] - low + span).astype(np.int32))],
        names=["k", "c", "start", "end"],
    )


def _sort_buckets(span: int):
    """Over rows sorted by bucket: (bucket, k, c, anchor, first, last, bytes)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        col = {n: rows.column(n).to_numpy() for n in ("bucket", "k", "c", "anchor", "first", "last")}
        repeated = repeated_windows(rows.column("bytes").to_pylist(), col["bucket"], (col["anchor"] - col["first"]).astype(np.int64), (col["last"] - col["first"] + 1).astype(np.int64), span)
        return _spans(col["k"], col["c"], col["anchor"], repeated, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.column("bytes").nbytes for b in held) >= CHUNK:
                rows = pa.Table.from_batches(held)
                bucket = rows.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1], side="left"))  # the last bucket may go on
                if cut:
                    yield solve(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held))

    return run


_CONTEXT = "k long, c long, bucket long, context long, check long, anchor int, first int, last int, bytes binary"
_KIND = ["bucket", "context", "check"]


def _cut_out(span: int):
    """Context bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, c, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                cols = {n: [w[n] for w in wanted] for n in (*_KIND, "anchor", "first", "last")}
                yield pa.RecordBatch.from_pydict(
                    {"k": [k] * len(wanted), "c": [c] * len(wanted), **cols, "bytes": [raw[a : b + span] for a, b in zip(cols["first"], cols["last"], strict=True)]},
                    schema=pa.schema([("k", pa.int64()), ("c", pa.int64()), ("bucket", pa.int64()), ("context", pa.int64()), ("check", pa.int64()), ("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("bytes", pa.binary())]),
                )

    return run


def _split_runs(span: int, width: int):
    """Each context as parts of at most width windows, aligned at the anchor; a part's bucket is of the bytes that all its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in batch.schema.names}
            for row in batch.to_pylist():
                anchor, first, last, raw = row["anchor"], row["first"], row["last"], row["bytes"]
                for block in range((anchor - last) // width, (anchor - first) // width + 1):
                    lo, hi = max(first, anchor - block * width - width + 1), min(last, anchor - block * width)
                    core = raw[anchor - block * width - first : anchor - block * width - width + 1 + span - first]
                    part = raw[lo - first : hi + span - first]
                    key = xxhash.xxh64_intdigest(core, row["bucket"] % (1 << 64) ^ block)
                    context, check = _digests(part, np.array([0]), np.array([len(part)]))[0].tolist()
                    new = {"k": row["k"], "c": row["c"], "bucket": key - (key >> 63 << 64), "context": context, "check": check, "anchor": anchor, "first": lo, "last": hi, "bytes": part}
                    for n in out:
                        out[n].append(new[n])
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return run


def _whole(df: DataFrame, span: int) -> DataFrame:
    return df.select("k", "c", F.col("first").alias("start"), (F.col("last") + span).cast("int").alias("end"))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(k, c, start, end): byte spans of repeated windows, overlapping ones apart, of docs (k, c, text). Rows alike in k and c must have equal texts."""
    all_ = staged(bounded_batches(docs).select("k", "c", "text").mapInArrow(_scan(span, gram), _ANCHOR), "anchors")
    uniform = (F.min("context") == F.max("context")) & (F.min("check") == F.max("check"))
    sizes = all_.groupBy("bucket").agg(F.count("*").alias("n"), uniform.alias("uniform")).where("n > 1").drop("n")
    # Staged, so that the join stands on two plain exchanges and a hot bucket can be split.
    shared = staged(all_.join(staged(sizes, "anchors-sizes"), "bucket"), "anchors-shared")
    found = [_whole(shared.where("uniform"), span)]
    mixed_ = shared.where("not uniform")
    kinds = staged(mixed_.groupBy(*_KIND).agg(F.count("*").alias("n"), F.min(F.struct("k", "c", "anchor", "first", "last")).alias("one")), "anchors-kinds")
    found.append(_whole(mixed_.join(_several(kinds), _KIND, "left_semi"), span))
    wanted = kinds.select(*_KIND, "one.*").groupBy("k", "c").agg(F.collect_list(F.struct(*_KIND, "anchor", "first", "last")).alias("wanted"))
    contexts = staged(docs.join(wanted, ["k", "c"]).select("k", "c", "text", "wanted").mapInArrow(_cut_out(span), _CONTEXT), "contexts")
    for width in (64, 16, 4, 1):
        hot = contexts.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("bucket")
        hot = staged(hot, "contexts-hot")
        if hot.isEmpty():
            break
        found.append(_sorted(contexts.join(hot, "bucket", "left_anti"), span))
        parts = staged(contexts.join(hot, "bucket", "left_semi").select(*contexts.columns).mapInArrow(_split_runs(span, width), _CONTEXT), "contexts-split")
        same = parts.groupBy(*_KIND).agg(F.count("*").alias("n"), F.min(F.struct("k", "c", "first")).alias("one"))
        kinds = staged(same.select(*_KIND, "n", "one.*"), "split-kinds")
        found.append(_whole(parts.join(_several(kinds), _KIND, "left_semi"), span))
        many = kinds.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
        ones = kinds.join(many, "bucket", "left_semi").select(*_KIND, "k", "c", "first")
        contexts = staged(parts.join(ones, [*_KIND, "k", "c", "first"], "left_semi").select(*contexts.columns), "contexts")
    else:
        return _union(found)
    found.append(_sorted(contexts, span))
    return _union(found)


def _several(kinds: DataFrame) -> DataFrame:
    """Classes of more than one context, of a staged table; broadcast where few, so that a hot class stays where its rows are."""
    out = kinds.where("n > 1").select(*_KIND)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def _sorted(contexts: DataFrame, span: int) -> DataFrame:
    return contexts.select("bucket", "k", "c", "anchor", "first", "last", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(span), _SPANS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row its bytes, what is kept of them, and the maximal removed runs."""
    for batch in slices(batches):
        kept, sizes, runs = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged = _merged(spans or [])
            edges = [0, *(x for m in merged for x in m), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(raw))
            runs.append([{"start": a, "end": b} for a, b in merged])
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, spans_type)], names=["k", "c", "none", "n_bytes", "kept", "removed"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: key, c, n_bytes, kept (binary), removed (array of start, end in bytes).

    c is a hash of the text that tells rows of equal keys apart. A null text counts as empty. Two rows
    alike in key and text are two places, so such texts of span bytes or more go whole. Rows with a null
    key take part and keep it. Texts under span bytes are kept whole. Other columns are ignored.
    """
    of, none = F.col(text), F.col(key).isNull()
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("k"), F.xxhash64(of, none).alias("c"), none.alias("none"), of.alias("text"))
    spans = repeated_spans(keyed.where(F.octet_length("text") >= span), span, gram, bucket)
    listed = spans.groupBy("k", "c").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = keyed.join(listed, ["k", "c"], "left").select("k", "c", "none", "text", "spans")
    done = rows.mapInArrow(_removed, "k long, c long, none boolean, n_bytes long, kept binary, removed array<struct<start:int,end:int>>")
    return done.select(F.when(~F.col("none"), F.col("k")).alias(key), "c", "n_bytes", "kept", "removed")


def _merged(spans: list) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def _cut_text(text: str | None, spans: list, words: int = 0) -> str | None:
    """The text without the spans of at least so many words, each narrowed to whole characters."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for s, e in _merged(spans):
        if words and len(raw[s:e].split()) < words:
            continue
        while s < len(raw) and raw[s] & 0xC0 == 0x80:
            s += 1
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if at < s:
            kept.append(raw[at:s])
        at = max(at, e)
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, bucket: int = BUCKET, words: int = 0) -> DataFrame:
    """docs, all rows and columns, with repeated passages cut out of the text; runs of fewer than ``words`` words stay."""
    columns = docs.columns
    place = columns.index(text)
    of, none = F.col(text), F.col(key).isNull()
    keyed = docs.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-1)), "_c": F.xxhash64(of, none)})
    found = repeated_spans(keyed.select(F.col("_k").alias("k"), F.col("_c").alias("c"), of.alias("text")).where(F.octet_length("text") >= span), span, gram, bucket)
    listed = found.groupBy(F.col("k").alias("_k"), F.col("c").alias("_c")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    rows = keyed.join(listed, ["_k", "_c"], "left").select(*docs.columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_cut_text(t, s, words) for t, s in zip(batch.column(place).to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(i).type) if i == place else batch.column(i) for i in range(len(columns))], names=columns)

    return rows.mapInArrow(run, docs.schema)
