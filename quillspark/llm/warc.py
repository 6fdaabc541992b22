"""WARC archives: writing through Spark's text writer, reading by a verified chain of record boundaries.

A record is its header, a block of stated length and two line ends, so an archive is text whose
separator is the record end, and any number of tasks write to any file system Spark writes to.

Reading can't trust the magic line, since a payload may hold it. Files are split at the magic by
Spark's own reader. Every place that looks like a record is a candidate and names its successor:
its offset plus its stated length. Chains are first shortened inside blocks of BLOCK bytes, then
pointer jumping over blocks from offset zero finds each block's first true record; walking on from
there keeps the reachable candidates, and all others are payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

MAGIC = "WARC/1.1\r\n"
LEAST = 100
BLOCK = 8 << 20
#: Splits whose entry points are broadcast at most (some 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SPLITS = 100_000
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:quillspark:page:"


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]", "%0A")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """One record for each row of pages, in files under path.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest key becomes a
    response and the others revisit it; rows that repeat that smallest key stay responses, as do all
    rows of a group without any key, and all smaller payloads. A null payload is empty, a null
    url is left out. An empty table gives an empty archive.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), _clean(F.col(url)).alias("url"), body.alias("body"))
    digests = rows.where(F.octet_length("body") >= least).groupBy(F.sha2("body", 256).alias("digest")).agg(F.min("key").alias("first"), F.count("*").alias("n"))
    # Staged, so that its size is known: a small one is broadcast, a large one joined by digest with hot digests split.
    shared = staged(digests.where("n > 1 and first is not null").select("digest", "first"), "warc-shared")
    found = rows.withColumn("digest", F.sha2("body", 256)).join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"), F.when(~revisit, F.col("body").cast("string")).otherwise(F.lit(""))
    )
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("key"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    found.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r$", re.I | re.M)


def _record_bytes(after_magic: bytes, magic: int) -> int | None:
    """Bytes from a record's magic to its successor, if what follows the magic is a header."""
    end = after_magic.find(b"\r\n\r\n")
    found = _LENGTH.search(after_magic[: end + 1]) if end >= 0 else None
    return magic + end + 4 + int(found[1]) + 4 if found else None


def _segments(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """What stands between magics, in file order within a split."""
    lines = spark.read.option("lineSep", magic).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _candidates(magic: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, split) != now:
                    now, at = (file, split), 0
                rows.append((file, split, at, len(value) + magic, _record_bytes(value, magic)))
                at += len(value) + magic
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "split", "local", "size", "record"])

    return run


def _exits(table: pa.Table) -> pa.Table:
    """Of each candidate of a block, where its chain leaves the block (or ends at no candidate)."""
    rows = table.sort_by("at")
    at, step = rows.column("at").to_numpy(), rows.column("next").to_numpy()
    place = np.searchsorted(at, step)
    inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == step)
    jump = np.where(inside, place, np.arange(len(at)))
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return pa.table({"file": rows.column("file"), "at": rows.column("at"), "next": pa.array(step[jump])})


def _entries(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """(file, at): the first true record of each block that a chain from offset 0 enters."""
    blocks = candidates.withColumn("block", F.expr(f"at div {BLOCK}"))
    jumps = staged(blocks.groupBy("file", "block").applyInArrow(_exits, "file string, at long, next long"), "warc-jumps")
    reached = jumps.where("at = 0").select("file", "at")
    count = 0
    while True:
        hop = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at")).join(jumps.select("file", "at"), ["file", "at"], "left_semi")
        reached = staged(reached.unionAll(hop).distinct(), "warc-reached")
        if (n := reached.count()) == count:
            return reached
        count = n
        on = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = staged(jumps.join(on, ["file", "next"], "left").select("file", "at", F.coalesce("beyond", "next").alias("next")), "warc-jumps")


def _walk(table: pa.Table) -> pa.Table:
    """The reachable candidates of a block, from its entry point on."""
    rows = table.sort_by("at")
    at, step, first = (rows.column(n).to_numpy() for n in ("at", "next", "entry"))
    keep, i = [], int(np.searchsorted(at, first[0]))
    while i < len(at):
        keep.append(i)
        j = int(np.searchsorted(at, step[i]))
        if j >= len(at) or at[j] != step[i]:
            break
        i = j
    return rows.take(pa.array(keep, pa.int64())).select(["file", "at", "next"])


def true_records(spark: SparkSession, path: str, magic: str = MAGIC) -> tuple[DataFrame, DataFrame]:
    """(file, at, next) of every record that the chain from a file's start reaches, and (file, split, base) of every split."""
    m = len(magic)
    seen = staged(_segments(spark, path, magic).mapInArrow(_candidates(m), "file string, split long, local long, size long, record long"), "warc-seen")
    ordered = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = seen.groupBy("file", "split").agg(F.sum("size").alias("size"))
    splits = staged(sizes.select("file", "split", "size", F.coalesce(F.sum("size").over(ordered), F.lit(0)).alias("base")), "warc-splits")
    placed = seen.where("record is not null").join(splits.select("file", "split", "base"), ["file", "split"]).select("file", (F.col("base") + F.col("local") - m).alias("at"), "record")
    candidates = staged(placed.where("at >= 0").select("file", "at", (F.col("at") + F.col("record")).alias("next")), "warc-candidates")
    entries = _entries(spark, candidates).select("file", F.expr(f"at div {BLOCK}").alias("block"), F.col("at").alias("entry"))
    first = entries.groupBy("file", "block").agg(F.min("entry").alias("entry"))
    walked = candidates.withColumn("block", F.expr(f"at div {BLOCK}")).join(first, ["file", "block"]).groupBy("file", "block").applyInArrow(_walk, "file string, at long, next long")
    return staged(walked, "warc-records"), splits


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
_RECORD = "file string, at long, type string, id string, uri string, digest string, refers string, payload binary, whole boolean, missing int"


def _parsed(file: str, at: int, next_: int, raw: bytes, magic: int) -> tuple:
    """raw: what follows the magic, as far as the split has it."""
    end = raw.find(b"\r\n\r\n")
    head = dict((n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in raw[:end].decode("utf-8", "replace").split("\r\n")))
    length = next_ - at - magic - 4  # header and block
    block = raw[end + 4 : length]
    body = block.find(b"\r\n\r\n")
    http = head.get("content-type", "").startswith("application/http")
    return (file, at, *(head.get(n) for n in _FIELDS), block[body + 4 :] if http and body >= 0 else block, len(raw) >= length, max(0, length - len(raw)))


def _read_split(magic: int, lead: bool):
    """Rows (file, split, value, base, entry), in order within a split. lead: only what precedes the first record, as (file, split, value)."""
    mark = MAGIC.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, record, parts, front = None, 0, None, [], []
        rows: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal record, parts, front
            if lead and now and front:
                rows.append((*now, b"".join(front)))
            if not lead and record:
                rows.append(_parsed(now[0], record[0], record[1], mark.join(parts), magic))
            record, parts, front = None, [], []

        def out() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.binary()] if lead else [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.bool_(), pa.int32()]
            names = ["file", "split", "value"] if lead else [x.split()[0] for x in _RECORD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=names)

        need = None
        for batch in batches:
            for file, split, value, base, entry in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (file, split) != now:
                    flush()
                    now, at, need = (file, split), base, entry
                start = at - magic
                at += len(value) + magic
                if need is not None and start == need:
                    flush()
                    need = start + _record_bytes(value, magic)
                    record, parts = (start, need), [value]
                elif record:
                    parts.append(value)
                elif lead and start >= 0:
                    front.append(mark + value)
                held += len(value)
                if held > 8 << 20 and rows:
                    yield out()
                    rows, held = [], 0
        flush()
        yield out()

    return run


def read_warc(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """(file, at, type, id, uri, digest, refers, payload) of every true record under path.

    Nothing but the entry points of splits is joined to what is read, so payloads aren't shuffled. A
    payload that holds the magic and crosses a split is completed from the next split's lead.
    """
    m = len(magic)
    records, splits = true_records(spark, path, magic)
    # A record's split is the one that its magic's end falls in.
    owner = _in_split(records, splits, m)
    entries = staged(splits.select("file", "split", "base").join(owner.groupBy("file", "split").agg(F.min("at").alias("entry")), ["file", "split"], "left"), "warc-entries")
    count = entries.count()

    def joined(which: DataFrame) -> DataFrame:
        rows = _segments(spark, path, magic)
        if count <= BROADCAST_SPLITS:
            return rows.join(F.broadcast(which), ["file", "split"]).select("file", "split", "value", "base", "entry")
        numbered = rows.withColumn("row", F.monotonically_increasing_id()).join(which, ["file", "split"])
        return numbered.sortWithinPartitions("file", "split", "row").select("file", "split", "value", "base", "entry")

    found = joined(entries).mapInArrow(_read_split(m, lead=False), _RECORD)
    led = entries.where(f"base > 0 and (entry is null or entry + {m} > base)")
    if led.isEmpty():
        return found.drop("whole", "missing")
    # Leads belong to the last record before them.
    leads = joined(led).mapInArrow(_read_split(m, lead=True), "file string, split long, value binary")
    last = owner.groupBy("file", "split").agg(F.max("at").alias("at"))
    ordered = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "split").join(last, ["file", "split"], "left").withColumn("at", F.last("at", ignorenulls=True).over(ordered))
    tails = leads.join(before, ["file", "split"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"))
    tails = staged(tails.select("file", "at", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["value"])).alias("tail")), "warc-tails")
    whole = found.join(tails, ["file", "at"], "left")
    full = F.when(F.col("whole") | F.col("tail").isNull(), F.col("payload")).otherwise(F.expr("substring(concat(payload, tail), 1, octet_length(payload) + missing)"))
    return whole.select("file", "at", "type", "id", "uri", "digest", "refers", full.alias("payload"))


def _in_split(records: DataFrame, splits: DataFrame, magic: int) -> DataFrame:
    """Adds to each record the split that holds it, met by the blocks of BLOCK bytes that a split covers, so that a large file's records stay spread out."""
    after = F.lead("base").over(Window.partitionBy("file").orderBy("base"))  # over a file's splits, one narrow row each
    spans = splits.select("file", "split", "base", F.coalesce(after, F.col("base") + F.col("size") + magic).alias("upto"))
    covered = spans.withColumn("block", F.explode(F.expr(f"sequence(base div {BLOCK}, greatest(upto - 1, base) div {BLOCK})")))
    placed = records.select("file", "at", (F.col("at") + magic).alias("pos")).withColumn("block", F.expr(f"pos div {BLOCK}"))
    return placed.join(covered, ["file", "block"]).where("pos >= base and pos < upto").select("file", "split", "at")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of every record; a revisit's are its response's."""
    number = lambda c: F.regexp_extract(c, rf"^<{_URN}(-?\d+)>$", 1)
    as_key = lambda c: F.when(number(c) != "", number(c).cast("long"))
    read = read_warc(spark, path).select(
        as_key("id").alias("page_id"), F.col("type").alias("record_type"), as_key("refers").alias("refers_to"), F.regexp_replace("digest", "^sha256:", "").alias("stated"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")
    )
    rows = staged(read, "warc-pages")
    first = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("sha").alias("stated")).agg(F.max("bytes").alias("full"))
    first = staged(first.where("refers_to is not null"), "warc-responses")
    again = rows.where("record_type = 'revisit'").join(first, ["refers_to", "stated"], "left").select("page_id", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    own = rows.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(again)
