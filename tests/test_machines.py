"""State machines: streams and batches against plain replays."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.plans import catalog
from quillspark.streaming import machines

EVENT = "request_id string, event_id long, ts timestamp, kind string, reply string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, folder, parts, schema, made):
    """All rows that a stream has given after each part of its input was written and run."""
    spark.conf.set(*machines.ROCKSDB)
    name = f"m{abs(hash(str(folder)))}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in/{i:03}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{folder}/in")
        q = made(source).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").foreachBatch(machines.versions_written(f"{folder}/{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")


def plain_replies(events):
    """A dictionary of what is known, as a server would keep it."""
    known, out = {}, []
    for r, n, ts, kind, reply in sorted(events, key=lambda e: (e[2], e[1])):
        state, since, kept = known.get(r, ("none", ts, None))
        if (ts - since).total_seconds() >= 2100:
            state = "none"
        if kind == "finished":
            known[r] = ("finished", ts, reply)
        elif kind == "failed":
            if state == "running":
                known.pop(r)
        elif r is None or not r.strip():
            out.append((n, "run", None))
        elif state == "none":
            known[r] = ("running", ts, None)
            out.append((n, "run", None))
        else:
            out.append((n, "processing", None) if state == "running" else (n, "replay", kept))
    return sorted(out)


def test_replies_batch(spark):
    r = random.Random(4)
    events = [(r.choice(["a", "b", "c", "", None, " "]), i, at(i * r.choice([1, 60, 400])), r.choice(["request", "request", "request", "finished", "failed"]), f"r{i}") for i in range(400)]
    got = machines.replies(spark.createDataFrame(events, EVENT).repartition(4))
    assert sorted((x["event_id"], x["action"], x["reply"]) for x in got.collect()) == plain_replies(events)
    assert {x[1] for x in plain_replies(events)} == {"run", "processing", "replay"}
    assert machines.replies(spark.createDataFrame([], EVENT)).count() == 0


def test_replies_stream(spark, tmp_path):
    """Repeats before, during and after, after a failure, and after expiry, over several runs of the stream."""
    parts = [
        [("a", 1, at(0), "request", None), ("a", 2, at(5), "request", None), ("b", 3, at(6), "request", None), (None, 4, at(7), "request", None)],
        [("a", 5, at(20), "finished", "done"), ("a", 6, at(21), "request", None), ("b", 7, at(30), "failed", None), ("b", 8, at(31), "request", None), ("", 9, at(32), "request", None)],
        [("a", 10, at(600), "request", None), ("b", 11, at(610), "request", None)],
        [("a", 12, at(2121), "request", None), ("b", 13, at(2130), "request", None)],
        [("a", 14, at(2140), "finished", "again"), ("c", 15, at(9000), "request", None)],
        [("a", 16, at(9100), "request", None)],
    ]
    got = streamed(spark, tmp_path, parts, EVENT, machines.replies)
    events = [e for p in parts for e in p]
    assert sorted((x["event_id"], x["action"], x["reply"]) for x in got.collect()) == plain_replies(events)


def test_recent_sessions_stream(spark, tmp_path, monkeypatch):
    """Equal to a plain cache after a random log, some of which has expired; shards hold no more than the bound."""
    r = random.Random(9)
    log, now = [], 0
    for _ in range(240):
        now += r.choice([1, 30, 600, 1800])
        log.append((f"s{int(r.paretovariate(0.7)) % 60}", at(now)))
    parts = [log[:80], log[80:160], [*log[160:], (None, at(now))]]
    got = streamed(spark, tmp_path, parts, "session string, ts timestamp", lambda s: machines.recent_sessions(s, shards=3, most=8))
    cache = {}
    for session, ts in log:
        cache.pop(session, None)
        cache[session] = ts
        while len(cache) > 8:
            cache.pop(next(iter(cache)))
    end = int((START.timestamp() + now) * 1000)
    want = {s: int(t.timestamp() * 1000) for s, t in cache.items() if int(t.timestamp() * 1000) + machines.IDLE > end}
    assert {x["session"]: x["last"] for x in machines.cache_view(got, F.lit(end), 8).collect()} == want
    kinds = {x["event"] for x in got.select("event").distinct().collect()}
    assert {"opened", "hit", "evicted"} <= kinds
    live = got.groupBy("session").agg(F.max_by("event", F.struct("last", F.col("event").isin("evicted", "expired"))).alias("e")).where("e in ('opened', 'hit')")
    assert live.count() <= 3 * 8


BATCH = f"session string, batch long, ts timestamp, ops array<struct<op:string,kind:string,rule_id:string,target:string,reason:string>>"  # noqa: F541


def plain_rules(batches):
    """Two lists a session, as the operations say."""
    sets, out = {}, []
    for session, batch, ts, ops in sorted((b for b in batches if b[0] is not None), key=lambda b: b[1]):
        old = sets.get(session)
        if old and batch <= old[0]:
            continue
        lists = {k: list(v) for k, v in old[3].items()} if old and (ts - old[1]).total_seconds() < 43200 else {"rewrite": [], "skip": []}
        for op, kind, rule, target, reason in ops or []:
            if op == "REMOVE":
                lists = {k: [x for x in v if x[1] != rule] for k, v in lists.items()}
            else:
                if op == "REPLACE":
                    lists[kind] = [x for x in lists[kind] if x[1] != rule]
                lists[kind].append((kind, rule, target, reason))
        version = old[2] + 1 if old else 1
        sets[session] = (batch, ts, version, lists)
        out.append((session, batch, version, [*lists["rewrite"], *lists["skip"]]))
    return sorted(out)


def random_batches(r, n):
    out = []
    for i in range(n):
        ops = [(r.choice(["ADD", "REPLACE", "REMOVE"]), r.choice(["skip", "rewrite"]), f"r{r.randrange(5)}", f"t{i}", None if i % 3 else "why") for _ in range(r.choice([0, 1, 3]))]
        out.append((f"u{i % 3}", i // 3 + 1, at(i * 60 + (50_000 if i > 2 * n // 3 else 0)), ops or r.choice([None, []])))
    return out


def shown(rows):
    return sorted((x["session"], x["batch"], x["version"], [tuple(r) for r in x["rules"]]) for x in rows)


def test_rule_sets(spark, tmp_path):
    """Batch and stream equal a plain replay; an empty batch makes an entry; a repeated batch changes nothing."""
    batches = random_batches(random.Random(3), 30)
    rows = [*batches, batches[4], (None, 1, at(0), None)]
    assert shown(machines.rule_sets(spark.createDataFrame(rows, BATCH)).collect()) == plain_rules(batches)
    parts = [batches[:12], [*batches[12:21], *batches[9:12]], batches[21:]]
    got = streamed(spark, tmp_path, parts, BATCH, machines.rule_sets)
    assert shown(got.collect()) == plain_rules(batches)
    last = {x["session"]: (x["version"], len(x["rules"])) for x in machines.rules_in_force(got).collect()}
    assert last == {s: (v, len(x)) for s, _, v, x in plain_rules(batches)}


def test_unknown_operation():
    with pytest.raises(ValueError):
        machines.rules_step(None, {"session": "a", "batch": 1, "at": 0, "ops": [{"op": "MOVE", "kind": "skip", "rule_id": "x", "target": None, "reason": None}]})
    assert machines.rules_step(None, {"session": "a", "batch": 1, "at": 0, "ops": None})[1]["version"] == 1


def test_summaries_on_arrival(spark, tmp_path):
    """Equal to the batch over all messages, whatever the order of arrival; paths end at a parent that never comes."""
    from quillspark.operators import trees

    r = random.Random(12)
    messages = []
    for conv in range(4):
        ids = [conv * 100 + i for i in range(25)]
        for i, m in enumerate(ids):
            parent = None if i == 0 else 9000 + conv if i in (7, 8) else r.choice(ids[:i])
            messages.append((conv, m, parent, r.choice(["user", "assistant", "summary"]), None))
    r.shuffle(messages)
    messages = [(c, m, p, t, at(n)) for n, (c, m, p, t, _) in enumerate(messages)]
    schema = "conv_id long, id long, parent_id long, type string, ts timestamp"
    parts = [messages[:30], [*messages[30:70], messages[3], messages[40]], messages[70:], [(77, 7700, None, "user", at(60_000))], [(77, 7701, 7700, "user", at(60_001))]]
    got = streamed(spark, tmp_path, parts, schema, machines.summaries_on_arrival)
    want = trees.nearest_summaries(spark.createDataFrame(messages, schema).dropDuplicates(["id"])).collect()
    assert {(x["id"], x["summary_id"]) for x in got.where("conv_id < 77").collect()} == {(x["id"], x["summary_id"]) for x in want} and got.where("conv_id < 77").count() == len(want)
    assert sum(x["summary_id"] is not None for x in want) > 20


def test_requests_by_the_nearest_millisecond(spark, tmp_path):
    """The fifty seconds that make one are counted in milliseconds, to which times are rounded."""
    times = [(1, "49.999499"), (2, "49.999500"), (3, "50.000000")]
    rows = spark.createDataFrame(times, "event_id long, s string").selectExpr("event_id", "event_id AS user_id", "'view' AS event_type", "cast(timestamp_micros(1704067200000000 + cast(cast(s AS decimal(12,6)) * 1000000 AS bigint)) AS timestamp_ntz) AS ts")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    first = 1704067200 // 50 * 1000
    assert {r["event_id"]: r["at"] - first for r in catalog.queries()["request_replies"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1000, 3: 1000}
