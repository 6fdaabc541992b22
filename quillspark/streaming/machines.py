"""State machines on keyed streams: idempotent replies, a bounded cache of sessions, sets of rules.

Each machine is one pure step, (state, row) to (state, output). A stream runs it in transformWithState, event time
deciding what has expired and timers clearing it away; a batch runs the same step over rows sorted within
tasks, holding one key's state at a time. A stream takes the rows of a key in the order of their time within a
micro-batch, and micro-batches as they come. State is kept by the RocksDB store, which the session must name
(``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds that a reply and a running mark last, and that an entry lasts without access; entries held; lateness allowed.
REPLY_TTL, IDLE, MOST, LATE = 2_100_000, 43_200_000, 500, "10 minutes"


def folded(rows: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """The outputs of step over each key's rows in order. A task holds one state, however many rows a key has."""
    fields = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    now, state, begun = row[key], None, True
                state, said = step(state, row)
                out += [said] if said is not None else []
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


# Idempotent replies.

REPLIED = "request_id string, event_id long, at long, action string, reply string"


def reply_step(state: tuple | None, row: Any) -> tuple[tuple | None, dict | None]:
    """One event of a request id: ``request``, ``finished`` (with its reply) or ``failed``. state: (kind, since, reply).

    A request runs where nothing is known of it; while it runs, repeats are told ``processing``; after it has finished they get the
    reply again (``replay``). A failed one may run anew, and so may all after REPLY_TTL.
    """
    live = state if state is not None and row["at"] < state[1] + REPLY_TTL else None
    if row["kind"] == "finished":
        return ("finished", row["at"], row["reply"]), None
    if row["kind"] == "failed":
        return (live if live and live[0] == "finished" else None), None
    action, reply = ("run", None) if live is None else ("processing", None) if live[0] == "running" else ("replay", live[2])
    said = {"request_id": row["request_id"], "event_id": row["event_id"], "at": row["at"], "action": action, "reply": reply}
    return live or ("running", row["at"], None), said


class _Replies(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reply", "kind string, since long, reply string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else None
        for row in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            state, said = reply_step(state, row)
            if said:
                yield Row(**said)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(state[1] + REPLY_TTL)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def replies(events: DataFrame) -> DataFrame:
    """(request_id, event_id, at, action, reply) for each request among events (request_id, event_id, ts, kind, reply).

    ``at`` is the time in milliseconds. A null or blank id is never known: its requests run. Events of other kinds count as requests.
    """
    rows = events.select(F.col("request_id").cast("string").alias("request_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "kind", "reply")
    blank = F.coalesce(F.trim("request_id"), F.lit("")) == ""
    alone = rows.where(blank & ~F.coalesce(F.col("kind").isin("finished", "failed"), F.lit(False))).select("request_id", "event_id", "at", F.lit("run").alias("action"), F.lit(None).cast("string").alias("reply"))
    known = rows.where(~blank)
    if not events.isStreaming:
        return folded(known, "request_id", ["at", "event_id"], reply_step, REPLIED).unionByName(alone)
    found = known.withWatermark("ts", LATE).groupBy("request_id").transformWithState(_Replies(), REPLIED, "Append", "EventTime")
    return found.unionByName(alone)


# A cache that holds the sessions accessed last.

CACHED = "session string, last long, event string"


class _Recent(StatefulProcessor):
    """One shard of the cache: its sessions with their last access, MOST at most."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "session string", "last long")

    def _ends(self, held: dict[str, int], now: int | None) -> Iterator[Row]:
        """Drops what has expired and what is beyond the bound, oldest first, and sets the timer of the next to expire."""
        gone = [s for s, at in held.items() if now is not None and at + IDLE <= now]
        for s in gone:
            self.last.removeKey((s,))
            yield Row(session=s, last=held.pop(s), event="expired")
        for s in sorted(held, key=lambda s: (-held[s], s))[self.most :]:
            self.last.removeKey((s,))
            yield Row(session=s, last=held.pop(s), event="evicted")
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.handle.registerTimer(min(held.values()) + IDLE)

    def _held(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.last.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, touched = self._held(), {}
        for row in rows:
            touched[row["session"]] = max(row["at"], touched.get(row["session"], 0))
        for session, at in touched.items():
            before = held.get(session)
            held[session] = max(at, before or 0)
            self.last.updateValue((session,), (held[session],))
            yield Row(session=session, last=held[session], event="opened" if before is None else "hit")
        yield from self._ends(held, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._ends(self._held(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def recent_sessions(accesses: DataFrame, shards: int = 64, most: int = MOST) -> DataFrame:
    """A stream of accesses (session, ts) as changes (session, last, event) of a cache: opened, hit, evicted, expired.

    Sessions are dealt to shards by hash; each shard keeps its own ``most`` latest, so the latest of all are among them
    and no shard sees all. ``cache_view`` tells from the changes what the cache holds. Null sessions have no entry.
    """
    rows = accesses.where("session is not null").select(F.pmod(F.xxhash64(F.col("session").cast("string")), F.lit(shards)).cast("int").alias("shard"), F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return rows.withWatermark("ts", LATE).groupBy("shard").transformWithState(_Recent(most), CACHED, "Append", "EventTime")


def cache_view(changes: DataFrame, now: Column, most: int = MOST) -> DataFrame:
    """(session, last): what the cache holds at a time (milliseconds): the ``most`` latest of the sessions that no shard has dropped and that haven't expired."""
    entry = changes.groupBy("session").agg(F.max("last").alias("last"), F.max_by(F.col("event").isin("opened", "hit"), F.struct("last", ~F.col("event").isin("opened", "hit"))).alias("in"))
    return entry.where(F.col("in") & (F.col("last") + IDLE > now)).orderBy(F.desc("last"), "session").limit(most).select("session", "last")


# Sets of rules, changed by batches.

RULE = "struct<kind:string,rule_id:string,target:string,reason:string>"
RULES = f"session string, batch long, at long, version long, rules array<{RULE}>"


def rules_step(state: tuple | None, row: Any) -> tuple[tuple, dict | None]:
    """One batch of operations (op, kind, rule_id, target, reason) on a session's rules; all of it or nothing. state: (batch, at, version, rules).

    ADD puts a rule after those of its kind, REPLACE takes away those of its kind and id first, REMOVE those of the id
    whatever their kind. An empty batch makes an entry like any other. A batch whose number isn't above the last one's was applied before.
    What nobody has touched for IDLE begins anew, but its versions go on.
    """
    last, since, version, rules = state or (None, 0, 0, [])
    if last is not None and row["batch"] <= last:
        return state, None
    rules = [] if row["at"] >= since + IDLE else list(rules)
    for op in row["ops"] or []:
        if op["op"] not in ("ADD", "REPLACE", "REMOVE"):
            raise ValueError(f"unknown operation {op['op']}")
        if op["op"] != "ADD":
            rules = [r for r in rules if r["rule_id"] != op["rule_id"] or op["op"] == "REPLACE" and r["kind"] != op["kind"]]
        if op["op"] != "REMOVE":
            rules.append({f: op[f] for f in ("kind", "rule_id", "target", "reason")})
    rules.sort(key=lambda r: r["kind"] or "")  # stable: each kind keeps its order
    said = {"session": row["session"], "batch": row["batch"], "at": row["at"], "version": version + 1, "rules": rules}
    return (row["batch"], row["at"], version + 1, rules), said


class _Rules(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "batch long, at long, version long")
        self.rules = handle.getMapState("rules", "place int", "kind string, rule_id string, target string, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fields = ("kind", "rule_id", "target", "reason")
        held = {k[0]: dict(zip(fields, v, strict=True)) for k, v in self.rules.iterator()}
        state = (*self.head.get(), [held[k] for k in sorted(held)]) if self.head.exists() else None
        for row in sorted(rows, key=lambda r: r["batch"]):
            state, said = rules_step(state, row)
            if said:
                yield Row(**(said | {"rules": [Row(**r) for r in said["rules"]]}))
        now = dict(enumerate(state[3]))
        for place in held.keys() - now.keys():
            self.rules.removeKey((place,))
        for place, rule in now.items():
            if held.get(place) != rule:
                self.rules.updateValue((place,), tuple(rule[f] for f in fields))
        self.head.update(state[:3])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(state[1] + IDLE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rules.clear()  # the head stays: it knows repeated batches
        return iter(())

    def close(self) -> None:
        pass


def rule_sets(batches: DataFrame) -> DataFrame:
    """(session, batch, at, version, rules) after each batch (session, batch, ts, ops) that isn't a repeat. A row is a whole batch, so it is applied as one. Rows of null sessions or batches are left out."""
    rows = batches.where("session is not null and batch is not null").select(F.col("session").cast("string").alias("session"), F.col("batch").cast("long").alias("batch"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ops")
    if not batches.isStreaming:
        return folded(rows, "session", ["batch", "at"], rules_step, RULES)
    return rows.withWatermark("ts", LATE).groupBy("session").transformWithState(_Rules(), RULES, "Append", "EventTime")


def versions_written(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is a folder of its number that a rerun replaces, so every version is there exactly once."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    return write


def rules_in_force(versions: DataFrame) -> DataFrame:
    """(session, version, rules): each session's last version."""
    return versions.groupBy("session").agg(F.max("version").alias("version"), F.max_by("rules", "version").alias("rules"))


# Summaries of messages as they arrive.

NEAREST = "conv_id long, id long, summary_id long"


class _Tree(StatefulProcessor):
    """One conversation: what is known of each message, and the messages that came before their parent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "id long", "heir long")
        self.waiting = handle.getMapState("waiting", "parent long", "children array<long>, summaries array<boolean>")

    def _placed(self, conv: int, message: int, summary: bool, nearest: int | None) -> Iterator[Row]:
        """A message whose nearest summary is known, and all that have waited for it, each once. What its children inherit is itself, if it is a summary."""
        todo = [(message, summary, nearest)]
        while todo:
            now, is_summary, above = todo.pop()
            if self.known.containsKey((now,)):
                continue
            heir = now if is_summary else above
            self.known.updateValue((now,), (heir,))
            yield Row(conv_id=conv, id=now, summary_id=above)
            if self.waiting.containsKey((now,)):
                todo += [(c, s, heir) for c, s in self._children(now)]
                self.waiting.removeKey((now,))

    def _children(self, parent: int) -> list[tuple[int, bool]]:
        return list(zip(*self.waiting.getValue((parent,)), strict=True)) if self.waiting.containsKey((parent,)) else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = 0
        for row in rows:
            last = max(last, row["at"])
            if row["parent_id"] is None:
                yield from self._placed(key[0], row["id"], row["summary"], None)
            elif self.known.containsKey((row["parent_id"],)):
                yield from self._placed(key[0], row["id"], row["summary"], self.known.getValue((row["parent_id"],))[0])
            else:
                others = self._children(row["parent_id"])
                if all(c != row["id"] for c, _ in others):
                    both = [*others, (row["id"], row["summary"])]
                    self.waiting.updateValue((row["parent_id"],), ([c for c, _ in both], [s for _, s in both]))
        for old in list(self.handle.listTimers()):
            last = max(last, old - IDLE)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + IDLE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A conversation at rest: parents that never came end their children's paths, and nothing is kept."""
        held = {k[0]: list(zip(*v, strict=True)) for k, v in self.waiting.iterator()}
        below = {c for children in held.values() for c, _ in children}
        for parent in sorted(held.keys() - below):
            for child, summary in held[parent]:
                yield from self._placed(key[0], child, summary, None)
        self.known.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def summaries_on_arrival(messages: DataFrame) -> DataFrame:
    """A stream of messages (conv_id, id, parent_id, type, ts) as (conv_id, id, summary_id): the closest summary above each, once its parent is known.

    Messages may come in any order: one that comes before its parent waits for it. After IDLE without a message of a conversation those whose parent
    never came are given without it, and the state ends. A repeated message is given once. The batch form is ``trees.nearest_summaries``.
    """
    ts = F.col("ts").cast("timestamp")
    rows = messages.where("conv_id is not null and id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), F.coalesce(F.col("type") == "summary", F.lit(False)).alias("summary"), ts.alias("ts"), F.unix_millis(ts).alias("at"))
    return rows.withWatermark("ts", LATE).groupBy("conv_id").transformWithState(_Tree(), NEAREST, "Append", "EventTime")
