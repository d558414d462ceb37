"""Streams whose state is kept per run, or for shards of runs: first signals, waits and signals, timers and callbacks that come out later.

All of them take rows of runs and, as an option, ticks. Time passes by ticks, a table of times (tick timestamp) that is
a stream like others: a deadline has come once a tick at or after it was read, so that replays and tests give the
same rows at any speed. Without ticks it passes by the cluster's clock. Rows are never late: what moves time
on are ticks alone, and rows of runs may arrive in any order. A stream that goes by the clock has a batch for every trigger, with or without
rows, so it must not be run with availableNow, which would never end.

A run's state ends with the run: a row of kind `end` drops all of it but for one flag, by which what
arrives afterwards is ignored. Each run has one timer at a time, at its earliest deadline.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_DELAY = 60
# Shards of the runs of a stream: a batch reads back the state of those that it touches.
SHARDS = 1024
# Items of a shard's state that are no waits: the end of a run, and its call.
ENDED, CALL = -(2**63), 0


def by_run(rows: DataFrame, processor: type, schema: str, ticks: DataFrame | None, key: str = "run_id") -> DataFrame:
    """The processor's rows for each run_id (or other key) of rows, which have a kind; the session's state store becomes RocksDB, which list and map state need."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    if ticks is None:
        return rows.groupBy(key).transformWithState(processor(False), schema, "append", "ProcessingTime" if processor.timed else "None")
    # Rows of runs have no tick, and what has no time is neither late nor moves the watermark.
    both = rows.withColumn("tick", F.lit(None).cast("timestamp")).unionByName(ticks.select("tick"), allowMissingColumns=True)
    return both.withWatermark("tick", "0 seconds").groupBy(key).transformWithState(processor(True), schema, "append", "EventTime")


def by_shard(rows: DataFrame, processor: type, schema: str, ticks: DataFrame | None, shards: int) -> DataFrame:
    """The same for a processor of many runs: runs are dealt to shards by hash."""
    return by_run(rows.withColumn("shard", F.pmod(F.xxhash64("run_id"), F.lit(shards)).cast("int")), processor, schema, ticks, "shard")


class OfRun(StatefulProcessor):
    """What the processors share: the time, the timer, and the end of a run. take() gets a batch's rows of a run, due() is called when its timer rings, forget() drops its state. One that has no deadlines is not timed, and its stream ends when its rows do."""

    timed = True

    def __init__(self, by_ticks: bool):
        self.by_ticks = by_ticks

    def init(self, handle) -> None:
        self.handle = handle
        self.over, self.alarm = handle.getValueState("over", "over boolean"), handle.getValueState("alarm", "at long")
        self.build(handle)

    def now(self, t) -> int:
        return (t.getCurrentWatermarkInMs() if self.by_ticks else t.getCurrentProcessingTimeInMs()) // 1000

    def ring_at(self, at: int | None, now: int) -> None:
        """Have the timer ring at this second. One that is set already and rings before is left: due() then sets the next."""
        if at is None:
            return
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if old is None or old <= now or at < old:
            self.handle.registerTimer(at * 1000)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [r for r in rows if r["kind"] is not None]
        if not rows or self.over.exists():
            return
        yield from self.take(key[0], rows, self.now(timerValues))
        if any(r["kind"] == "end" for r in rows):
            self.forget()
            self.alarm.clear()
            self.over.update((True,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.over.exists():
            yield from self.due(key[0], self.now(timerValues))

    def close(self) -> None:
        pass


class FirstSignals(OfRun):
    timed = False

    def build(self, handle):
        self.keys = handle.getMapState("keys", "idempotency_key string", "event_id long")

    def take(self, run, rows, now):
        signals = sorted((r for r in rows if r["kind"] == "signal"), key=lambda r: (r["at"], r["event_id"]))
        ends = [r["at"] for r in rows if r["kind"] == "end"]
        first = {}
        for r in signals:
            if not ends or r["at"] <= min(ends):
                first.setdefault(r["idempotency_key"], r)
        for k, r in first.items():
            if not self.keys.containsKey((k,)):
                self.keys.updateValue((k,), (r["event_id"],))
                yield Row(run_id=run, idempotency_key=k, event_id=r["event_id"])

    def due(self, run, now):
        return iter(())

    def forget(self):
        self.keys.clear()


class OfShard(OfRun):
    """A processor of many runs, for state of a row or a few per run: asking the store for each run takes about a millisecond, so that
    a shard's state is one list, read and added to at once. The list is a log of rows (run_id, item, a, b, gone): the last row of
    (run_id, item) counts, one that has gone is none, and a run that has ended has the item ENDED alone. The log is written
    anew when less than half of it counts. A batch reads the state of the shards that it has rows of.
    """

    def build(self, handle):
        self.log = handle.getListState("log", "run_id long, item long, a long, b long, gone boolean")

    def load(self) -> tuple[dict, int]:
        runs, n = {}, 0
        for run, item, a, b, gone in self.log.get():
            n += 1
            if gone:
                runs.get(run, {}).pop(item, None)
            elif item == ENDED:
                runs[run] = None
            else:
                runs.setdefault(run, {})[item] = (a, b)
        return runs, n

    def save(self, runs: dict, stored: int, changed: dict) -> None:
        """changed: the rows to add, by (run_id, item)."""
        if not changed:
            return
        kept = sum(1 if items is None else len(items) for items in runs.values())
        if stored + len(changed) > 2 * kept + 16:
            rows = [row for run, items in runs.items() for row in ([(run, ENDED, 0, 0, False)] if items is None else [(run, i, *x, False) for i, x in items.items()])]
            self.log.put(rows) if rows else self.log.clear()
        else:
            self.log.appendList([(*at, *x) for at, x in changed.items()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        by = {}
        for r in rows:
            if r["kind"] is not None:
                by.setdefault(r["run_id"], []).append(r)
        if by:
            yield from self.step(by, self.now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.step({}, self.now(timerValues))

    def step(self, by: dict, now: int) -> Iterator[Row]:
        runs, stored = self.load()
        changed = {}
        for run, rows in by.items():
            items = runs.setdefault(run, {})
            if items is None:
                continue
            if any(r["kind"] == "end" for r in rows):
                runs[run] = None
                changed[run, ENDED] = (0, 0, False)
                continue
            for item, x in self.news(items, rows).items():
                items[item] = x
                changed[run, item] = (*x, False)
        due = sorted((at, str(run), item, run) for run, items in runs.items() for item, x in (items or {}).items() if (at := self.at(x)) is not None and at <= now)
        for _, _, item, run in due:
            x = runs[run][item]
            yield self.out(run, item, x, now)
            runs[run][item] = x = self.rung(x)
            changed[run, item] = (*x, False)
        self.save(runs, stored, changed)
        self.ring_at(min((at for items in runs.values() for x in (items or {}).values() if (at := self.at(x)) is not None), default=None), now)


class FirstSignalsOfShard(OfShard):
    """The log has a row (run_id, keys, ended) for each run of a batch: its new keys, or that it has ended; it is written anew, a row for each run, when less than half of its rows and keys count."""

    timed = False

    def build(self, handle):
        self.log = handle.getListState("log", "run_id long, keys array<string>, ended boolean")

    def load(self) -> tuple[dict, int]:
        runs, n = {}, 0
        for run, keys, ended in self.log.get():
            n += 1 + len(keys or ())
            if ended:
                runs[run] = None
            else:
                runs.setdefault(run, set()).update(keys)
        return runs, n

    def step(self, by: dict, now: int) -> Iterator[Row]:
        runs, stored = self.load()
        added = []
        for run, rows in by.items():
            keys = runs.get(run, set())
            if keys is None:
                continue
            ends = [r["at"] for r in rows if r["kind"] == "end"]
            first = {}
            for r in sorted((r for r in rows if r["kind"] == "signal"), key=lambda r: (r["at"], r["event_id"])):
                if not ends or r["at"] <= min(ends):
                    first.setdefault(r["idempotency_key"], r["event_id"])
            new = [k for k in first if k not in keys]
            for k in new:
                yield Row(run_id=run, idempotency_key=k, event_id=first[k])
            if ends:
                runs[run] = None
                added.append((run, None, True))
            elif new:
                runs[run] = keys | set(new)
                added.append((run, new, False))
        if not added:
            return
        stored += sum(1 + len(keys or ()) for _, keys, _ in added)
        if stored > 2 * sum(1 + len(keys or ()) for keys in runs.values()) + 16:
            self.log.put([(run, None, True) if keys is None else (run, list(keys), False) for run, keys in runs.items()])
        else:
            self.log.appendList(added)


def first_signals(rows: DataFrame, ticks: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """STR-1: (run_id, idempotency_key, event_id): the first signal of each key of a run, however late it or its repeats arrive.

    rows have run_id, kind (signal or end), event_id, idempotency_key and at (seconds). Of one batch the first by (at,
    event_id) is taken, and signals after the run's end are ignored. Keys are forgotten when the run ends. State is a row for each
    key, which a batch looks up one by one; with shards given it is a list for each shard of runs, read back whole by a batch that
    touches it: for batches of very many keys.
    """
    rows, schema = rows.select("run_id", "kind", "event_id", "idempotency_key", "at"), "run_id long, idempotency_key string, event_id long"
    return by_shard(rows, FirstSignalsOfShard, schema, ticks, shards) if shards else by_run(rows, FirstSignals, schema, ticks)


class Timers(OfShard):
    """An item is a wait: its deadline, and whether it has fired."""

    def news(self, items, rows):
        new = {}
        for r in rows:
            if (r["resume_unix"] or 0) > 0 and r["wait_id"] not in items:
                new[r["wait_id"]] = (min(r["resume_unix"], new.get(r["wait_id"], (r["resume_unix"],))[0]), 0)
        return new

    def at(self, x):
        return None if x[1] else x[0]

    def rung(self, x):
        return (x[0], 1)

    def out(self, run, item, x, now):
        return Row(run_id=run, wait_id=item, resume_unix=x[0], fired_unix=now)


def fire_timers(rows: DataFrame, ticks: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """STR-5: (run_id, wait_id, resume_unix, fired_unix): each wait once, when its deadline has come, however often it arrives; fired_unix is the time by then.

    rows have run_id, kind (wait or end), wait_id and resume_unix (seconds; 0 or less: no deadline). A wait is kept until it
    fires, restarts included; waits of a run that ends before do not fire.
    """
    return by_shard(rows.select("run_id", "kind", "wait_id", "resume_unix"), Timers, "run_id long, wait_id long, resume_unix long, fired_unix long", ticks, shards)


class Outbox(OfShard):
    """The item of a run, its call: when it is due, and twice the number of attempts, one more once it is sent."""

    def news(self, items, rows):
        call = old = (items[CALL][1] // 2, items[CALL][0]) if CALL in items else None
        for r in sorted((r for r in rows if r["kind"] == "callback"), key=lambda r: r["attempts"]):
            # A callback that is known already, with as many attempts or more, is a repeat.
            if call is None or r["attempts"] > call[0]:
                call = (r["attempts"], r["at"] + min(r["attempts"], MAX_DELAY))
        for r in sorted((r for r in rows if r["kind"] == "failed"), key=lambda r: r["attempts"]):
            if call and r["attempts"] == call[0]:
                call = (call[0] + 1, r["at"] + min(call[0] + 1, MAX_DELAY))
        return {} if call == old else {CALL: (call[1], 2 * call[0])}

    def at(self, x):
        return None if x[1] % 2 else x[0]

    def rung(self, x):
        return (x[0], x[1] + 1)

    def out(self, run, item, x, now):
        return Row(run_id=run, attempts=x[1] // 2, next_unix=x[0], sent_unix=now)


def outbox(callbacks: DataFrame, results: DataFrame | None = None, ticks: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """STR-7: (run_id, attempts, next_unix, sent_unix): callbacks of ended runs when they are to be delivered, each attempt once.

    callbacks are (run_id, status, url, attempts, delivered, last_attempt_unix); results, a second stream, are (run_id,
    attempts, ok, at): how the delivery after so many attempts ended. A failed one comes out again after as many seconds as there are attempts
    by then, MAX_DELAY at most; a delivered one never does, and its state is dropped.
    """
    ended = F.col("status").isin("completed", "failed", "cancelled") & (F.trim("url") != "")
    kind = F.when(F.col("delivered"), "end").otherwise("callback")
    rows = callbacks.filter(ended).select("run_id", kind.alias("kind"), "attempts", F.col("last_attempt_unix").alias("at"))
    if results is not None:
        rows = rows.unionByName(results.select("run_id", F.when(F.col("ok"), "end").otherwise("failed").alias("kind"), "attempts", "at"))
    return by_shard(rows, Outbox, "run_id long, attempts long, next_unix long, sent_unix long", ticks, shards)


def prefixes(dotted: str) -> list[str]:
    """The wait types that take a signal of this type."""
    parts = dotted.split(".")
    return list(dict.fromkeys(["", *(".".join(parts[:n]) for n in range(1, len(parts) + 1))]))


class Correlation:
    """The open waits and unused signals of a run, with what a new row may fit at hand.

    Waits are heaped in parking order by what they ask for: key, type and required payload. Signals are heaped by
    (idempotency_key, event_id) for each of these that a wait has asked for. So a row looks at the first of
    a few heaps, and what has gone from elsewhere is dropped when it comes up.
    """

    def __init__(self):
        self.waits, self.signals, self.due = {}, {}, []
        self.asked, self.offered, self.fitting = {}, {}, {}

    @staticmethod
    def needs(w) -> tuple:
        return tuple(sorted(k for k in (w["required"] or []) if k.strip()))

    @staticmethod
    def has(s, needs: tuple) -> bool:
        return all(((s["payload"] or {}).get(k) or "").strip() for k in needs)

    @staticmethod
    def classes(s) -> list[tuple]:
        return [(k, t) for k in dict.fromkeys((s["key"], "")) for t in prefixes(s["type"])]

    def keep_wait(self, w) -> None:
        self.waits[w["id"]] = w
        heapq.heappush(self.asked.setdefault((w["key"], w["type"]), {}).setdefault(self.needs(w), []), (w["at"], w["id"]))
        if w["deadline"] and (w["timeout_outputs"] or w["outputs"] is not None):
            heapq.heappush(self.due, (w["deadline"], w["id"]))

    def keep_signal(self, s) -> None:
        self.signals[s["id"]] = s
        place = (s["idempotency_key"], s["id"])
        for c in self.classes(s):
            self.fitting.setdefault(c, []).append(place)
            for needs, heap in self.offered.get(c, {}).items():
                if self.has(s, needs):
                    heapq.heappush(heap, place)

    def signal_for(self, w):
        """The smallest unused signal that the wait takes, which is then used, or None."""
        c, needs = (w["key"], w["type"]), self.needs(w)
        heaps = self.offered.setdefault(c, {})
        if needs not in heaps:
            heaps[needs] = [p for p in self.fitting.get(c, ()) if p[1] in self.signals and self.has(self.signals[p[1]], needs)]
            heapq.heapify(heaps[needs])
        while heaps[needs]:
            s = self.signals.pop(heapq.heappop(heaps[needs])[1], None)
            if s is not None:
                return s
        return None

    def wait_for(self, s):
        """The open wait that was parked first of those that take the signal, which is then closed, or None."""
        best = None
        for c in self.classes(s):
            for needs, heap in self.asked.get(c, {}).items():
                while heap and heap[0][1] not in self.waits:
                    heapq.heappop(heap)
                if heap and (best is None or heap[0] < best) and self.has(s, needs):
                    best = heap[0]
        return self.waits.pop(best[1]) if best else None

    def expired(self, now: int) -> Iterator:
        while self.due and self.due[0][0] <= now:
            w = self.waits.pop(heapq.heappop(self.due)[1], None)
            if w is not None:
                yield w

    def earliest(self) -> int | None:
        while self.due and self.due[0][1] not in self.waits:
            heapq.heappop(self.due)
        return self.due[0][0] if self.due else None


ROW = ["id", "at", "key", "type", "required", "outputs", "timeout_outputs", "deadline", "idempotency_key", "payload", "input_tokens", "output_tokens"]
ROW_TYPES = "id long, at long, key string, type string, required array<string>, outputs map<string,string>, timeout_outputs map<string,string>, deadline long, idempotency_key string, payload map<string,string>, input_tokens long, output_tokens long"
MAPS = ["outputs", "timeout_outputs", "payload"]
RANK = {"signal": 0, "timer": 1, "wait": 1, "end": 2}


def with_maps(r: dict) -> dict:
    """A row whose maps are dicts; streams hand them over as lists of pairs."""
    return r | {k: dict(r[k]) for k in MAPS if r[k] is not None}


class Matching(OfRun):
    """State is two lists that are only added to, and the ids that have gone from them; lists are written anew when half has gone. So a row is written and dropped once, whatever the size of the state."""

    def build(self, handle):
        self.open, self.unused = handle.getListState("open", ROW_TYPES), handle.getListState("unused", ROW_TYPES)
        self.gone = handle.getListState("gone", "signal boolean, id long")

    def load(self) -> tuple[Correlation, int]:
        c, gone, n = Correlation(), set(map(tuple, self.gone.get())), 0
        for signal, held, keep in ((False, self.open, c.keep_wait), (True, self.unused, c.keep_signal)):
            for t in held.get():
                n += 1
                r = with_maps(dict(zip(ROW, t, strict=True)))
                if (signal, r["id"]) not in gone:
                    keep(r)
        return c, n

    def save(self, c: Correlation, stored: int, before: tuple[set, set]) -> None:
        """Write what has changed since there were these ids of waits and signals."""
        row = lambda r: tuple(r[k] for k in ROW)
        lists = ((False, self.open, c.waits, before[0]), (True, self.unused, c.signals, before[1]))
        left = [(signal, i) for signal, _, now, old in lists for i in old if i not in now]
        all_gone = stored - len(before[0]) - len(before[1]) + len(left)
        if 2 * all_gone > stored:
            self.gone.clear()
            for _, held, now, _ in lists:
                held.put([row(r) for r in now.values()]) if now else held.clear()
            return
        if left:
            self.gone.appendList(left)
        for _, held, now, old in lists:
            if new := [row(r) for i, r in now.items() if i not in old]:
                held.appendList(new)

    def take(self, run, rows, now):
        c, stored = self.load()
        before = set(c.waits), set(c.signals)
        for r in sorted(rows, key=lambda r: (r["at"], RANK[r["kind"]], r["id"])):
            for w in c.expired(max(r["at"], 0)):
                yield self.timeout(run, w)
            if r["kind"] == "end":
                return
            x = with_maps({k: r[k] for k in ROW})
            if x["id"] in (c.signals if r["kind"] == "signal" else c.waits):
                continue
            if r["kind"] == "signal":
                w = c.wait_for(x)
                if w is None:
                    c.keep_signal(x)
                else:
                    yield self.match(run, w, x)
            else:
                s = c.signal_for(x) if r["kind"] == "wait" else None
                if s is None:
                    # A timer is a wait for nothing: no signal has its type.
                    c.keep_wait(x if r["kind"] == "wait" else x | {"key": "timer", "type": "\0"})
                else:
                    yield self.match(run, x, s)
        yield from self.pass_time(run, c, now)
        self.save(c, stored, before)

    def due(self, run, now):
        c, stored = self.load()
        before = set(c.waits), set(c.signals)
        yield from self.pass_time(run, c, now)
        self.save(c, stored, before)

    def pass_time(self, run, c, now):
        for w in c.expired(now):
            yield self.timeout(run, w)
        self.ring_at(c.earliest(), now)

    def timeout(self, run, w):
        outputs = w["timeout_outputs"] or w["outputs"]
        return Row(run_id=run, wait_id=w["id"], event_id=None, result="timeout", outputs=outputs, input_tokens=w["input_tokens"] or 0, output_tokens=w["output_tokens"] or 0)

    def match(self, run, w, s):
        outputs = {**(w["outputs"] or {}), **(s["payload"] or {})}
        outputs["status"] = outputs.get("status") or "success"
        used = [(w[k] or 0) + (s[k] or 0) for k in ("input_tokens", "output_tokens")]
        return Row(run_id=run, wait_id=w["id"], event_id=s["id"], result="signal", outputs=outputs, input_tokens=used[0], output_tokens=used[1])

    def forget(self):
        for held in (self.open, self.unused, self.gone):
            held.clear()


def match_once(rows: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """STR-2: (run_id, wait_id, event_id, result, outputs, input_tokens, output_tokens): waits of runs with the one signal that each takes, or their timeout.

    rows have run_id, kind (wait, timer, signal or end), at (seconds) and the columns of ROW; those that a kind has no use for are null.
    A wait takes the smallest (idempotency_key, id) of the unused signals of its run that match its key and type and
    have what it requires, whether they come before or after it; of waits that want a signal the one parked
    first gets it; each signal is used once. Outputs are the wait's, overlaid by the payload, with status
    success by default, and tokens are the sums of both. A wait whose deadline comes first gives its
    timeout_outputs, or else its outputs, and no event_id; one that has neither stays. Timers give their
    outputs. A deadline has come with a later row of the run or by time (see above). A batch's rows of a run are
    taken by (at, kind, id); an id that is open already is a repeat.
    """
    return by_run(rows.select("run_id", "kind", *ROW), Matching, "run_id long, wait_id long, event_id long, result string, outputs map<string,string>, input_tokens long, output_tokens long", ticks)
