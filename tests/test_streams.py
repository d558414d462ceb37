"""Streams with state per run against serial runs, over several runs on one checkpoint, and tables that batches are merged into."""

import os
import random
import time
from itertools import count

import pytest
from pyspark.sql import functions as F

from lodestack.sources import tables
from lodestack.streaming import signals as streams
from lodestack.streaming import state


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store per partition: two are enough."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture
def run(spark, tmp_path):
    """run(build, schema, (rows, seconds), ...): the rows of build(stream, ticks) after each pass, all on one checkpoint."""

    def go(build, schema, *batches):
        out, name = [], f"{tmp_path}/{next(numbers)}"
        for rows, seconds in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{name}-rows")
            spark.createDataFrame([(seconds,)], "s long").select(F.timestamp_seconds("s").alias("tick")).write.mode("append").parquet(f"{name}-ticks")
            got = streams.drain(build(spark.readStream.schema(schema).parquet(f"{name}-rows"), spark.readStream.schema("tick timestamp").parquet(f"{name}-ticks")), f"{name}-out", f"{name}-checkpoint")
            out.append(sorted((tuple(r) for r in got.collect()), key=str))
        return out

    numbers = count()
    return go


ROWS = f"run_id long, kind string, {state.ROW_TYPES}"


def row(run, kind, id, at, key="", type="", needs=False, deadline=None, idem="", payload=None, outputs=None, late=None, tokens=0):
    return (run, kind, id, at, key, type, ["outcome"] if needs else None, outputs, late, deadline, idem, payload, tokens, tokens)


def run_rows(rng, runs=6, n=40):
    types, rows = ["", "a", "b", "a.x"], []
    for i in range(n * runs):
        r, at = rng.randrange(runs), rng.randint(0, 300)
        if rng.random() < 0.5:
            rows.append(row(r, "wait", i, at, rng.choice(["", "k1", "k2"]), rng.choice(types), rng.random() < 0.5, rng.choice([None, at + rng.randint(0, 100)]), outputs={"x": "1"}))
        else:
            rows.append(row(r, "signal", i, at, rng.choice(["k1", "k2", "k3"]), rng.choice(["a", "a.x", "ab", "b"]), idem=f"i{rng.randint(0, 9)}", payload={"outcome": rng.choice(["", " ", "yes"])}))
    return rows


def serial_match(rows, end=1000):
    out, waits, signals = [], {}, {}
    runs = {r[0] for r in rows}
    for r in [*sorted(rows, key=lambda r: (r[3], state.RANK[r[1]], r[2])), *((x, "clock", None, end) for x in runs)]:
        w, s = waits.setdefault(r[0], []), signals.setdefault(r[0], [])
        out += [(r[0], x[2], None, "timeout") for x in w if x[9] is not None and x[9] <= r[3]]
        w[:] = [x for x in w if x[9] is None or x[9] > r[3]]
        (w if r[1] == "wait" else s).append(r) if r[1] != "clock" else None
        for x in list(w):
            fits = sorted((y for y in s if x[4] in ("", y[4]) and (x[5] in ("", y[5]) or y[5].startswith(x[5] + ".")) and (not x[6] or y[11]["outcome"].strip())), key=lambda y: (y[10], y[2]))
            if fits:
                w.remove(x)
                s.remove(fits[0])
                out.append((r[0], x[2], fits[0][2], "signal"))
    return sorted(out, key=str)


def test_matches(run):
    """Against a serial run, and once more in two runs that go on from one checkpoint."""
    rows = run_rows(random.Random(7))
    for parts in ([(rows, 1000)], [([r for r in rows if r[3] <= 150], 1), ([r for r in rows if r[3] > 150], 1000)]):
        assert [r[:4] for r in run(state.match_once, ROWS, *parts)[-1]] == serial_match(rows)
    assert {r[3] for r in serial_match(rows)} == {"signal", "timeout"}


def test_outputs_of_matches_and_timeouts(run):
    waits = [row(1, "wait", 1, 10, "k", "a", outputs={"status": " ", "x": "1", "y": "1"}, tokens=5), row(1, "wait", 2, 10, "q", deadline=50, outputs={"x": "2"}, late={"status": "late"}), row(1, "wait", 3, 10, "q", deadline=50, outputs={"x": "3"}), row(1, "wait", 4, 10, "z", deadline=50), row(1, "timer", 5, 10, deadline=60, outputs={"x": "5"}), row(None, "wait", 6, 10, "q", deadline=70, outputs={"x": "6"})]
    early = [row(1, "signal", 9, 5, "k", "a.b", payload={"x": "9", "status": ""}, tokens=2)]
    first, second, third = run(state.match_once, ROWS, (early, 1), (waits, 55), ([row(1, "signal", 8, 90, "z", "any"), row(1, "end", 0, 95), row(1, "wait", 7, 96, outputs={}, deadline=97)], 100))
    key = lambda r: (r[1], r[2], r[3], dict(r[4]), r[5])
    assert first == []
    assert sorted(map(key, second)) == sorted([(1, 9, "signal", {"status": "success", "x": "9", "y": "1"}, 7), (2, None, "timeout", {"status": "late"}, 0), (3, None, "timeout", {"x": "3"}, 0)], key=lambda r: r[0])
    # A wait without outputs stays beyond its deadline, a signal comes to it still; after its end a run does nothing.
    assert {r[1] for r in third} - {r[1] for r in second} == {4, 5, 6} and [r[2] for r in third if r[1] == 4] == [8]


def test_matching_is_linear():
    """Waits that no signal fits and signals that no wait takes, of one run: each is looked at once."""
    seconds = []
    for n in (10_000, 40_000):
        c, began = state.Correlation(), time.time()
        for i in range(n):
            w = {"id": i, "at": i, "key": "k", "type": "a", "required": None, "outputs": {}, "timeout_outputs": None, "deadline": n + i}
            assert c.signal_for(w) is None
            c.keep_wait(w)
            s = {"id": i, "key": "other", "type": "a.b.c", "idempotency_key": str(i), "payload": {}}
            assert c.wait_for(s) is None
            c.keep_signal(s)
        assert sum(1 for _ in c.expired(10 * n)) == n
        seconds.append(time.time() - began)
    assert seconds[1] < 12 * seconds[0]


def test_state_is_written_once_and_dropped(run):
    """Many passes that add and remove: what is stored stays in proportion to what is open."""
    batches = [([row(1, "wait", 100 * p + i, p, f"k{p}") for i in range(20)] + [row(1, "signal", 100 * (p - 1) + i, p, f"k{p - 1}", "a", idem=f"{i:02}") for i in range(20)], 1) for p in range(1, 5)]
    got = run(state.match_once, ROWS, *batches)[-1]
    assert sorted((r[1], r[2]) for r in got) == sorted((100 * p + i, 100 * p + i) for p in range(1, 4) for i in range(20))


TIMED = "run_id long, kind string, wait_id long, resume_unix long"


def test_timers_fire_later(run):
    """Not yet due when they come, due in a later run, once each; none of a run that ended, none without a deadline."""
    rows = [(1, "wait", 1, 100), (1, "wait", 2, 200), (2, "wait", 3, 200), (3, "wait", 4, 200), (3, "wait", 5, 0), (None, "wait", 6, 200), (1, "wait", 2**60 + 1, 200)]
    first, again, late = run(state.fire_timers, TIMED, (rows, 150), ([*rows, (3, "end", None, None)], 160), ([(4, "wait", 7, 120), (3, "wait", 8, 120)], 300))
    assert first == again == [(1, 1, 100, 150)]
    assert sorted((r[1], r[3]) for r in late) == [(1, 150), (2, 300), (3, 300), (6, 300), (7, 160), (2**60 + 1, 300)]


def test_timers_by_the_clock(spark, tmp_path):
    """Without ticks time is the cluster's: a wait that is due now fires, one due in a day does not."""
    at, now = str(tmp_path / "rows"), int(time.time())
    spark.createDataFrame([(1, "wait", 1, now - 5), (1, "wait", 2, now + 86400)], TIMED).write.parquet(at)
    q = state.fire_timers(spark.readStream.schema(TIMED).parquet(at)).writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while time.time() < until and not (q.lastProgress and q.lastProgress["batchId"] >= 2):
            time.sleep(1)
    finally:
        q.stop()
    assert [r["wait_id"] for r in spark.read.parquet(f"{at}-out").collect()] == [1]


CALLS = "run_id long, status string, url string, attempts long, delivered boolean, last_attempt_unix long, ok boolean, at long"


def test_callbacks_come_again(run):
    call = lambda i, attempts=0, at=100, **k: (i, k.get("status", "failed"), k.get("url", "u"), attempts, k.get("delivered", False), at, None, None)
    result = lambda i, attempts, ok, at: (i, None, None, attempts, None, None, ok, at)
    build = lambda rows, ticks: state.outbox(rows.filter("at IS NULL").drop("ok", "at"), rows.filter("at IS NOT NULL").select("run_id", "attempts", "ok", "at"), ticks)
    calls = [call(1), call(2, 3, 148), call(3, url=" "), call(4, status="waiting"), call(5, delivered=True), call(6, 70, 100)]
    steps = run(build, CALLS, (calls, 150), (calls, 151), ([result(1, 0, False, 152), result(6, 70, True, 152)], 152), ([result(2, 3, False, 160)], 153), ([*calls, result(1, 1, True, 154)], 400))
    assert steps[0] == [(1, 0, 100, 150)]
    assert steps[1] == [*steps[0], (2, 3, 151, 151)]
    # Run 6 was in its back-off, of a minute at most, but has been delivered in the meantime.
    assert steps[2] == steps[1]
    assert steps[3] == sorted([*steps[2], (1, 1, 153, 153)], key=str)
    assert steps[4] == sorted([*steps[3], (2, 4, 164, 400)], key=str)


def test_runs_share_the_state_of_a_shard(run):
    """Several hundred runs in one shard give each what it gives alone, over passes in which some end."""
    n = 300
    calls = [(i, "failed", "u", i % 3, False, 100, None, None) for i in range(n)]
    results = [(i, None, None, i % 3, None, None, i % 2 == 0, 150) for i in range(n) if i % 3 != 2]

    def build(rows, ticks):
        return state.outbox(rows.filter("at IS NULL").drop("ok", "at"), rows.filter("at IS NOT NULL").select("run_id", "attempts", "ok", "at"), ticks, shards=1)

    first, second, third = run(build, CALLS, (calls, 101), (results, 140), (calls, 400))
    want = {(i, i % 3, 100 + i % 3) for i in range(n)}
    assert {r[:3] for r in first} == {x for x in want if x[2] <= 101}
    ended = {i for i in range(n) if i % 3 != 2 and i % 2 == 0}
    assert {r[:3] for r in second} == {x for x in want if x[0] not in ended or x[2] <= 101}
    again = {(i, i % 3 + 1, 150 + i % 3 + 1) for i in range(n) if i % 3 != 2 and i not in ended}
    assert {r[:3] for r in third} == {r[:3] for r in second} | again and len(third) == len(set(third))


KEYED = "run_id long, kind string, event_id long, idempotency_key string, at long"


def test_late_keys_are_kept(run, spark, tmp_path):
    day = 86400
    rows = [(1, "signal", 1, "a", 400 * day), (1, "signal", 2, "a", 500 * day), (2, "signal", 3, "a", 900 * day)]
    late = [(1, "signal", 4, "c", 5), (1, "signal", 5, "a", 1), (2, "end", None, None, 901 * day), (2, "signal", 6, "b", 900 * day), (2, "signal", 7, "d", 902 * day)]
    first, second, third = run(state.first_signals, KEYED, (rows, 1000 * day), (late, 1001 * day), ([(2, "signal", 8, "e", 3), (1, "signal", 9, "f", 3)], 1002 * day))
    assert first == [(1, "a", 1), (2, "a", 3)]
    assert second == sorted([*first, (1, "c", 4), (2, "b", 6)])
    assert third == sorted([*second, (1, "f", 9)])


def test_first_signals_of_a_shard(run):
    """Runs that share a shard give what each gives alone, over passes in which some end, and the store is asked a few times for all of them."""
    rng = random.Random(5)
    batches = [[(rng.randrange(40), "signal", 1000 * p + i, rng.choice("abcdefgh"), rng.randrange(50)) for i in range(300)] + [(r, "end", None, None, 25) for r in range(p, 40, 7)] for p in range(3)]
    passed = [(b, 1000 + i) for i, b in enumerate(batches)]
    assert run(lambda rows, ticks: state.first_signals(rows, ticks, shards=1), KEYED, *passed) == run(state.first_signals, KEYED, *passed)

    class Log(list):
        calls = 0

        def get(self):
            self.calls += 1
            return iter(self)

        def appendList(self, rows):
            self.calls += 1
            self.extend(rows)

    p = state.FirstSignalsOfShard(False)
    p.log = Log()
    named = [dict(zip(("run_id", "kind", "event_id", "idempotency_key", "at"), r, strict=True)) for r in batches[0]]
    by = {x: [r for r in named if r["run_id"] == x] for x in range(40)}
    p.log.put = lambda rows: p.log.__init__(rows)
    assert list(p.step(by, 0)) and p.log.calls == 2 and len(p.log) == 40
    assert not list(p.step({x: [r for r in rows if r["kind"] == "signal"] for x, rows in by.items() if x % 7}, 0))
    # Runs that have ended leave a row without keys.
    list(p.step({x: [{"run_id": x, "kind": "end", "event_id": None, "idempotency_key": None, "at": 99}] for x in range(40)}, 0))
    assert sorted(p.log) == [(x, None, True) for x in range(40)]


def test_state_falls_when_runs_end(spark, tmp_path):
    """The state store's own count of rows: one per key while a run is open, one per run once it has ended."""
    at, rows = str(tmp_path / "rows"), []
    for batch in ([(r, "signal", i, f"k{i}", i) for r in range(10) for i in range(30)], [(r, "end", None, None, 100) for r in range(10)]):
        spark.createDataFrame(batch, KEYED).coalesce(1).write.mode("append").parquet(at)
        q = state.first_signals(spark.readStream.schema(KEYED).parquet(at)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert rows[0] == 300 and rows[1] == 10


def test_lifecycle_by_event_types(spark, tmp_path):
    schema, at = "run_id long, seq long, type string", str(tmp_path / "rows")
    batches = [[(1, 1, "RunQueued"), (1, 3, "NodeStarted"), (1, 2, "RunRunning"), (2, 9, "RunCompletedViaReturn"), (3, 1, "Unknown")], [(1, 5, "CallbackFailed"), (2, 10, "RunFailed"), (2, 11, "RunRunning"), (None, 1, "RunWaiting")], [(2, 4, "RunCancelled"), (1, 4, "RunInterrupted")]]
    for b in batches:
        spark.createDataFrame(b, schema).write.mode("append").parquet(at)
        got = streams.lifecycle(spark.readStream.schema(schema).parquet(at), str(tmp_path / "table"), str(tmp_path / "c"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 4, "queued"), (2, 4, "cancelled"), (None, 1, "waiting")]
    (tmp_path / "nothing").mkdir()
    assert streams.lifecycle(spark.readStream.schema(schema).parquet(str(tmp_path / "nothing"))).count() == 0


def test_tables_do_not_grow_with_batches(spark, tmp_path):
    """Ten batches: rows are the newest revisions, files stay as many as buckets, and a batch leaves the buckets alone that it has no rows of."""
    path, rng, want, files = str(tmp_path / "table"), random.Random(3), {}, []
    schema = "run_id long, revision long, status string"
    for epoch in range(10):
        rows = [(rng.randrange(40), rng.randrange(20), rng.choice("abc")) for _ in range(30)]
        for _ in range(2):  # the second time as after a failure
            touched = tables.merge_batch(spark.createDataFrame(rows, schema), epoch, path, "run_id", streams.newest, 8)
        for r, *x in rows:
            want[r] = max(want.get(r, [-1, ""]), x)
        got = tables.read_table(spark, path, schema)
        assert sorted(map(list, got.collect())) == sorted([r, *x] for r, x in want.items())
        files.append(sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names))
        assert set(touched) <= set(range(8))
    assert max(files) <= 8 and len(tables.versions(spark, path)) <= 8
    before = tables.versions(spark, path)
    touched = tables.merge_batch(spark.createDataFrame([(1, 99, "z")], schema), 10, path, "run_id", streams.newest, 8)
    assert len(touched) == 1 and {b for b, e in tables.versions(spark, path).items() if before[b] != e} == set(touched)
    # An epoch that was not completed does not count.
    os.makedirs(f"{path}/epoch=11/bucket=0")
    assert tables.read_table(spark, path, schema).count() == len(want)
