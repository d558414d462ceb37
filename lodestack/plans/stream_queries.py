"""Queries of sources, sinks and streams. Files that a query reads are first written from the given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..sources import records as r
from ..streaming import signals as s
from ..streaming import state
from .context_queries import LAST, results
from .views import query, view, with_views

Q, SQL = {}, {}
NOW = 1704067200 + 30 * 86400


def add(name, build, sql=None):
    Q[name] = build
    if sql:
        SQL[name] = with_views(sql)


def written(df, label, fmt="parquet"):
    path = s.folder(df, label)
    df.write.format(fmt).save(path)
    return path


def stream(df, label):
    """df as a stream of the files it is written to."""
    path = written(df, label)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def one_batch(df, label):
    """df as a stream of one batch, for results that hang on the order of arrival."""
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1_000_000).parquet(written(df, label))


def passes(build, *batches, label="pass"):
    """build(stream of rows, stream of ticks) run once for each (rows, seconds) on one checkpoint: the rows arrive, then it is that time. Gives the rows of all runs."""
    df = batches[0][0]
    rows, ticks, out, checkpoint = (s.folder(df, f"{label}-{x}") for x in ("rows", "ticks", "out", "checkpoint"))
    spark = df.sparkSession
    for more, seconds in batches:
        more.write.mode("append").parquet(rows)
        spark.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias("tick")).write.mode("append").parquet(ticks)
        read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)
        got = s.drain(build(read(df.schema, rows), read("tick timestamp", ticks)), out, checkpoint)
    return got


def _cases(spark, d):
    df = view(spark, d, "v_cases").select("run_id", "app_id", "status", F.lit("").alias("error"))
    full = df.join(results(view(spark, d, "v_attempts")), "run_id", "left")
    return r.read_cases(spark, written(full, "cases", "json"))


add("src_1_read_cases", lambda sp, d: _cases(sp, d).select("run_id", "app_id", "status", F.size("inputs").cast("long").alias("n_inputs"), F.size("results").cast("long").alias("n_results")),
    f"SELECT c.run_id, app_id, status, CAST(CASE WHEN n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_inputs, coalesce(n, 0) AS n_results FROM v_cases c LEFT JOIN (SELECT run_id, count(*) AS n FROM ({LAST}) AS l GROUP BY run_id) x ON c.run_id = x.run_id")


def _log(spark, d):
    e = query(spark, d, "SELECT event_id AS id, user_id AS run_id, event_type AS type, concat('', event_id) AS created_at, props AS payload FROM events")
    lines = e.select(F.when(F.col("id") % 50 == 0, "{broken").when(F.col("id") % 50 == 1, " ").otherwise(F.to_json(F.struct("*"))).alias("value"))
    good, bad = r.read_event_log(spark, written(lines, "log", "text"))
    return good.select("id", "run_id", "type", "payload").unionByName(bad.select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("run_id"), F.lit("corrupt").alias("type"), F.col("value").alias("payload")))


add("src_2_read_event_log", _log, "SELECT event_id AS id, user_id AS run_id, event_type AS type, props AS payload FROM events WHERE event_id % 50 > 1 UNION ALL SELECT -1, -1, 'corrupt', '{broken' FROM events WHERE event_id % 50 = 0")
add("src_4_explode_results", lambda sp, d: r.explode_results(results(view(sp, d, "v_attempts")))[0], f"SELECT run_id, node_id, 'status' AS field, status AS value FROM ({LAST}) AS a UNION ALL SELECT run_id, node_id, 'tokens', CAST(tokens AS VARCHAR) FROM ({LAST}) AS b")
add("src_4b_explode_history", lambda sp, d: r.explode_results(results(view(sp, d, "v_attempts")))[1].select("run_id", "node_id", "pos", "value"), "SELECT run_id, node_id, iteration - 1 AS pos, CAST(output_tokens AS VARCHAR) AS value FROM v_attempts")
add("src_5_stream_event_log", lambda sp, d: s.drain(stream(query(sp, d, "SELECT event_id, user_id, event_type FROM events"), "events")), "SELECT event_id, user_id, event_type FROM events")


def _append(spark, d):
    """Two thirds of the log by hand, then all of it, null ids too, as a stream that comes twice."""
    e = query(spark, d, "SELECT CASE WHEN event_id > 0 THEN event_id END AS id, event_type AS type FROM events")
    path = s.folder(e, "append")
    r.append_events(e.filter("id % 3 <> 0"), path)
    for _ in range(2):
        r.append_stream(stream(e.union(e.filter("id IS NULL OR id % 2 = 0")), "append-events"), path, s.folder(e, "append-checkpoint"))
    return spark.read.schema(e.schema).parquet(path).select("id", "type")


add("src_6_append_events", _append, "SELECT CASE WHEN event_id > 0 THEN event_id END AS id, event_type AS type FROM events")
STORED = "SELECT run_id, CAST(run_id % 3 AS BIGINT) AS revision, status FROM v_cases WHERE status <> 'queued'"
# Several rows of one run, at stored, older and newer revisions, some of them equal.
INCOMING = "SELECT run_id, revision % 3 AS revision, status, revision // 2 AS seq FROM v_revisions UNION ALL SELECT run_id, CAST(run_id % 3 AS BIGINT), status, CAST(1 AS BIGINT) FROM v_cases UNION ALL SELECT run_id, CAST(run_id % 3 AS BIGINT), status, CAST(1 AS BIGINT) FROM v_cases"
JUDGED = f"""SELECT i.*, c.revision AS cr, c.status AS cs, coalesce(i.revision = coalesce(c.revision, 0) AND NOT coalesce(c.status IN ('completed', 'failed', 'cancelled') AND c.status <> i.status, false), false) AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, revision, status, seq ORDER BY seq) AS copy FROM ({INCOMING}) AS r) i LEFT JOIN ({STORED}) c ON c.run_id = i.run_id"""
RANKED = f"SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY run_id, ok ORDER BY seq, status, copy) END AS turn FROM ({JUDGED}) AS u"
SPARK_INCOMING = INCOMING.replace("revision // 2", "revision DIV 2")
add("src_7_upsert", lambda sp, d: r.upsert_revisions(query(sp, d, STORED), query(sp, d, SPARK_INCOMING), "seq")[0],
    f"SELECT coalesce(c.run_id, w.run_id) AS run_id, coalesce(w.revision + 1, c.revision) AS revision, coalesce(w.status, c.status) AS status FROM ({STORED}) c FULL JOIN (SELECT * FROM ({RANKED}) AS x WHERE turn = 1) w ON c.run_id = w.run_id")
add("src_7b_rejects", lambda sp, d: r.upsert_revisions(query(sp, d, STORED), query(sp, d, SPARK_INCOMING), "seq")[1], f"SELECT run_id, revision, status, 'stale' AS reason FROM ({RANKED}) AS x WHERE turn IS NULL OR turn > 1")


def _evidence(spark, d):
    c = query(spark, d, "SELECT app_id % 20 AS app_id, run_id, status FROM v_cases")
    path = s.folder(c, "evidence")
    r.write_evidence(c, path)
    return spark.read.schema("app_id long, run_id long, status string").json(path).select("app_id", "run_id", "status")


add("src_8_write_evidence", _evidence, "SELECT app_id % 20 AS app_id, run_id, status FROM v_cases")
ENVELOPED = "SELECT v.run_id, v.revision, v.status, c.app_id, concat('user-', c.app_id) AS initiator FROM v_revisions v JOIN v_cases c ON c.run_id = v.run_id"
ENVELOPES = f"SELECT app_id, concat('runs/', run_id, '.json') AS path, initiator, run_id, revision, concat('{{\"run_id\":', run_id, ',\"revision\":', revision, ',\"status\":\"', status, '\"}}') AS run FROM ({ENVELOPED}) AS x"
add("src_9_snapshots", lambda sp, d: r.snapshots(query(sp, d, ENVELOPED)), ENVELOPES)
add("src_9b_stream_snapshots", lambda sp, d: s.drain(r.snapshots(stream(query(sp, d, ENVELOPED), "envelopes"))), ENVELOPES)
# The signals of runs, with repeats. A third of the runs ends after the first pass; in the second, all signals come again and new ones arrive, some of them of ended runs.
RUN_KEYS = "SELECT user_id AS run_id, 'signal' AS kind, event_id, concat('k-', CAST(floor(value) AS BIGINT)) AS idempotency_key, CAST(1704067200 + event_id * 259 AS BIGINT) AS unix FROM events"
RUN_ENDS = "SELECT DISTINCT user_id, 'end', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(4000000000 AS BIGINT) FROM events WHERE user_id % 3 = 0"
RUN_LATE = RUN_KEYS.replace("'k-'", "'late-', event_type, '-'")
add("str_1_dedupe_signals", lambda sp, d: passes(partial(state.first_signals, shards=state.SHARDS), (query(sp, d, f"{RUN_KEYS} UNION ALL {RUN_ENDS.replace('VARCHAR', 'STRING')}").withColumnRenamed("unix", "at"), NOW), (query(sp, d, f"{RUN_KEYS} UNION ALL {RUN_LATE}").withColumnRenamed("unix", "at"), 2 * NOW)),
    f"SELECT run_id, idempotency_key, arg_min(event_id, (unix, event_id)) AS event_id FROM (SELECT * FROM ({RUN_KEYS}) AS a UNION ALL SELECT * FROM ({RUN_LATE}) AS b WHERE run_id % 3 <> 0) AS x GROUP BY run_id, idempotency_key")
WAITS = "SELECT wait_id, correlation_key AS wait_key, signal_type AS wait_type FROM v_waits WHERE kind = 'signal'"
SIGNALS = "SELECT event_id, correlation_key AS signal_key, signal_type FROM v_signals"
add("str_2_match_stream", lambda sp, d: s.spread_pairs(s.drain(s.match_blocks(stream(query(sp, d, WAITS), "waits"), stream(query(sp, d, SIGNALS), "signals")))),
    "SELECT wait_id, event_id FROM v_waits w JOIN v_signals s ON w.kind = 'signal' AND (w.correlation_key = '' OR w.correlation_key = s.correlation_key) AND (w.signal_type = '' OR w.signal_type = s.signal_type OR starts_with(s.signal_type, concat(w.signal_type, '.')))")
# Ten waits a run, each with a key of its own and up to seven signals of that key. Rows arrive in two passes, by time.
FIT_WAITS = """SELECT wait_id // 10 AS run_id, kind, wait_id AS id, parked_unix AS unix, concat('w', wait_id) AS key, signal_type AS type, needs_outcome, CASE WHEN resume_unix > 0 THEN resume_unix END AS deadline,
  wait_id % 3 <> 0 AS has_timeout, wait_id % 7 AS input_tokens, wait_id % 5 AS output_tokens FROM v_waits"""
FIT_SIGNALS = "SELECT event_id // 70 AS run_id, event_id AS id, observed_unix AS unix, concat('w', event_id // 7) AS key, signal_type AS type, idempotency_key, payload_outcome, payload_reason, event_id % 4 AS input_tokens, event_id % 6 AS output_tokens FROM v_signals"
MIDDLE = 1704067200 + 4 * 86400


def _fit_rows(spark, d):
    text = lambda x: x.replace("//", "DIV")
    w = query(spark, d, text(FIT_WAITS)).select("run_id", F.when(F.col("kind") == "signal", "wait").otherwise("timer").alias("kind"), "id", "unix", "key", "type", "deadline", "input_tokens", "output_tokens",
        F.when(F.col("needs_outcome"), F.array(F.lit("outcome"), F.lit(" "))).alias("required"), F.create_map(F.lit("outcome"), F.lit("none"), F.lit("status"), F.lit("")).alias("outputs"),
        F.when(F.col("has_timeout"), F.create_map(F.lit("status"), F.lit("timeout"))).alias("timeout_outputs"))
    g = query(spark, d, text(FIT_SIGNALS)).select("run_id", F.lit("signal").alias("kind"), "id", "unix", "key", "type", "idempotency_key", F.create_map(F.lit("outcome"), F.col("payload_outcome"), F.lit("reason"), F.col("payload_reason")).alias("payload"), "input_tokens", "output_tokens")
    return w.unionByName(g, allowMissingColumns=True).withColumns({"idempotency_key": F.coalesce("idempotency_key", F.lit(""))}).withColumnRenamed("unix", "at")


def _match_stateful(spark, d):
    rows = _fit_rows(spark, d)
    got = passes(state.match_once, (rows.filter(F.col("at") <= MIDDLE), MIDDLE), (rows.filter(F.col("at") > MIDDLE), 100 * NOW))
    return got.select("run_id", "wait_id", "event_id", "result", F.col("outputs.status").alias("status"), F.col("outputs.outcome").alias("outcome"), F.col("outputs.reason").alias("reason"), "input_tokens", "output_tokens")


add("str_2b_match_stateful", _match_stateful,
    f"""WITH w AS ({FIT_WAITS}), s AS ({FIT_SIGNALS}),
f AS (SELECT w.id AS wait_id, s.*, s.unix <= w.unix AS early FROM w JOIN s ON w.kind = 'signal' AND s.key = w.key AND (w.type = '' OR w.type = s.type OR starts_with(s.type, concat(w.type, '.'))) AND (NOT w.needs_outcome OR s.payload_outcome <> '') AND (s.unix <= w.unix OR w.deadline IS NULL OR s.unix < w.deadline)),
t AS (SELECT *, row_number() OVER (PARTITION BY wait_id ORDER BY early DESC, CASE WHEN early THEN 0 ELSE unix END, CASE WHEN early THEN idempotency_key ELSE '' END, id) AS k FROM f)
SELECT w.run_id, w.id AS wait_id, t.id AS event_id, CASE WHEN t.id IS NULL THEN 'timeout' ELSE 'signal' END AS result, CASE WHEN t.id IS NOT NULL THEN 'success' WHEN w.kind = 'signal' AND has_timeout OR w.kind = 'timer' AND has_timeout THEN 'timeout' ELSE '' END AS status,
  CASE WHEN t.id IS NOT NULL THEN t.payload_outcome WHEN NOT has_timeout THEN 'none' END AS outcome, t.payload_reason AS reason, w.input_tokens + coalesce(t.input_tokens, 0) AS input_tokens, w.output_tokens + coalesce(t.output_tokens, 0) AS output_tokens
FROM w LEFT JOIN t ON t.wait_id = w.id AND t.k = 1 WHERE t.id IS NOT NULL OR w.deadline IS NOT NULL""")
# Events recoded to all types that the log of runs knows: of runs, of steps and of the outbox.
TYPES = ["RunQueued", "RunRunning", "NodeStarted", "RunWaiting", "SignalReceived", "TimerFired", "RunRecovered", "NodeResetFromWaiting", "RunInterrupted", "WaitingNodeInterruptedByRestart", "CallbackFailed", "CallbackDelivered"]
ENDS = ["RunCompleted", "RunCompletedViaReturn", "RunFailed", "RunCancelled"]
TYPED = f"SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type = 'error' AND value > 200 THEN CASE event_id % 4 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ENDS))} END ELSE CASE event_id % 12 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))} END END AS type FROM events"
FOLDED = f"SELECT run_id, seq, CASE type {' '.join(f"WHEN '{t}' THEN '{x}'" for t, x in s.STATUS_OF.items())} END AS status FROM ({TYPED}) AS x"
LIFE = "SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'completed' WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'view' THEN 'waiting' ELSE 'running' END AS status FROM events"
add("str_3_lifecycle", lambda sp, d: s.lifecycle(stream(query(sp, d, TYPED), "life")),
    f"SELECT run_id, coalesce(min(seq) FILTER (status IN ('completed', 'failed', 'cancelled')), max(seq)) AS seq, coalesce(arg_min(status, seq) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, seq)) AS status FROM ({FOLDED}) AS x WHERE status IS NOT NULL GROUP BY run_id")
add("str_4_drop_after_terminal", lambda sp, d: s.drop_after_terminal(query(sp, d, LIFE)),
    f"SELECT x.run_id, seq, status FROM ({LIFE}) AS x LEFT JOIN (SELECT run_id, min(seq) AS e FROM ({LIFE}) AS y WHERE status IN ('completed', 'failed') GROUP BY run_id) z ON x.run_id = z.run_id WHERE e IS NULL OR seq <= e")
add("str_4b_stream_drop", lambda sp, d: s.drain(s.stream_drop_after_terminal(one_batch(query(sp, d, LIFE), "life"))),
    f"SELECT x.run_id, seq, status FROM ({LIFE}) AS x LEFT JOIN (SELECT run_id, min(seq) AS e FROM ({LIFE}) AS y WHERE status IN ('completed', 'failed') GROUP BY run_id) z ON x.run_id = z.run_id WHERE e IS NULL OR seq <= e")
# All waits arrive, and arrive again in a second pass at a later time, in which runs whose case has ended are reported too.
TIMERS = "SELECT run_id, 'wait' AS kind, wait_id, resume_unix FROM v_waits"
OVER = "SELECT run_id, 'end', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM v_cases WHERE status IN ('completed', 'failed', 'cancelled')"
SOON = 1704067200 + 2 * 86400
add("str_5_fire_timers", lambda sp, d: passes(state.fire_timers, (query(sp, d, TIMERS), SOON), (query(sp, d, f"{TIMERS} UNION ALL {OVER}"), NOW)).drop("run_id"),
    f"SELECT wait_id, resume_unix, CAST(CASE WHEN resume_unix <= {SOON} THEN {SOON} ELSE {NOW} END AS BIGINT) AS fired_unix FROM v_waits WHERE resume_unix > 0 AND (resume_unix <= {SOON} OR resume_unix <= {NOW} AND run_id NOT IN (SELECT run_id FROM v_cases WHERE status IN ('completed', 'failed', 'cancelled')))")
add("str_6_snapshot_upsert", lambda sp, d: s.snapshot_upsert(stream(view(sp, d, "v_revisions"), "revisions")), "SELECT run_id, max(revision) AS revision, arg_max(status, revision) AS status FROM v_revisions GROUP BY run_id")
# What is due at first is delivered or fails one second later; in the second pass callbacks arrive again, with these results.
FIRST = 1704067200 + 900


def _outbox(spark, d):
    calls = view(spark, d, "v_callbacks").withColumn("ok", F.lit(None).cast("boolean")).withColumn("at", F.lit(None).cast("long"))
    names = ["run_id", "attempts", "status", "url", "delivered", "last_attempt_unix"]
    split = lambda rows, ticks: state.outbox(rows.filter("ok IS NULL").select(names), rows.filter("ok IS NOT NULL").select("run_id", "attempts", "ok", "at"), ticks)
    rows, ticks, out, checkpoint = (s.folder(calls, f"outbox-{x}") for x in ("rows", "ticks", "out", "checkpoint"))
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)
    for more, seconds in ((calls, FIRST), (None, NOW)):
        if more is None:
            results = sent.select("run_id", "attempts", (F.col("run_id") % 2 == 0).alias("ok"), F.lit(FIRST + 1).cast("long").alias("at"))  # noqa: F821
            more = calls.unionByName(results, allowMissingColumns=True)
        more.write.mode("append").parquet(rows)
        spark.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias("tick")).write.mode("append").parquet(ticks)
        sent = s.drain(split(read(calls.schema, rows), read("tick timestamp", ticks)), out, checkpoint)
    return sent


DUE = "SELECT run_id, attempts, last_attempt_unix + least(attempts, 60) AS next_unix FROM v_callbacks WHERE status IN ('completed', 'failed', 'cancelled') AND trim(url) <> '' AND NOT delivered"
add("str_7_outbox", _outbox,
    f"""SELECT *, CAST(CASE WHEN next_unix <= {FIRST} THEN {FIRST} ELSE {NOW} END AS BIGINT) AS sent_unix FROM ({DUE}) AS x WHERE next_unix <= {NOW}
    UNION ALL SELECT run_id, attempts + 1, {FIRST} + 1 + least(attempts + 1, 60), CAST({NOW} AS BIGINT) FROM ({DUE}) AS y WHERE next_unix <= {FIRST} AND run_id % 2 <> 0""")
add("str_8_interrupt_recovery", lambda sp, d: s.interrupt_recovery(query(sp, d, "SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'running' ELSE status END AS status FROM v_cases"), query(sp, d, "SELECT run_id, wait_id % 2 = 0 AS owned FROM v_waits")),
    """SELECT c.run_id, CASE WHEN h AND st = 'waiting' THEN 'failed' WHEN st = 'running' THEN 'queued' ELSE st END AS status, CASE WHEN h AND st = 'waiting' THEN 'inconclusive' ELSE '' END AS outcome
       FROM (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'running' ELSE status END AS st FROM v_cases) c LEFT JOIN (SELECT DISTINCT run_id AS r, true AS h FROM v_waits WHERE wait_id % 2 = 0) w ON c.run_id = w.r""")
