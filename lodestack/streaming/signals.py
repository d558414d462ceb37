"""Signals and lifecycles as streams. What needs state per run, with timers, is in state.py."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import folder
from ..sources.tables import merge_stream
from .state import prefixes

TERMINAL = ("completed", "failed", "cancelled")
# Ids in an array, rows that a task gathers before it makes arrays, and places that a class's signals are dealt to.
BLOCK, HELD, SALTS = 2_000, 1_000_000, 16
# The case status that an event type leads to.
STATUS_OF = {"RunQueued": "queued", "RunRunning": "running", "RunWaiting": "waiting", "RunRecovered": "queued", "RunInterrupted": "queued", "RunCompleted": "completed", "RunCompletedViaReturn": "completed", "RunFailed": "failed", "RunCancelled": "cancelled"}


def drain(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, append its rows to a table, and read that. With out and checkpoint given, a later run goes on
    where this one ended; else both are fresh folders."""
    out, checkpoint = out or folder(stream, "sink"), checkpoint or folder(stream, "stream-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def blocks(rows: DataFrame, classes=None) -> DataFrame:
    """(key, type, ids) of rows (key, type, id): the ids of each class that a task has at hand, in arrays of BLOCK at most. A row is of the class
    of its key and type, or of those that classes(key, type) gives. Keeps no state, so it goes before a join of streams."""

    def listed(held):
        t, by = pa.Table.from_batches(held).group_by(["key", "type"], use_threads=False).aggregate([("id", "list")]), {}
        for key, type_, ids in zip(t["key"].to_pylist(), t["type"].to_pylist(), t["id_list"], strict=True):
            for c in classes(key, type_) if classes else [(key, type_)]:
                by.setdefault(c, []).append(ids.values)
        for (key, type_), lists in by.items():
            ids = pa.concat_arrays(lists)
            ends = [*range(0, len(ids), BLOCK), len(ids)]
            n = len(ends) - 1
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, "string"), pa.array([type_] * n, "string"), pa.ListArray.from_arrays(ends, ids)], ["key", "type", "ids"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from listed(held)
                held, n = [], 0
        if n:
            yield from listed(held)

    return rows.select("key", "type", "id").mapInArrow(run, f"key string, type string, ids array<{rows.schema['id'].dataType.simpleString()}>")


def match_blocks(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """STR-2: the pairs of match_stream as (wait_ids, event_ids): every wait of a row goes with every signal of it, and a pair is in one row only.

    A wait is of one class, its key (or '' for any) and its type; a signal is of every class that takes it. Streams are joined by class, block by
    block, so that the state has few rows and the work in the stream hangs on the number of blocks, not of pairs. The signals of a class are
    dealt to SALTS places, each of which has all its waits, so that the class of any key and type is not one task's.
    """

    def classes(key, type_):
        return [(k, t) for k in dict.fromkeys(("", key or "")) for t in prefixes(type_ or "")]

    w = waits.select(F.col("wait_key").alias("key"), F.col("wait_type").alias("type"), F.col("wait_id").alias("id")).filter("key IS NOT NULL AND type IS NOT NULL")
    g = signals.select(F.col("signal_key").alias("key"), F.col("signal_type").alias("type"), F.col("event_id").alias("id"))
    w = blocks(w).select("key", "type", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("ids").alias("wait_ids"))
    g = blocks(g, classes).select("key", "type", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt"), F.col("ids").alias("event_ids"))
    return w.join(g, ["key", "type", "salt"]).select("wait_ids", "event_ids")


def pairs(matched: DataFrame) -> DataFrame:
    """(wait_id, event_id) of match_blocks, handed on wait by wait: higher-order functions are not compiled into the loop over the events, which
    gathers what it makes of a row, copied, before it hands on the first pair."""
    one = matched.select(F.explode(F.transform("wait_ids", lambda w: F.array(w))).alias("wait_ids"), "event_ids")
    return one.select(F.explode("wait_ids").alias("wait_id"), "event_ids").select("wait_id", F.explode("event_ids").alias("event_id"))


def spread_pairs(matched: DataFrame, per_task: int = 20_000_000) -> DataFrame:
    """pairs of a written table, whose blocks are dealt so that a task makes some per_task pairs."""
    n = matched.agg(F.sum(F.size("wait_ids").cast("long") * F.size("event_ids"))).first()[0] or 0
    dealt = matched.repartition(max(matched.sparkSession.sparkContext.defaultParallelism, -(-n // per_task)), F.xxhash64(F.col("wait_ids")[0], F.col("event_ids")[0]))
    return pairs(dealt)


def match_stream(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """STR-2: (wait_id, event_id) of parked waits and signals in either order of arrival and at any distance in time. Waits with a key take signals of that key, those without one any; '' is any type.

    There is no watermark, so that no row is late and none is given up: both sides stay in the state store, in blocks. Where the sink need
    not have the single pairs, match_blocks is far smaller.
    """
    return pairs(match_blocks(waits, signals))


def status_of(event_type) -> Column:
    """The case status that an event type leads to; null for events of steps and of the outbox, and unknown ones."""
    return F.create_map(*(F.lit(x) for kv in STATUS_OF.items() for x in kv))[event_type]


def fold(events: DataFrame) -> DataFrame:
    """(run_id, seq, status, ended) of each run from rows of the same columns: the first terminal status, else the latest one; folds of folds are folds."""
    last = F.struct("seq", "status")
    s = events.groupBy("run_id").agg(F.min(F.when(F.col("ended"), last)).alias("end"), F.max(last).alias("last"))
    s = s.withColumn("s", F.coalesce("end", "last"))
    return s.select("run_id", "s.seq", "s.status", F.col("end").isNotNull().alias("ended"))


def lifecycle(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """STR-3: (run_id, seq, status) of each run, folded from a stream of events (run_id, seq, type) in any order of arrival.

    A terminal status is final; events of steps change nothing. The result table is the state: a batch rewrites
    the buckets of its runs. With path and checkpoint given, a later run goes on.
    """
    e = stream.select("run_id", "seq", status_of(F.col("type")).alias("status")).filter("status IS NOT NULL")
    e = e.withColumn("ended", F.col("status").isin(*TERMINAL))
    return merge_stream(e, path or folder(stream, "lifecycle"), checkpoint or folder(stream, "stream-checkpoint"), "run_id", fold).select("run_id", "seq", "status")


def drop_after_terminal(events: DataFrame) -> DataFrame:
    """STR-4: events of a table up to their run's first terminal status."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = F.max(F.col("status").isin(*TERMINAL)).over(w)
    return events.withColumn("over", F.coalesce(over, F.lit(False))).filter("NOT over").drop("over")


def stream_drop_after_terminal(stream: DataFrame) -> DataFrame:
    """STR-4 as a stream of (run_id, seq, status): what arrives after a run's terminal status is ignored; by seq within a batch."""

    def run(key, frames, state):
        over = state.exists
        rows = pd.concat(list(frames)).sort_values("seq")
        if over:
            return
        ends = rows["status"].isin(TERMINAL).to_numpy().nonzero()[0]
        if len(ends):
            state.update((True,))
            rows = rows.iloc[: ends[0] + 1]
        yield rows[["run_id", "seq", "status"]]

    return stream.groupBy("run_id").applyInPandasWithState(run, "run_id long, seq long, status string", "over boolean", "append", "NoTimeout")


def newest(revisions: DataFrame) -> DataFrame:
    """(run_id, revision, status): the newest revision of each run; of equal ones the largest status."""
    return revisions.groupBy("run_id").agg(F.max(F.struct("revision", "status")).alias("s")).select("run_id", "s.revision", "s.status")


def snapshot_upsert(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """STR-6: the newest revision of each run of a stream (run_id, revision, status); older ones that come late are dropped. A batch rewrites the buckets of its runs, and reading costs the table, not its history."""
    rows = stream.select("run_id", "revision", "status")
    return merge_stream(rows, path or folder(stream, "snapshots"), checkpoint or folder(stream, "stream-checkpoint"), "run_id", newest)


def interrupt_recovery(cases: DataFrame, waits: DataFrame) -> DataFrame:
    """STR-8: after a restart, runs whose wait has a recovery owner fail as inconclusive, running ones are queued again, others stay."""
    owned = waits.filter("owned").select("run_id", F.lit(True).alias("hit")).distinct()
    j = cases.join(owned, "run_id", "left")
    hit = F.coalesce("hit", F.lit(False)) & (F.col("status") == "waiting")
    return j.select("run_id", F.when(hit, "failed").when(F.col("status") == "running", "queued").otherwise(F.col("status")).alias("status"), F.when(hit, "inconclusive").otherwise("").alias("outcome"))
