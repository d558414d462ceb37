"""Correlation of parked waits with signals, and other joins over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import folder
from ..sources.tables import placed
from .context import referenced_fields

# Signals of one key that one task joins; keys with more are salted.
PER_SALT = 1_000_000
# Signals that a task of assign takes at a time, and lanes of keys that do not compete.
BLOCK, LANES = 500_000, 96


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = folder(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def type_matches(wait_type: Column, signal_type: Column) -> Column:
    """Empty, equal, or a dotted prefix: foo takes foo.bar, not foobar."""
    return (wait_type == "") | (wait_type == signal_type) | signal_type.startswith(F.concat(wait_type, F.lit(".")))


def dotted_match(wait_type: str, signal_type: str) -> bool:
    """type_matches for values."""
    return wait_type in ("", signal_type) or signal_type.startswith(f"{wait_type}.")


def type_prefixes(signal_type: Column) -> Column:
    """The wait types that take a signal: every dotted prefix of its type, and '' for waits of any type."""
    parts = F.split(signal_type, r"\.")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))


def match_signals(waits: DataFrame, signals: DataFrame, per_salt: int = PER_SALT) -> DataFrame:
    """JON-1: (wait_id, event_id) of all pairs of signal waits and their signals.

    Waits with a key join on it, waits of any key on the prefixes of a signal's type. Keys and types of more
    than per_salt signals are salted by their number; those are at most one for so many signals, so that the
    table of them, which is broadcast, stays small. match_totals and first_match make no pairs.
    """
    w = waits.filter("kind = 'signal'").select("wait_id", F.col("correlation_key").alias("key"), F.col("signal_type").alias("wtype"))
    s = signals.select("event_id", F.col("correlation_key").alias("key"), F.col("signal_type").alias("stype"))

    def salted(left, right, on):
        hot = right.groupBy(on).agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts")).filter("salts > 1")
        salts = F.coalesce("salts", F.lit(1))
        every = left.join(F.broadcast(hot), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        one = right.join(F.broadcast(hot), on, "left").withColumn("salt", F.pmod(F.xxhash64("event_id"), salts).cast("int")).drop("salts")
        return every.join(one, [on, "salt"])

    on_key = salted(w.filter("key <> ''"), s, "key").filter(type_matches(F.col("wtype"), F.col("stype")))
    prefixed = s.select("event_id", F.explode(type_prefixes(F.col("stype"))).alias("wtype"))
    on_type = salted(w.filter("key = ''").select("wait_id", "wtype"), prefixed, "wtype")
    return on_key.select("wait_id", "event_id").union(on_type.select("wait_id", "event_id"))


def by_class(signals: DataFrame, *aggs: Column, extra: list[str] = ()) -> DataFrame:
    """Signals summed up by the classes of waits that take them: (scope, key, wtype, ...), scope being key or any. Columns of aggs and
    extra must be in signals; extra are more columns of a class."""
    s = signals.withColumn("wtype", F.explode(type_prefixes(F.col("signal_type"))))
    keyed = s.groupBy(*extra, F.col("correlation_key").alias("key"), "wtype").agg(*aggs).withColumn("scope", F.lit("key"))
    loose = s.groupBy(*extra, "wtype").agg(*aggs).withColumns({"scope": F.lit("any"), "key": F.lit("")})
    return keyed.unionByName(loose)


def classed(waits: DataFrame) -> DataFrame:
    """Signal waits with the class (scope, key, wtype) whose signals they take."""
    scope = F.when(F.col("correlation_key") == "", "any").otherwise("key")
    return waits.filter("kind = 'signal'").withColumns({"scope": scope, "key": F.col("correlation_key"), "wtype": F.col("signal_type")})


CLASS = ["scope", "key", "wtype"]


def match_totals(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """JON-1 without pairs: (wait_id, n, first_event, events), the number of a wait's matches, the smallest event_id and their sum. Signals are summed up by class before the join, so a wait of any key costs one row."""
    per = by_class(signals, F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.sum("event_id").alias("events"))
    return classed(waits).select("wait_id", *CLASS).join(per, CLASS).select("wait_id", "n", "first_event", "events")


def payload_ok(required: Column, payload: Column) -> Column:
    """JON-2: '' or the first required key that is missing or blank."""
    return F.coalesce(F.try_element_at(F.filter(required, lambda k: F.trim(F.coalesce(F.try_element_at(payload, k), F.lit(""))) == ""), F.lit(1)), F.lit(""))


def candidates(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """Matches whose payload has what the wait needs, with the columns of both."""
    m = match_signals(waits, signals).join(waits, "wait_id").join(signals.select("event_id", "idempotency_key", "observed_unix", "payload_outcome", "payload_reason"), "event_id")
    return m.filter(~F.col("needs_outcome") | (F.col("payload_outcome") != ""))


def first_match(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """JON-3: for each wait the valid match with the smallest (idempotency_key, event_id). Waits do not use signals up for each other.

    Only the smallest signal of each class counts, with and without an outcome: those are summed up before the
    join, so that a hot key is one row and no pairs are made.
    """
    m, full = F.struct("idempotency_key", "event_id"), F.col("payload_outcome") != ""
    per = by_class(signals, F.min(m).alias("any_m"), F.min(F.when(full, m)).alias("full_m"))
    j = classed(waits).select("wait_id", "needs_outcome", *CLASS).join(per, CLASS)
    j = j.withColumn("m", F.when(F.col("needs_outcome"), F.col("full_m")).otherwise(F.col("any_m")))
    return j.filter("m IS NOT NULL").select("wait_id", "m.idempotency_key", "m.event_id")


def answered_in_time(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """(wait_id, first_unix): waits with a valid match that was observed by their deadline, or at any time if they have none."""
    full = F.col("payload_outcome") != ""
    per = by_class(signals, F.min("observed_unix").alias("any_t"), F.min(F.when(full, F.col("observed_unix"))).alias("full_t"))
    j = classed(waits).select("wait_id", "needs_outcome", "resume_unix", *CLASS).join(per, CLASS)
    j = j.withColumn("first_unix", F.when(F.col("needs_outcome"), F.col("full_t")).otherwise(F.col("any_t")))
    return j.filter((F.col("resume_unix") <= 0) & F.col("first_unix").isNotNull() | (F.col("first_unix") <= F.col("resume_unix"))).select("wait_id", "first_unix")


def assign(waits: DataFrame, signals: DataFrame, lanes: int, block: int) -> DataFrame:
    """JON-3 with one-use signals: (wait_id, idempotency_key, event_id).

    All waits want signals in one order, and all signals serve waits in one order (parking). So it comes to the same
    whether each wait in turn takes the smallest signal that is left, or each signal in turn goes to the first
    wait that still waits for it. Signals are taken, as waits of one class (key, type, needs) are a queue: what has
    been served of it is its head, and a signal looks at the heads of the few classes that it fits.

    Keys are dealt to lanes, which do not compete; where a wait has any key there is one lane. A lane's signals go in blocks of
    their order, the blocks of all lanes side by side. Of each class a task gets as many waits as its block has signals for
    it, so that what it holds does not grow with the input. There are as many rounds as the fullest lane has blocks, fewer if all waits are
    served before.
    """
    cls, spark = [*CLASS, "needs"], waits.sparkSession
    lane = F.pmod(F.xxhash64("lane_key"), F.lit(lanes)).cast("int")
    w = classed(waits).select("wait_id", "parked_unix", *CLASS, F.col("needs_outcome").alias("needs"))
    w = written(placed(w.withColumn("lane_key", F.col("key")).withColumn("lane", lane).drop("lane_key"), ["lane", "parked_unix", "wait_id"], "pos"), "waits")
    w = placed(w, [*cls, "pos"], "at")
    w = written(w, "waits-in-order")
    # A class goes by the place of its first wait, from where its queue goes on.
    queues = written(w.groupBy(*cls).agg(F.min("at").alias("queue"), F.count("*").alias("n")), "queues")
    n_waits = w.count()
    needs = F.explode(F.when(F.col("full"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    kinds = signals.select("correlation_key", "signal_type", (F.col("payload_outcome") != "").alias("full"))
    fits = looked_up(kinds.distinct().withColumns({"k": F.col("correlation_key"), "t": F.col("signal_type")})).withColumn("needs", needs)
    fits = fits.join(queues, cls).groupBy("k", "t", "full").agg(F.array_join(F.sort_array(F.collect_list("queue")), ",").alias("queues"))
    s = signals.select("event_id", "idempotency_key", F.col("correlation_key").alias("k"), F.col("signal_type").alias("t"), (F.col("payload_outcome") != "").alias("full"))
    s = s.join(fits, ["k", "t", "full"]).withColumn("lane_key", F.col("k")).withColumn("lane", lane)
    s = written(placed(s.select("lane", "idempotency_key", "event_id", "queues"), ["lane", "idempotency_key", "event_id"], "turn"), "signals-in-order")
    starts = s.groupBy("lane").agg(F.min("turn").alias("start"), F.count("*").alias("n"))
    n_rounds = -(-(starts.agg(F.max("n")).first()[0] or 0) // block)
    # As many rows as there are lanes.
    s = s.join(F.broadcast(starts.select("lane", "start")), "lane").withColumn("block", F.floor((F.col("turn") - F.col("start")) / block).cast("int"))
    path = folder(waits, "blocks")
    s.select("lane", "turn", "queues", "block").write.partitionBy("block").parquet(path)
    blocks = spark.read.schema("lane int, turn long, queues string, block int").parquet(path)

    def serve(fitting, queued):
        """Pairs (turn, at) of a lane's block."""
        queued = queued.sort_values("at")
        ats, poses = queued["at"].tolist(), queued["pos"].tolist()
        heads, ends, last = {}, {}, None
        for i, q in enumerate(queued["queue"].tolist()):
            if q != last:
                heads[q], last = i, q
            ends[q] = i + 1
        known, out = {}, []
        fitting = fitting.sort_values("turn")
        for turn, text in zip(fitting["turn"].tolist(), fitting["queues"].tolist(), strict=True):
            if (open_ := known.get(text)) is None:
                open_ = known[text] = [q for q in map(int, text.split(",")) if q in heads]
            first, of = None, None
            for q in open_:
                pos = poses[heads[q]]
                if first is None or pos < first:
                    first, of = pos, q
            if of is not None:
                out.append((turn, of, ats[heads[of]]))
                heads[of] += 1
                if heads[of] == ends[of]:
                    # Either the class is served, or the block has no more signals for it.
                    del heads[of]
                    known.clear()
        return type(fitting)(out, columns=["turn", "queue", "at"])

    served, done, total = written(queues.select("queue", F.lit(0).cast("long").alias("head")), "heads"), None, 0
    for k in range(n_rounds):
        now = blocks.filter(F.col("block") == k).drop("block")
        wanted = now.groupBy("queues").agg(F.count("*").alias("n")).select(F.explode(F.split("queues", ",").cast("array<bigint>")).alias("queue"), "n").groupBy("queue").agg(F.sum("n").alias("most"))
        front = w.join(queues.select(*cls, "queue"), cls).join(wanted.join(served, "queue"), "queue")
        front = front.filter((F.col("at") >= F.col("queue") + F.col("head")) & (F.col("at") < F.col("queue") + F.col("head") + F.col("most"))).select("lane", "queue", "at", "pos")
        got = written(now.groupBy("lane").cogroup(front.groupBy("lane")).applyInPandas(serve, "turn long, queue long, at long"), "rounds")
        done = got if done is None else done.union(got)
        total += got.count()
        if total == n_waits:
            break
        if k + 1 < n_rounds:
            more = got.groupBy("queue").agg(F.count("*").alias("more"))
            served = written(served.join(more, "queue", "left").select("queue", (F.col("head") + F.coalesce("more", F.lit(0))).alias("head")), "heads")
    if done is None:
        return spark.createDataFrame([], "wait_id long, idempotency_key string, event_id long")
    return done.join(w.select("at", "wait_id"), "at").join(s.select("turn", "idempotency_key", "event_id"), "turn").select("wait_id", "idempotency_key", "event_id")


def assign_in_blocks(waits: DataFrame, signals: DataFrame, block: int = BLOCK) -> DataFrame:
    """assign for waits of any key: all compete, so that there is one lane, and its blocks follow one another."""
    return assign(waits, signals, 1, block)


def assign_in_rounds(waits: DataFrame, signals: DataFrame, block: int = BLOCK) -> DataFrame:
    """assign for waits that have a key each: a round takes a block of every lane. With keys at random that is one round or two for any
    number of waits that LANES blocks hold; a key that has nearly all is a lane of its own."""
    loose = waits.filter("kind = 'signal' AND correlation_key = ''").isEmpty()
    return assign(waits, signals, LANES if loose else 1, block)


def assign_once(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """JON-3 with one-use signals: all signal waits, of one key and of any, take in parking order the smallest signal that is left."""
    return assign_in_rounds(waits, signals)


def deliver(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """JON-4: per signal (with run_id, the run that it goes to) the waits parked in that run that it matches, and whether all accept its
    payload; one that does not rejects the delivery.

    Waits are counted by run, key and type first; a signal looks up its type's prefixes under its key and under any key.
    """
    w = classed(waits).groupBy("run_id", *CLASS).agg(F.count("*").alias("n"), F.bool_or("needs_outcome").alias("needs"))
    s = looked_up(signals.select("event_id", "run_id", (F.col("payload_outcome") != "").alias("full"), "correlation_key", "signal_type"))
    return s.join(w, ["run_id", *CLASS]).groupBy("event_id").agg(F.sum("n").alias("n_waits"), F.bool_and(F.col("full") | ~F.col("needs")).alias("accepted"))


def looked_up(signals: DataFrame) -> DataFrame:
    """Signals once for every class of waits that takes them."""
    s = signals.withColumn("wtype", F.explode(type_prefixes(F.col("signal_type"))))
    at = F.array(F.struct(F.lit("key").alias("scope"), F.col("correlation_key").alias("key")), F.struct(F.lit("any").alias("scope"), F.lit("").alias("key")))
    return s.withColumn("at", F.explode(at)).select(*s.columns, "at.scope", "at.key").drop("correlation_key", "signal_type")


def overlaid(defaults: Column, payload: Column) -> Column:
    """JON-5: defaults overlaid by the payload, status success by default."""
    base = F.map_zip_with(F.create_map(F.lit("status"), F.lit("success")), defaults, lambda _, a, b: F.coalesce(b, a))
    return F.map_zip_with(base, payload, lambda _, a, b: F.coalesce(b, a))


def resume_outputs(matched: DataFrame, defaults: str, payload: str) -> DataFrame:
    """JON-5: matches of waits and signals with outputs, the payload over the wait's defaults, and the usage of both: input_tokens and
    output_tokens are the sums of wait_* and signal_*."""
    no = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    usage = {f"{k}_tokens": no(f"wait_{k}_tokens") + no(f"signal_{k}_tokens") for k in ("input", "output")}
    return matched.withColumns({"outputs": overlaid(F.col(defaults), F.col(payload)), **usage})


def timeouts(waits: DataFrame, matched: DataFrame, now: int) -> DataFrame:
    """JON-6: (wait_id, kind, result) of unmatched waits whose deadline has come. Signal waits give their timeout_outputs if there are any,
    else their outputs, timer waits their outputs; a wait that has neither stays parked."""
    due = waits.join(matched.select("wait_id"), "wait_id", "left_anti").filter((F.col("resume_unix") > 0) & (F.col("resume_unix") <= now))
    timed = (F.col("kind") == "signal") & (F.coalesce(F.size("timeout_outputs"), F.lit(0)) > 0)
    out = due.select("wait_id", "kind", F.when(timed, F.col("timeout_outputs")).otherwise(F.col("outputs")).alias("result"))
    return out.filter("result IS NOT NULL")


def signal_target(signals: DataFrame, cases: DataFrame, waits: DataFrame) -> DataFrame:
    """JON-7: (event_id, target) of signals (event_id, run_id, app_id, correlation_key, signal_type): the run that a signal names, if there
    is one; else of its app's active runs, or of all active ones where app_id is 0 or less, the smallest that holds a matching wait; else -1.

    The smallest runs are found by app and class of wait before the join: no pairs of signals and waits.
    """
    active = cases.filter(~F.col("status").isin("completed", "failed", "cancelled")).select("run_id", "app_id")
    w = classed(waits).select("run_id", *CLASS).join(active, "run_id")
    per_app = w.groupBy("app_id", *CLASS).agg(F.min("run_id").alias("held"))
    everywhere = w.groupBy(*CLASS).agg(F.min("run_id").alias("held")).withColumn("app_id", F.lit(0).cast("long"))
    open_ = signals.filter("run_id IS NULL").select("event_id", F.greatest("app_id", F.lit(0)).cast("long").alias("app_id"), "correlation_key", "signal_type")
    found = looked_up(open_).join(per_app.filter("app_id > 0").unionByName(everywhere), ["app_id", *CLASS])
    found = found.groupBy("event_id").agg(F.min("held").alias("target"))
    named = signals.filter("run_id IS NOT NULL").select("event_id", "run_id").join(cases.select("run_id"), "run_id").select("event_id", F.col("run_id").alias("target"))
    out = signals.select("event_id").join(found.unionByName(named), "event_id", "left")
    return out.select("event_id", F.coalesce("target", F.lit(-1)).cast("long").alias("target"))


def reject_duplicates(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    """JON-8: submissions with why they are rejected ('' if accepted) and the active run that stands against them."""
    active = cases.filter(~F.col("status").isin("completed", "failed", "cancelled")).groupBy("app_id").agg(F.min("run_id").alias("active_run"))
    j = submissions.join(active, "app_id", "left")
    why = F.when(F.col("app_id") <= 0, "invalid app_id").when(F.col("active_run").isNotNull(), "active run").otherwise("")
    return j.select(*submissions.columns, why.alias("rejected"), F.coalesce("active_run", F.lit(-1)).cast("long").alias("active_run"))


def snapshot_asof(attempts: DataFrame, value: str) -> DataFrame:
    """JON-9: the state that each attempt saw: (run_id, node_id, iteration, seen_node, seen) with the latest value of every other step of
    its run that was completed when it started; a row per step that it saw.

    Attempts are asked once for each step of their run, completions are added, and the last value is carried on
    by time within a run and step: rows grow with attempts times steps of a run, not with pairs of attempts.
    """
    done = attempts.filter("status = 'completed'")
    steps = done.select("run_id", F.col("node_id").alias("seen_node")).distinct()
    ask = attempts.select("run_id", "node_id", "iteration", F.col("started_at").alias("at")).join(steps, "run_id").filter("node_id <> seen_node")
    tell = done.select("run_id", F.col("node_id").alias("seen_node"), F.col("completed_at").alias("at"), F.struct(F.col("iteration").alias("i"), F.col(value).alias("v")).alias("told"))
    both = tell.unionByName(ask, allowMissingColumns=True)
    # Of completions at one time the last iteration counts; all of them come before attempts that start then.
    w = Window.partitionBy("run_id", "seen_node").orderBy("at", F.col("told").isNull(), F.col("told.i")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("told", ignorenulls=True).over(w)["v"]).filter("node_id IS NOT NULL AND seen IS NOT NULL")
    return seen.select("run_id", "node_id", "iteration", "seen_node", "seen")


def unknown_output_refs(edges: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """JON-10: references of conditions to outputs that a node's type does not declare, with the nearest declared key within three edits (first declared at ties)."""
    refs = edges.select("flow_id", "pos", F.explode(referenced_fields(F.col("condition"))).alias("ref")).filter(F.col("ref").startswith("results."))
    parts = F.split("ref", r"\.", 3)
    refs = refs.select("flow_id", "pos", F.get(parts, F.lit(1)).alias("node_id"), F.get(parts, F.lit(2)).alias("key")).filter("key IS NOT NULL")
    keys = catalog.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("declared"))
    r = refs.join(nodes.select("flow_id", "node_id", "type"), ["flow_id", "node_id"]).join(keys, "type")
    known = F.exists("declared", lambda d: (F.col("key") == d["key"]) | F.col("key").startswith(F.concat(d["key"], F.lit("."))))
    near = F.array_min(F.filter(F.transform("declared", lambda d: F.struct(F.levenshtein(F.col("key"), d["key"], 3).alias("d"), d["rank"].alias("r"), d["key"].alias("k"))), lambda x: x["d"] >= 0))
    bad = r.filter(~F.col("key").isin("status", "history") & ~F.col("key").startswith("history.") & ~known)
    return bad.select("flow_id", "pos", "node_id", "key", F.coalesce(near["k"], F.lit("")).alias("suggestion"))
