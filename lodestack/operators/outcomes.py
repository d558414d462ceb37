"""Run bookkeeping over attempts, hops, cases, waits and revisions: windows, rollups, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import placed

ORDER = ("started_at", "part_id", "source_id")
TERMINAL = ("completed", "failed", "cancelled")


def earlier(*keys: str, order=ORDER) -> Window:
    """All rows of the keys before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


# Windows


def iteration(attempts: DataFrame) -> DataFrame:
    """WIN-1: n-th execution of a node in its run."""
    return attempts.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "node_id").orderBy(*ORDER)).cast("long"))


def history(attempts: DataFrame, output: str = "output_tokens") -> DataFrame:
    """WIN-2: a node's earlier outputs, its own excluded; empty ones are not recorded."""
    w = earlier("run_id", "node_id", order=("iteration",))
    return attempts.withColumn("history", F.collect_list(F.col(output)).over(w))


def traversal_limit(hops: DataFrame) -> DataFrame:
    """WIN-3: whether a hop's edge is used up. No limit means unlimited forward, and never for a back edge."""
    past = F.count_if("satisfied").over(earlier("run_id", "src", "dst", "loop_edge"))
    done = F.when(F.col("max_traversals") <= 0, F.col("loop_edge") == 1).otherwise(F.coalesce(past, F.lit(0)) >= F.col("max_traversals"))
    return hops.withColumn("exhausted", done)


def loop_first(hops: DataFrame) -> DataFrame:
    """WIN-4: if a satisfied back edge is not used up only such edges fire, else the forward ones."""
    h = traversal_limit(hops)
    back = F.col("satisfied") & ~F.col("exhausted") & (F.col("loop_edge") == 1)
    any_back = F.max(back).over(Window.partitionBy("run_id", "src", "iteration"))
    return h.withColumn("fires", F.when(any_back, back).otherwise(F.col("satisfied") & ~F.col("exhausted") & (F.col("loop_edge") == 0)))


def token_budget(attempts: DataFrame, most: int) -> DataFrame:
    """WIN-5: running tokens of a run; the first attempt above the budget fails, later ones do not run."""
    w = Window.partitionBy("run_id").orderBy(*ORDER, "node_id").rowsBetween(Window.unboundedPreceding, 0)
    a = attempts.withColumn("running", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w))
    own = F.col("input_tokens") + F.col("output_tokens")
    return a.withColumn("budget", F.when(F.col("running") <= most, "ok").when(F.col("running") - own <= most, "exceeded").otherwise("not_run"))


def first_return(attempts: DataFrame) -> DataFrame:
    """WIN-6: the first completed return of a run wins; what comes after it is skipped, and so is what was pending or waiting by then."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORDER, "node_id"))
    a = attempts.withColumn("nth", rank)
    won = F.min(F.when((F.col("node_type") == "return") & (F.col("status") == "completed"), F.col("nth"))).over(Window.partitionBy("run_id"))
    over = (F.col("nth") > won) | (won.isNotNull() & F.col("status").isin("pending", "waiting"))
    return a.withColumn("final_status", F.when(over, "skipped").otherwise(F.col("status")))


def retry_schedule(callbacks: DataFrame, cap: int = 60) -> DataFrame:
    """WIN-7: the n-th failure delays by n seconds, at most cap; a delivery resets."""
    delay = F.when(F.col("delivered"), 0).otherwise(F.least("attempts", F.lit(cap))).cast("long")
    return callbacks.withColumn("delay_seconds", delay).withColumn("next_unix", F.col("last_attempt_unix") + F.col("delay_seconds"))


def time_budget(attempts: DataFrame, seconds: int) -> DataFrame:
    """WIN-8: attempts that start later than the budget after their run's start are cut."""
    start = F.min("started_at").over(Window.partitionBy("run_id"))
    return attempts.withColumn("cut", F.col("started_at") > start + F.expr(f"INTERVAL {int(seconds)} SECONDS"))


# Rollups


def usage_totals(attempts: DataFrame, over_budget: Column | None = None) -> DataFrame:
    """AGG-1: tokens per run; steps that failed by themselves count nothing, those that went over the budget (over_budget) count."""
    counts = F.col("status") != "failed"
    if over_budget is not None:
        counts = counts | F.coalesce(over_budget, F.lit(False))
    total = lambda c: F.sum(F.when(counts, F.col(c)).otherwise(0)).alias(c)
    return attempts.groupBy("run_id").agg(total("input_tokens"), total("output_tokens"))


def case_outcome(cases: DataFrame, attempts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """AGG-2, the first that holds: cancelled; a return fired; a failed step that is not to continue (first in node order); activated
    steps left pending; a return step of the flow (of nodes, or else of the attempts) that never fired; completed."""
    failed = (F.col("status") == "failed") & (F.col("on_error") != "continue")
    returned = (F.col("node_type") == "return") & (F.col("status") == "completed")
    a = attempts.groupBy("run_id").agg(
        F.bool_or(returned).alias("returned"),
        F.min(F.when(failed, F.col("node_id"))).alias("first_failed"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "pending", F.col("node_id")))).alias("pending"),
        F.bool_or(F.col("node_type") == "return").alias("has_return"),
    )
    c = cases.select("run_id", F.col("status").alias("case_status")).join(a, "run_id", "left")
    if nodes is not None:
        own = nodes.groupBy(F.col("flow_id").alias("run_id")).agg(F.bool_or(F.col("type") == "return").alias("has_return"))
        c = c.drop("has_return").join(own, "run_id", "left")
    no = lambda x: F.coalesce(F.col(x), F.lit(False))
    left = F.coalesce(F.size("pending"), F.lit(0)) > 0
    error = (
        F.when((F.col("case_status") == "cancelled") | no("returned"), "")
        .when(F.col("first_failed").isNotNull(), F.concat(F.lit("step failed: "), "first_failed"))
        .when(left, F.concat(F.lit("orphaned pending nodes: ["), F.array_join("pending", " "), F.lit("]")))
        .when(no("has_return"), "blueprint completed without firing return")
        .otherwise("")
    )
    outcome = F.when(F.col("case_status") == "cancelled", "cancelled").when(F.col("error") != "", "failed").otherwise("completed")
    return c.withColumn("error", error).select("run_id", outcome.alias("outcome"), "error")


def status_counts(cases: DataFrame) -> DataFrame:
    """AGG-3: cases by status, with how many of them are queued and active."""
    return cases.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(~F.col("status").isin(*TERMINAL)).alias("active"))


def earliest_timer(waits: DataFrame, key: str = "run_id") -> DataFrame:
    """AGG-4: the smallest positive deadline, else 0."""
    return waits.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("resume_unix") > 0, F.col("resume_unix"))), F.lit(0)).cast("long").alias("earliest"))


def latest_revision(revisions: DataFrame, written: str | None = None) -> DataFrame:
    """AGG-5: the newest revision of each run; of equal ones the one with the largest `written` (a column), the later write."""
    by = F.struct("revision", *([written] if written else []))
    return revisions.groupBy("run_id").agg(F.max("revision").alias("revision"), F.max_by("status", by).alias("status"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """AGG-6 and AGG-7: each flow's number of issues, first issue, numbered text, JSON, and whether all are warnings.

    Issues of union_issues are listed in the order of the rules, others by code.
    """
    order = [c for c in ("stage", "place", "rule", "k") if c in issues.columns]
    items = F.array_sort(F.collect_list(F.struct(*order, "code", "target", "message", "severity")))
    one = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["code"], F.lit("] "), x["message"], F.lit(" (target: "), x["target"], F.lit(")"))
    g = issues.groupBy("flow_id").agg(F.count("*").alias("issue_count"), items.alias("i"))
    as_json = F.to_json(F.transform("i", lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"), x["target"].alias("target"), x["severity"].alias("severity"))))
    return g.select(
        "flow_id", "issue_count", F.get("i", F.lit(0))["code"].alias("first_code"), F.get("i", F.lit(0))["target"].alias("first_target"),
        F.array_join(F.transform("i", one), "\n").alias("issues_text"), as_json.alias("issues_json"), F.forall("i", lambda x: x["severity"] == "warning").alias("valid"),
    )


def is_valid(issues: DataFrame) -> DataFrame:
    """AGG-7: valid unless an issue is more than a warning."""
    return issues.groupBy("flow_id").agg(F.bool_and(F.col("severity") == "warning").alias("valid"))


def source_agreement(sources: DataFrame) -> DataFrame:
    """AGG-8: the one outcome that all sources give, if none failed, else inconclusive; with the largest share."""
    per = sources.groupBy("app_id", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("f"))
    g = per.groupBy("app_id").agg(F.sum("n").alias("answers"), F.sum("f").alias("failed"), F.count("*").alias("outcomes"), F.min("outcome").alias("one"), F.max("n").alias("top"))
    return g.select("app_id", F.when((F.col("outcomes") == 1) & (F.col("failed") == 0), F.col("one")).otherwise("inconclusive").alias("consensus"), "answers", (F.col("top") / F.col("answers")).alias("majority_share"))


def node_state(attempts: DataFrame) -> DataFrame:
    """AGG-9: the latest attempt of each node of a run, the one that completed last at equal iterations; a missing status is completed, a missing error ''."""
    state = F.struct("status", "started_at", "completed_at", "error", "input_tokens", "output_tokens")
    last = F.max_by(state, F.struct("iteration", "completed_at", "started_at"))
    g = attempts.groupBy("run_id", "node_id").agg(F.max("iteration").alias("iteration"), last.alias("s"))
    return g.select("run_id", "node_id", "iteration", F.coalesce("s.status", F.lit("completed")).alias("status"), "s.started_at", "s.completed_at", F.coalesce("s.error", F.lit("")).alias("error"), "s.input_tokens", "s.output_tokens")


def merged_outputs(attempts: DataFrame, fields: list[str], activation: str | None = None) -> DataFrame:
    """AGG-10: each field's last non-null value over a node's attempts; of its last activation only, if a column tells them apart, since a loop that enters a node again resets its outputs."""
    keys = ["run_id", "node_id", *([activation] if activation else [])]
    per = attempts.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("iteration"))).alias(c) for c in fields))
    if not activation:
        return per
    last = per.groupBy("run_id", "node_id").agg(F.max_by(F.struct(*fields), activation).alias("o"))
    return last.select("run_id", "node_id", *(F.col(f"o.{c}").alias(c) for c in fields))


# Orders


def stable_order(attempts: DataFrame) -> DataFrame:
    """ORD-1: the place of an attempt in its run: non-returns first, then by node and iteration."""
    w = Window.partitionBy("run_id").orderBy((F.col("node_type") == "return").cast("int"), "node_id", "iteration")
    return attempts.withColumn("place", F.row_number().over(w).cast("long"))


def admit(cases: DataFrame, cap: int, queued: int = 0) -> DataFrame:
    """ORD-2: first come, first served within one queue of cap places, of which queued are taken: cases with admitted and reason ('' or 'queue full').

    Places are counted over range partitions, a count per partition; no task sees the whole table.
    """
    free = max(0, cap - queued)
    out = placed(cases, ["started_at", "run_id"], "place").withColumn("admitted", F.col("place") < free).drop("place")
    return out.withColumn("reason", F.when(F.col("admitted"), "").otherwise("queue full"))


def due_timers(waits: DataFrame, cases: DataFrame, now: int) -> DataFrame:
    """ORD-3: runs that have not ended and whose earliest deadline has come."""
    ended = cases.filter(F.col("status").isin(*TERMINAL)).select("run_id")
    return earliest_timer(waits).filter((F.col("earliest") > 0) & (F.col("earliest") <= now)).join(ended, "run_id", "left_anti")


def pending_callbacks(callbacks: DataFrame, now: int) -> DataFrame:
    """ORD-4: terminal, with a URL, undelivered, past its delay."""
    r = retry_schedule(callbacks)
    return r.filter(F.col("status").isin(*TERMINAL) & (F.col("url") != "") & ~F.col("delivered") & (F.col("next_unix") <= now))


def closest_key(df: DataFrame, word: Column, keys: list[str], within: int = 3) -> DataFrame:
    """ORD-5: the key nearest by edits, first declared at ties; null beyond `within`."""
    near = F.array_compact(F.array(*(F.when(F.levenshtein(word, F.lit(k), within) >= 0, F.struct(F.levenshtein(word, F.lit(k), within).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, k in enumerate(keys))))
    return df.withColumn("closest", F.array_min(near)["k"])


# Sets


def union_issues(*rules: DataFrame) -> DataFrame:
    """SET-1: the issues (flow_id, code, target, severity, message) of all rules, duplicates kept, with rule, the rule's place in the
    call. A rule may give stage, place and k, by which its issues are listed; without a stage a rule is a stage of its own."""
    out = None
    for n, r in enumerate(rules):
        given = {"stage": F.lit(n), "place": F.lit(0), "k": F.lit(0)} | {c: F.col(c) for c in ("stage", "place", "k") if c in r.columns}
        r = r.select("flow_id", "code", "target", "severity", "message", given["stage"].cast("int").alias("stage"), given["place"].cast("long").alias("place"), F.lit(n).alias("rule"), given["k"].cast("int").alias("k"))
        out = r if out is None else out.unionByName(r)
    return out


def normalize_keys(keys: Column) -> Column:
    """SET-2: trimmed, without blanks, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: k != "")))


def except_allowed(nodes: DataFrame, allowed: list[str], allow_agent_loop: bool = True) -> DataFrame:
    """SET-3: nodes of a type that is not allowed; an empty list allows all. agent_loop has a switch of its own besides."""
    off = ~F.col("type").isin(*allowed) if allowed else F.lit(False)
    return nodes.filter(off | (F.col("type") == "agent_loop") & F.lit(not allow_agent_loop))


# Names that are never fetched.
NAMES = ["localhost", "metadata.google.internal"]


def private_ipv4(a: Column, b: Column) -> Column:
    """Loopback, private and link-local addresses, by their first two numbers; 0.0.0.0/8 is loopback to most systems."""
    return (a.isin(0, 10, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 224) & (b == 0))


def blocked_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """SET-4: the host, and whether it is to be screened out: none, localhost, metadata hosts, and literals of loopback, private and
    link-local addresses, IPv6 and IPv4 within IPv6 too. Names are not looked up."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))
    d = df.withColumn("host", host)
    number = lambda c, i: F.regexp_extract(c, r"(?:^|:)(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", i).try_cast("int")
    v6 = F.when(F.col("host").startswith("["), F.regexp_replace("host", r"^\[|\]$|%.*", ""))
    first = F.conv(F.when(v6.startswith(":"), "0").otherwise(F.regexp_extract(v6, "^([0-9a-f]{1,4}):", 1)), 16, 10).try_cast("int")
    loop6 = v6.rlike(r"^(?:0{0,4}:){1,7}0{0,3}1$") & ~v6.rlike("[2-9a-f]") | (v6 == "::") | v6.rlike(r"^(?:0{1,4}:){7}0{1,4}$")
    # fc00::/7, fe80::/10, ff02::/16
    private6 = first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF) | (first == 0xFF02)
    # ::ffff:127.0.0.1, also as ::ffff:7f00:1
    mapped = F.conv(F.regexp_extract(v6, r"^(?:0{1,4}:){0,5}:{0,2}ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$", 1), 16, 10).try_cast("int")
    v4 = F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & private_ipv4(number(F.col("host"), 1), number(F.col("host"), 2))
    in6 = private_ipv4(number(v6, 1), number(v6, 2)) & v6.rlike(r"^[0:]*(?:ffff:)?\d") | private_ipv4(F.shiftright(mapped, 8), mapped.bitwiseAND(255))
    no = lambda x: F.coalesce(x, F.lit(False))
    return d.withColumn("blocked", (F.col("host") == "") | F.col("host").isin(*NAMES) | no(v4) | no(loop6) | no(private6) | no(in6))
