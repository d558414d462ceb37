"""Queries of the bookkeeping operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extension
from ..operators import matching as m
from ..operators import outcomes as o
from .views import query, view, with_views

NOW = 1704067200 + 30 * 86400
Q, SQL = {}, {}


def add(name: str, build, sql: str) -> None:
    Q[name], SQL[name] = build, with_views(sql)


def over(view_name: str, f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, view_name))


add("win_1_iteration", over("v_attempts", lambda a: o.iteration(a).select("run_id", "node_id", "part_id", "source_id", "nth")),
    "SELECT run_id, node_id, part_id, source_id, iteration AS nth FROM v_attempts")
add("win_2_history", over("v_attempts", lambda a: o.history(a).select("run_id", "node_id", "iteration", F.size("history").cast("long").alias("n_prior"), F.try_element_at("history", F.lit(-1)).alias("last_prior"))),
    "SELECT run_id, node_id, iteration, iteration - 1 AS n_prior, lag(output_tokens) OVER (PARTITION BY run_id, node_id ORDER BY iteration) AS last_prior FROM v_attempts")
LIMIT = """SELECT *, CASE WHEN max_traversals <= 0 THEN loop_edge = 1 ELSE coalesce(sum(CASE WHEN satisfied THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, src, dst, loop_edge ORDER BY started_at, part_id, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= max_traversals END AS exhausted FROM v_hops"""
add("win_3_traversal_limit", over("v_hops", lambda h: o.traversal_limit(h).select("run_id", "src", "dst", "iteration", "loop_edge", "exhausted")),
    f"SELECT run_id, src, dst, iteration, loop_edge, exhausted FROM ({LIMIT}) AS x")
add("win_4_loop_first", over("v_hops", lambda h: o.loop_first(h).select("run_id", "src", "dst", "iteration", "loop_edge", "fires")),
    f"""SELECT run_id, src, dst, iteration, loop_edge, CASE WHEN max(CASE WHEN satisfied AND NOT exhausted AND loop_edge = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, src, iteration) = 1
        THEN satisfied AND NOT exhausted AND loop_edge = 1 ELSE satisfied AND NOT exhausted AND loop_edge = 0 END AS fires FROM ({LIMIT}) AS x""")
add("win_5_token_budget", over("v_attempts", lambda a: o.token_budget(a, 1000).select("run_id", "node_id", "iteration", "running", "budget")),
    """SELECT run_id, node_id, iteration, CAST(running AS BIGINT) AS running, CASE WHEN running <= 1000 THEN 'ok' WHEN running - own <= 1000 THEN 'exceeded' ELSE 'not_run' END AS budget
       FROM (SELECT *, input_tokens + output_tokens AS own, sum(input_tokens + output_tokens) OVER (PARTITION BY run_id ORDER BY started_at, part_id, source_id, node_id ROWS UNBOUNDED PRECEDING) AS running FROM v_attempts) AS x""")
# Attempts of which some have not begun or wait for something.
PARKED = "SELECT run_id, node_id, iteration, node_type, started_at, part_id, source_id, CASE WHEN node_type = 'step' AND part_id % 5 = 0 THEN 'pending' WHEN node_type = 'step' AND part_id % 7 = 0 THEN 'waiting' ELSE status END AS status FROM v_attempts"
add("win_6_first_return", lambda s, d: o.first_return(query(s, d, PARKED)).select("run_id", "node_id", "iteration", "final_status"),
    f"""SELECT run_id, node_id, iteration, CASE WHEN nth > won OR won IS NOT NULL AND status IN ('pending', 'waiting') THEN 'skipped' ELSE status END AS final_status
       FROM (SELECT *, min(CASE WHEN node_type = 'return' AND status = 'completed' THEN nth END) OVER (PARTITION BY run_id) AS won FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at, part_id, source_id, node_id) AS nth FROM ({PARKED}) AS p) AS x) AS y""")
add("win_7_retry_schedule", over("v_callbacks", lambda c: o.retry_schedule(c).select("run_id", "delay_seconds", "next_unix")),
    "SELECT run_id, d AS delay_seconds, last_attempt_unix + d AS next_unix FROM (SELECT *, CAST(CASE WHEN delivered THEN 0 ELSE least(attempts, 60) END AS BIGINT) AS d FROM v_callbacks) AS x")
add("win_8_time_budget", over("v_attempts", lambda a: o.time_budget(a, 30 * 86400).select("run_id", "node_id", "iteration", "cut")),
    "SELECT run_id, node_id, iteration, started_at > min(started_at) OVER (PARTITION BY run_id) + INTERVAL 30 DAY AS cut FROM v_attempts")
add("agg_1_usage_totals", over("v_attempts", lambda a: o.usage_totals(o.token_budget(a, 1000).withColumn("status", F.when(F.col("budget") == "ok", F.col("status")).otherwise("failed")), F.col("budget") == "exceeded")),
    """SELECT run_id, CAST(sum(CASE WHEN counts THEN input_tokens ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN counts THEN output_tokens ELSE 0 END) AS BIGINT) AS output_tokens FROM (
         SELECT *, CASE WHEN running <= 1000 THEN status <> 'failed' ELSE running - input_tokens - output_tokens <= 1000 END AS counts
         FROM (SELECT *, sum(input_tokens + output_tokens) OVER (PARTITION BY run_id ORDER BY started_at, part_id, source_id, node_id ROWS UNBOUNDED PRECEDING) AS running FROM v_attempts) AS x) AS y GROUP BY run_id""")
STALLED = "SELECT run_id, node_id, node_type, on_error, CASE WHEN status = 'completed' AND part_id % 4 = 0 THEN 'pending' ELSE status END AS status FROM v_attempts"
OUTCOME = f"""SELECT run_id, CASE WHEN case_status = 'cancelled' THEN 'cancelled' WHEN error <> '' THEN 'failed' ELSE 'completed' END AS outcome, error FROM (
    SELECT c.run_id, c.status AS case_status, CASE WHEN c.status = 'cancelled' OR coalesce(returned, false) THEN '' WHEN first_failed IS NOT NULL THEN concat('step failed: ', first_failed)
      WHEN pending IS NOT NULL THEN concat('orphaned pending nodes: [', pending, ']') WHEN coalesce(has_return, false) THEN 'blueprint completed without firing return' ELSE '' END AS error
    FROM v_cases c LEFT JOIN (SELECT run_id, bool_or(node_type = 'return' AND status = 'completed') AS returned, min(CASE WHEN status = 'failed' AND on_error <> 'continue' THEN node_id END) AS first_failed,
      string_agg(DISTINCT CASE WHEN status = 'pending' THEN node_id END, ' ' ORDER BY CASE WHEN status = 'pending' THEN node_id END) AS pending FROM ({STALLED}) AS st GROUP BY run_id) a ON c.run_id = a.run_id
    LEFT JOIN (SELECT flow_id, bool_or(type = 'return') AS has_return FROM v_flow_nodes GROUP BY flow_id) f ON f.flow_id = c.run_id) AS x"""
add("agg_2_case_outcome", lambda s, d: o.case_outcome(view(s, d, "v_cases"), query(s, d, STALLED), view(s, d, "v_flow_nodes")), OUTCOME)
add("agg_3_status_counts", over("v_cases", o.status_counts),
    "SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) AS BIGINT) AS queued, CAST(sum(CASE WHEN status NOT IN ('completed', 'failed', 'cancelled') THEN 1 ELSE 0 END) AS BIGINT) AS active FROM v_cases GROUP BY status")
add("agg_4_earliest_timer", over("v_waits", lambda w: o.earliest_timer(w, "node_id")),
    "SELECT node_id, coalesce(min(CASE WHEN resume_unix > 0 THEN resume_unix END), 0) AS earliest FROM v_waits GROUP BY node_id")
add("agg_5_latest_revision", over("v_revisions", lambda r: o.latest_revision(r.withColumns({"written": F.col("revision"), "revision": F.floor((F.col("revision") + 1) / 2).cast("long")}), "written")),
    "SELECT run_id, (revision + 1) // 2 AS revision, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY revision DESC) AS k FROM v_revisions) AS x WHERE k = 1")
add("agg_6_issue_summary", over("v_issues", o.issue_summary),
    """SELECT flow_id, count(*) AS issue_count, min_by(code, k) AS first_code, min_by(target, k) AS first_target, string_agg(concat(k, '. [', code, '] ', message, ' (target: ', target, ')'), chr(10) ORDER BY k) AS issues_text,
         concat('[', string_agg(concat('{"code":"', code, '","message":"', replace(message, '"', '\\"'), '","target":"', target, '","severity":"', severity, '"}'), ',' ORDER BY k), ']') AS issues_json, bool_and(severity = 'warning') AS valid
       FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY code, target, message) AS k FROM v_issues) AS x GROUP BY flow_id""")
add("agg_7_is_valid", over("v_issues", o.is_valid), "SELECT flow_id, bool_and(severity = 'warning') AS valid FROM v_issues GROUP BY flow_id")
add("agg_8_source_agreement", over("v_sources", o.source_agreement),
    """SELECT app_id, CASE WHEN count(*) = 1 AND sum(f) = 0 THEN min(outcome) ELSE 'inconclusive' END AS consensus, CAST(sum(n) AS BIGINT) AS answers, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS majority_share
       FROM (SELECT app_id, outcome, count(*) AS n, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS f FROM v_sources GROUP BY app_id, outcome) AS x GROUP BY app_id""")
# Pairs of attempts share an iteration and are told apart by when they completed.
ENDED = "SELECT run_id, node_id, (iteration + 1) DIV 2 AS iteration, CASE WHEN part_id % 4 > 0 THEN status END AS status, started_at, concat(CAST(started_at AS STRING), '+', lpad(CAST(part_id % 7 AS STRING), 2, '0'), '-', lpad(CAST(part_id AS STRING), 9, '0'), lpad(CAST(source_id AS STRING), 9, '0'), lpad(CAST(iteration AS STRING), 4, '0')) AS completed_at, CASE WHEN status = 'failed' THEN concat('failed at ', node_id) END AS error, input_tokens, output_tokens FROM v_attempts"
add("agg_9_node_state", lambda s, d: o.node_state(query(s, d, ENDED)),
    f"SELECT run_id, node_id, iteration, coalesce(status, 'completed') AS status, started_at, completed_at, coalesce(error, '') AS error, input_tokens, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY iteration DESC, completed_at DESC) AS k FROM ({ENDED.replace(' DIV ', ' // ').replace('STRING', 'VARCHAR')}) AS e) AS x WHERE k = 1")
ODD = "SELECT *, CASE WHEN input_tokens % 2 = 0 THEN input_tokens END AS even_tokens FROM v_attempts"
add("agg_10_merged_outputs", over("v_attempts", lambda a: o.merged_outputs(a.withColumns({"even_tokens": F.when(F.col("input_tokens") % 2 == 0, F.col("input_tokens")), "activation": F.floor((F.col("iteration") + 1) / 2)}), ["output_tokens", "even_tokens"], "activation")),
    f"""SELECT run_id, node_id, max_by(output_tokens, iteration) AS output_tokens, max_by(even_tokens, CASE WHEN even_tokens IS NOT NULL THEN iteration END) AS even_tokens
        FROM (SELECT *, max((iteration + 1) // 2) OVER (PARTITION BY run_id, node_id) AS last FROM ({ODD}) AS x) AS y WHERE (iteration + 1) // 2 = last GROUP BY run_id, node_id""")
add("ord_1_stable_order", over("v_attempts", lambda a: o.stable_order(a).select("run_id", "node_id", "iteration", "place")),
    "SELECT run_id, node_id, iteration, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN node_type = 'return' THEN 1 ELSE 0 END, node_id, iteration) AS place FROM v_attempts")
add("ord_2_admit", lambda s, d: o.admit(query(s, d, "SELECT run_id, started_at FROM v_cases WHERE status <> 'waiting'"), 1000, query(s, d, "SELECT run_id FROM v_cases WHERE status = 'waiting'").count()).select("run_id", "admitted", "reason"),
    "SELECT run_id, ok AS admitted, CASE WHEN ok THEN '' ELSE 'queue full' END AS reason FROM (SELECT run_id, row_number() OVER (ORDER BY started_at, run_id) <= 1000 - (SELECT count(*) FROM v_cases WHERE status = 'waiting') AS ok FROM v_cases WHERE status <> 'waiting') AS x")
add("ord_3_due_timers", lambda s, d: o.due_timers(view(s, d, "v_waits"), view(s, d, "v_cases"), NOW),
    f"SELECT run_id, earliest FROM (SELECT run_id, coalesce(min(CASE WHEN resume_unix > 0 THEN resume_unix END), 0) AS earliest FROM v_waits GROUP BY run_id) AS x WHERE earliest > 0 AND earliest <= {NOW} AND run_id NOT IN (SELECT run_id FROM v_cases WHERE status IN ('completed', 'failed', 'cancelled'))")
add("ord_4_pending_callbacks", over("v_callbacks", lambda c: o.pending_callbacks(c, NOW).select("run_id", "attempts", "next_unix")),
    f"SELECT run_id, attempts, last_attempt_unix + least(attempts, 60) AS next_unix FROM v_callbacks WHERE status IN ('completed', 'failed', 'cancelled') AND url <> '' AND NOT delivered AND last_attempt_unix + least(attempts, 60) <= {NOW}")
KEYS = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
add("ord_5_closest_key", lambda s, d: o.closest_key(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_type"), F.substring("p_type", 2, 6), KEYS).select("p_partkey", F.coalesce("closest", F.lit("")).alias("closest")),
    "SELECT p_partkey, coalesce((SELECT min_by(k, dist * 10 + i) FROM (SELECT k, i, levenshtein(substr(p_type, 2, 6), k) AS dist FROM (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(KEYS)) + ") AS t(k, i)) AS u WHERE dist <= 3), '') AS closest FROM part")


def _union(s, d):
    """Two rules over nodes, one of them twice, and one over edges, as the library's operators give them."""
    n, e = view(s, d, "v_flow_nodes"), view(s, d, "v_flow_edges")
    off = lambda code: o.except_allowed(n, ["api_fetch", "await_signal", "wait", "map", "return"]).select("flow_id", F.lit(code).alias("code"), F.col("node_id").alias("target"), F.lit("error").alias("severity"), F.col("type").alias("message"), F.col("pos").alias("place"))
    refs = m.unknown_output_refs(e, n, extension.catalog(s)).select("flow_id", F.lit("EDGE").alias("code"), F.concat_ws(".", "node_id", "key").alias("target"), F.lit("warning").alias("severity"), F.col("suggestion").alias("message"), F.col("pos").alias("place"))
    nth = F.row_number().over(Window.partitionBy("flow_id").orderBy("stage", "place", "rule", "k", "code", "target"))
    return o.union_issues(off("TYPE"), refs, off("TYPE")).select("flow_id", "code", "target", "severity", "message", nth.alias("nth"))


RULES = """SELECT flow_id, 0 AS rule, pos, 'TYPE' AS code, node_id AS target, 'error' AS severity, type AS message FROM v_flow_nodes WHERE type = 'mystery'
  UNION ALL SELECT e.flow_id, 1, e.pos, 'EDGE', concat(n.node_id, '.outcom'), 'warning', CASE WHEN n.type = 'api_fetch' THEN 'outcome' ELSE '' END FROM v_flow_edges e JOIN v_flow_nodes n ON e.flow_id = n.flow_id AND e.src = n.node_id WHERE loop_edge = 1 AND n.type <> 'mystery'
  UNION ALL SELECT flow_id, 2, pos, 'TYPE', node_id, 'error', type FROM v_flow_nodes WHERE type = 'mystery'"""
add("set_1_union_issues", _union, f"SELECT flow_id, code, target, severity, message, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY rule, pos, code, target) AS INTEGER) AS nth FROM ({RULES}) AS r")
add("set_2_normalize_keys", over("v_waits", lambda w: w.select("wait_id", F.array_join(o.normalize_keys(F.array(F.concat(F.lit(" "), "signal_type", F.lit(" ")), F.col("correlation_key"), F.lit("  "), F.col("signal_type"))), ",").alias("keys"))),
    "SELECT wait_id, array_to_string(list_sort(list_distinct(list_filter([trim(signal_type), correlation_key], lambda x: x <> ''))), ',') AS keys FROM v_waits")
WITH_AGENTS = "SELECT flow_id, pos, node_id, duration_seconds, CASE WHEN type = 'mystery' THEN 'agent_loop' ELSE type END AS type FROM v_flow_nodes"
add("set_3_except_allowed", lambda s, d: o.except_allowed(query(s, d, WITH_AGENTS), ["api_fetch", "return", "wait", "agent_loop"], allow_agent_loop=False).select("flow_id", "node_id", "type"),
    f"SELECT flow_id, node_id, type FROM ({WITH_AGENTS}) AS a WHERE type NOT IN ('api_fetch', 'return', 'wait')")
HOSTS = [
    ("localhost:8080", True), ("10.1.2.3", True), ("169.254.169.254", True), ("172.20.0.1", True), ("[::1]:80", True), ("[fd00::1]", True), ("[fe80::1]", True), ("[::ffff:127.0.0.1]", True),
    ("[::ffff:c0a8:101]", True), ("metadata.google.internal", True), ("8.8.8.8", False), ("[2001:db8::1]", False), ("172.32.0.1", False), ("localhost.example", False), ("[::ffff:8.8.8.8]", False), ("[fec1::1]", False),
]
PICKED = f"CASE page_id % {len(HOSTS) + 2} " + " ".join(f"WHEN {i} THEN '{{}}'" for i in range(len(HOSTS))) + f" WHEN {len(HOSTS)} THEN {{}} ELSE {{}} END"
URLS = "SELECT page_id, " + PICKED.format(*(f"http://{h}/x" for h, _ in HOSTS), "'not a url'", "url") + " AS url FROM pages"
SCREENED = "SELECT page_id, CAST(" + PICKED.format(*(str(b).lower() for _, b in HOSTS), "'true'", "'false'") + " AS BOOLEAN) AS blocked FROM pages"
add("set_4_blocked_urls", lambda s, d: o.blocked_urls(query(s, d, URLS)).select("page_id", "blocked"), SCREENED)
