"""Queries of the matching, graph and extension operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extension as e
from ..operators import graphs as g
from ..operators import matching as m
from ..operators import outcomes as o
from .views import query, view, with_views

Q, SQL = {}, {}
NOW = 1704067200 + 30 * 86400


def add(name, build, sql=None):
    Q[name] = build
    if sql:
        SQL[name] = with_views(sql)


def both(a, b, f):
    return lambda s, d: f(view(s, d, a), view(s, d, b))


MATCH = """SELECT w.wait_id, s.event_id, s.idempotency_key, s.payload_outcome, s.observed_unix, w.needs_outcome, w.parked_unix FROM v_waits w JOIN v_signals s ON w.kind = 'signal' AND (w.correlation_key = '' OR w.correlation_key = s.correlation_key)
  AND (w.signal_type = '' OR w.signal_type = s.signal_type OR starts_with(s.signal_type, concat(w.signal_type, '.')))"""
VALID = f"SELECT * FROM ({MATCH}) AS mm WHERE NOT needs_outcome OR payload_outcome <> ''"
add("jon_1_match_signals", both("v_waits", "v_signals", m.match_totals),
    f"SELECT wait_id, count(*) AS n, min(event_id) AS first_event, CAST(sum(event_id) AS BIGINT) AS events FROM ({MATCH}) AS x GROUP BY wait_id")
add("jon_2_payload_ok", lambda s, d: view(s, d, "v_signals").select("event_id", m.payload_ok(F.array(F.lit("reason"), F.lit("outcome")), F.create_map(F.lit("outcome"), F.col("payload_outcome"), F.lit("reason"), F.col("payload_reason"))).alias("missing")),
    "SELECT event_id, CASE WHEN payload_outcome = '' THEN 'outcome' ELSE '' END AS missing FROM v_signals")
add("jon_3_first_match", both("v_waits", "v_signals", m.first_match),
    f"SELECT wait_id, idempotency_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY wait_id ORDER BY idempotency_key, event_id) AS k FROM ({VALID}) AS v) AS x WHERE k = 1")
# Wait by wait in parking order, each takes the first of its signals that is not used. Of a wait's signals the n first are enough for the n-th wait.
SERIAL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY idempotency_key, event_id) AS i FROM v_signals),
  p AS (SELECT w.wait_id, w.parked_unix, list(e.i ORDER BY e.i) AS fits FROM v_waits w JOIN e ON (w.correlation_key = '' OR w.correlation_key = e.correlation_key)
      AND (w.signal_type = '' OR w.signal_type = e.signal_type OR starts_with(e.signal_type, concat(w.signal_type, '.'))) AND (NOT w.needs_outcome OR e.payload_outcome <> '')
    WHERE w.kind = 'signal'{0} GROUP BY w.wait_id, w.parked_unix),
  o AS MATERIALIZED (SELECT wait_id, n, fits[1:n] AS fits FROM (SELECT *, row_number() OVER (ORDER BY parked_unix, wait_id) AS n FROM p) AS x),
  walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pick, CAST([] AS BIGINT[]) AS used
    UNION ALL SELECT n, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
    FROM (SELECT o.n, walk.used, list_filter(o.fits, lambda x: NOT list_contains(walk.used, x))[1] AS pick FROM walk JOIN o ON o.n = walk.n + 1) AS y)
  SELECT o.wait_id, e.idempotency_key, e.event_id FROM walk JOIN o ON o.n = walk.n JOIN e ON e.i = walk.pick"""
add("jon_3b_assign_once", both("v_waits", "v_signals", m.assign_once), SERIAL.format(""))
add("jon_3c_assign_keyed", lambda s, d: m.assign_once(query(s, d, "SELECT wait_id, kind, correlation_key, signal_type, needs_outcome, parked_unix FROM v_waits WHERE correlation_key <> ''"), view(s, d, "v_signals")),
    SERIAL.format(" AND w.correlation_key <> ''"))
# A wait parked in each case of its customer; signals that name a run, an app or neither.
PARKED = "SELECT w.wait_id, c.run_id, w.kind, w.correlation_key, w.signal_type, w.needs_outcome FROM v_waits w JOIN v_cases c ON c.app_id = w.wait_id"
SENT = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id % 1000 END AS run_id, CASE WHEN event_id % 10 = 1 THEN 0 ELSE app_id END AS app_id, correlation_key, signal_type, payload_outcome FROM v_signals"
ACTIVE = "SELECT app_id, min(run_id) AS r FROM v_cases WHERE status NOT IN ('completed', 'failed', 'cancelled') GROUP BY app_id"
TAKES = "p.kind = 'signal' AND (p.correlation_key = '' OR p.correlation_key = s.correlation_key) AND (p.signal_type = '' OR p.signal_type = s.signal_type OR starts_with(s.signal_type, concat(p.signal_type, '.')))"
TARGET = f"""SELECT s.event_id, coalesce(CASE WHEN s.run_id IS NOT NULL THEN c.run_id ELSE f.r END, -1) AS target FROM ({SENT}) s LEFT JOIN v_cases c ON c.run_id = s.run_id
  LEFT JOIN (SELECT s.event_id, min(p.run_id) AS r FROM ({SENT}) s JOIN (SELECT p.*, c.app_id FROM ({PARKED}) p JOIN v_cases c ON p.run_id = c.run_id WHERE c.status NOT IN ('completed', 'failed', 'cancelled')) p
    ON s.run_id IS NULL AND (s.app_id <= 0 OR s.app_id = p.app_id) AND {TAKES} GROUP BY s.event_id) f ON f.event_id = s.event_id"""


def _target(s, d):
    return m.signal_target(query(s, d, SENT), view(s, d, "v_cases"), query(s, d, PARKED))


add("jon_4_deliver", lambda s, d: m.deliver(query(s, d, PARKED), query(s, d, SENT).drop("run_id").join(_target(s, d).select("event_id", F.col("target").alias("run_id")), "event_id")),
    f"SELECT s.event_id, count(*) AS n_waits, bool_and(NOT needs_outcome OR payload_outcome <> '') AS accepted FROM ({SENT}) s JOIN ({TARGET}) t ON t.event_id = s.event_id JOIN ({PARKED}) p ON p.run_id = t.target AND {TAKES} GROUP BY s.event_id")


def _resumed(s, d):
    payload = F.map_filter(F.create_map(F.lit("outcome"), F.nullif("payload_outcome", F.lit("")), F.lit("reason"), F.col("payload_reason")), lambda _, v: v.isNotNull())
    e = view(s, d, "v_signals").withColumns({"defaults": F.create_map(F.lit("outcome"), F.lit("none"), F.lit("note"), F.lit("n")), "payload": payload})
    e = e.withColumns({"wait_input_tokens": F.col("event_id") % 7, "wait_output_tokens": F.lit(2), "signal_input_tokens": F.when(F.col("event_id") % 3 > 0, F.col("app_id")), "signal_output_tokens": F.col("event_id") % 5})
    out = m.resume_outputs(e, "defaults", "payload")
    return out.select("event_id", *(F.col("outputs")[k].alias(k) for k in ("status", "outcome", "note", "reason")), "input_tokens", "output_tokens")


add("jon_5_resume_outputs", _resumed,
    """SELECT event_id, 'success' AS status, CASE WHEN payload_outcome = '' THEN 'none' ELSE payload_outcome END AS outcome, 'n' AS note, payload_reason AS reason,
       event_id % 7 + CASE WHEN event_id % 3 > 0 THEN app_id ELSE 0 END AS input_tokens, 2 + event_id % 5 AS output_tokens FROM v_signals""")


def _timed_out(s, d):
    status = lambda v: F.create_map(F.lit("status"), F.lit(v))
    w = view(s, d, "v_waits").withColumns({
        "outputs": F.when((F.col("kind") == "timer") & (F.col("wait_id") % 9 > 0), status("success")).when(F.col("wait_id") % 7 == 1, status("given up")),
        "timeout_outputs": F.when(F.col("wait_id") % 7 > 1, status("timeout")),
    })
    out = m.timeouts(w, m.answered_in_time(w, view(s, d, "v_signals")), NOW)
    return out.select("wait_id", "kind", F.col("result")["status"].alias("status"))


add("jon_6_timeouts", _timed_out,
    f"""SELECT * FROM (SELECT w.wait_id, kind, CASE WHEN kind = 'signal' AND w.wait_id % 7 > 1 THEN 'timeout' WHEN kind = 'timer' AND w.wait_id % 9 > 0 THEN 'success' WHEN w.wait_id % 7 = 1 THEN 'given up' END AS status FROM v_waits w
        LEFT JOIN (SELECT wait_id, min(observed_unix) AS t FROM ({VALID}) AS v GROUP BY wait_id) AS x ON w.wait_id = x.wait_id WHERE resume_unix > 0 AND resume_unix <= {NOW} AND (t IS NULL OR t > resume_unix)) AS y WHERE status IS NOT NULL""")
add("jon_7_signal_target", _target, TARGET)
add("jon_8_reject_duplicates", lambda s, d: m.reject_duplicates(query(s, d, "SELECT c_custkey % 97 AS app_id, c_custkey AS submission FROM customer"), view(s, d, "v_cases")),
    f"SELECT q.app_id, submission, CASE WHEN q.app_id <= 0 THEN 'invalid app_id' WHEN r IS NOT NULL THEN 'active run' ELSE '' END AS rejected, coalesce(r, -1) AS active_run FROM (SELECT c_custkey % 97 AS app_id, c_custkey AS submission FROM customer) q LEFT JOIN ({ACTIVE}) a ON q.app_id = a.app_id")
DONE = "SELECT run_id, node_id, iteration, status, output_tokens, started_at, started_at + INTERVAL '1' DAY * CAST(part_id % 5 AS INT) AS completed_at FROM v_attempts"
add("jon_9_snapshot_asof", lambda s, d: m.snapshot_asof(query(s, d, DONE), "output_tokens"),
    f"SELECT a.run_id, a.node_id, a.iteration, b.node_id AS seen_node, max_by(b.output_tokens, (b.completed_at, b.iteration)) AS seen FROM ({DONE}) a JOIN ({DONE}) b ON a.run_id = b.run_id AND b.node_id <> a.node_id AND b.status = 'completed' AND b.completed_at <= a.started_at GROUP BY a.run_id, a.node_id, a.iteration, b.node_id")
# The output keys and config fields of the types in the flows, written out here once more.
KEYS = {
    "api_fetch": ("status outcome raw json_path_value error http_status", "url method headers body basic_auth json_path outcome_mapping timeout_seconds", 1),
    "await_signal": ("status", "reason signal_type correlation_key timeout_seconds required_payload default_outputs timeout_outputs", 1),
    "wait": ("status waited mode start_from anchor_ts ready_at remaining_seconds", "duration_seconds mode start_from max_inline_seconds", 2),
    "map": ("status results total_items total_batches completed_batches failed_batches skipped_batches first_error", "items_key inline batch_size batch_input_key batch_index_input_key batch_start_index_input_key batch_end_index_input_key batch_item_count_input_key max_concurrency on_error max_items max_depth per_batch_timeout_seconds input_mappings", 5),
    "return": ("status", "value from_key", 0),
}
KEY_ROWS = ", ".join(f"('{t}', {i}, '{k}')" for t, (keys, _, _) in KEYS.items() for i, k in enumerate(keys.split()))
add("jon_10_unknown_refs", lambda s, d: m.unknown_output_refs(view(s, d, "v_flow_edges"), view(s, d, "v_flow_nodes"), e.catalog(s)),
    f"""SELECT e.flow_id, e.pos, n.node_id, 'outcom' AS key, coalesce(near, '') AS suggestion FROM v_flow_edges e JOIN v_flow_nodes n ON e.flow_id = n.flow_id AND e.src = n.node_id
        JOIN (SELECT t, arg_min(CASE WHEN levenshtein('outcom', k) <= 3 THEN k END, CASE WHEN levenshtein('outcom', k) <= 3 THEN levenshtein('outcom', k) * 100 + r END) AS near FROM (VALUES {KEY_ROWS}) AS v(t, r, k) GROUP BY t) c ON c.t = n.type WHERE loop_edge = 1""")

NE = lambda f: both("v_flow_nodes", "v_flow_edges", f)
AHEAD = "SELECT * FROM v_flow_edges WHERE loop_edge = 0"
TYPES = list(e.CATALOG)
add("grf_1_roots", NE(lambda n, x: g.roots(n, g.forward(x, g.back_edges(n, x)))), f"SELECT flow_id, node_id FROM v_flow_nodes n WHERE NOT EXISTS (SELECT 1 FROM ({AHEAD}) e WHERE e.flow_id = n.flow_id AND e.dst = n.node_id)")
add("grf_2_back_edges", NE(g.back_edges), "SELECT flow_id, pos FROM v_flow_edges WHERE loop_edge = 1")
add("grf_3_topological_order", NE(g.topological_order), "SELECT flow_id, node_id, row_number() OVER (PARTITION BY flow_id ORDER BY pos) - 1 AS place FROM v_flow_nodes")
add("grf_4_reachable", NE(lambda n, x: g.reachable(n, x.filter("loop_edge = 0"))), "SELECT flow_id, node_id FROM v_flow_nodes")
BACK_REACH = """SELECT flow_id, node_id FROM v_flow_nodes n WHERE pos <= (SELECT max(pos) FROM v_flow_nodes r WHERE r.flow_id = n.flow_id AND r.type = 'return')
  OR EXISTS (SELECT 1 FROM v_flow_edges b JOIN v_flow_nodes s ON s.flow_id = b.flow_id AND s.node_id = b.src WHERE b.flow_id = n.flow_id AND b.loop_edge = 1 AND s.pos >= n.pos AND EXISTS (SELECT 1 FROM v_flow_nodes r WHERE r.flow_id = n.flow_id AND r.type = 'return'))"""
add("grf_5_reaches_return", NE(g.reaches), BACK_REACH)
ARROW = "concat(src, '->', dst)"
STRUCTURE = f"""SELECT flow_id, 'UNKNOWN_NODE_TYPE' AS code, node_id AS target FROM v_flow_nodes WHERE type = 'mystery'
  UNION ALL SELECT flow_id, 'SELF_LOOP', {ARROW} FROM v_flow_edges WHERE src = dst
  UNION ALL SELECT flow_id, 'BACK_EDGE_MISSING_MAX_TRAVERSALS', {ARROW} FROM v_flow_edges WHERE loop_edge = 1 AND max_traversals <= 0
  UNION ALL SELECT DISTINCT flow_id, 'NO_RETURN_NODE', '' FROM v_flow_nodes WHERE flow_id NOT IN (SELECT flow_id FROM v_flow_nodes WHERE type = 'return')
  UNION ALL SELECT DISTINCT e.flow_id, 'RETURN_HAS_OUTGOING', e.src FROM v_flow_edges e JOIN v_flow_nodes n ON e.flow_id = n.flow_id AND e.src = n.node_id WHERE n.type = 'return'
  UNION ALL SELECT flow_id, 'NON_RETURN_LEAF', node_id FROM v_flow_nodes n WHERE type <> 'return' AND NOT EXISTS (SELECT 1 FROM v_flow_edges e WHERE e.flow_id = n.flow_id AND e.src = n.node_id)
  UNION ALL SELECT flow_id, 'NO_RETURN_PATH', node_id FROM v_flow_nodes n WHERE flow_id IN (SELECT flow_id FROM v_flow_nodes WHERE type = 'return') AND (flow_id, node_id) NOT IN ({BACK_REACH.replace("v_flow_nodes n WHERE", "v_flow_nodes n WHERE", 1)})"""
add("grf_6_structure_issues", NE(lambda n, x: g.structure_issues(n, x, TYPES).select("flow_id", "code", "target")), STRUCTURE)
add("grf_6b_raw_structure", lambda s, d: g.structure_issues(query(s, d, "SELECT flow_id, part_id AS pos, node_id, 'return' AS type FROM v_flow_nodes_raw"), query(s, d, "SELECT flow_id, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY src, dst) AS BIGINT) AS pos, src, dst, CAST(1 AS BIGINT) AS max_traversals FROM v_flow_edges_raw"), TYPES).filter(F.col("code").isin("DUPLICATE_NODE_ID", "DUPLICATE_EDGE", "DANGLING_EDGE_SOURCE")).select("flow_id", "code", "target"),
    f"""SELECT flow_id, 'DUPLICATE_NODE_ID' AS code, node_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, node_id ORDER BY part_id) AS k FROM v_flow_nodes_raw) AS n WHERE k > 1
        UNION ALL SELECT flow_id, 'DUPLICATE_EDGE', {ARROW} FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, src, dst ORDER BY src) AS k FROM v_flow_edges_raw) AS e WHERE k > 1
        UNION ALL SELECT flow_id, 'DANGLING_EDGE_SOURCE', {ARROW} FROM v_flow_edges_raw e WHERE NOT EXISTS (SELECT 1 FROM v_flow_nodes_raw n WHERE n.flow_id = e.flow_id AND n.node_id = e.src)""")
WITH_AGENTS = "SELECT flow_id, pos, node_id, duration_seconds, CASE WHEN type = 'mystery' THEN 'agent_loop' ELSE type END AS type FROM v_flow_nodes"
BUDGETS = "SELECT run_id AS flow_id, CAST(run_id % 400 AS BIGINT) AS max_total_time_seconds, CAST(floor(amount) AS BIGINT) AS max_total_tokens FROM v_cases WHERE status <> 'waiting'"
POLICY = g.Policy(5, 6, ("api_fetch", "return", "wait", "map", "agent_loop"), False, 300, 250_000)
add("grf_8_policy_issues", lambda s, d: g.policy_issues(query(s, d, WITH_AGENTS), view(s, d, "v_flow_edges"), POLICY, query(s, d, BUDGETS)),
    f"""SELECT n.flow_id, CASE WHEN nn > 5 THEN 'too many nodes' WHEN coalesce(ne, 0) > 6 THEN 'too many edges' WHEN bad IS NOT NULL THEN bad
         WHEN coalesce(t, 0) <= 0 OR t > 300 THEN 'max_total_time_seconds must be set and at most 300' WHEN coalesce(k, 0) <= 0 OR k > 250000 THEN 'max_total_tokens must be set and at most 250000' ELSE '' END AS violation
       FROM (SELECT flow_id, count(*) AS nn, arg_min(CASE WHEN type = 'agent_loop' THEN 'agent_loop is not allowed' WHEN type = 'await_signal' THEN 'type not allowed: await_signal' END, CASE WHEN type IN ('agent_loop', 'await_signal') THEN pos END) AS bad FROM ({WITH_AGENTS}) AS x GROUP BY flow_id) n
       LEFT JOIN (SELECT flow_id, count(*) AS ne FROM v_flow_edges GROUP BY flow_id) e ON n.flow_id = e.flow_id LEFT JOIN (SELECT flow_id, max_total_time_seconds AS t, max_total_tokens AS k FROM ({BUDGETS}) AS b) b ON b.flow_id = n.flow_id""")
CONFIGURED = f"""SELECT flow_id, node_id, type, duration_seconds AS d, pos, concat('{{"duration_seconds": ', duration_seconds - 10, ', "mode": "', CASE duration_seconds % 3 WHEN 0 THEN 'sleep' WHEN 1 THEN '' ELSE CASE WHEN pos % 2 = 0 THEN 'defer' ELSE 'sleep' END END, '", "max_inline_seconds": ', (duration_seconds % 4 - 1) * 10,
    ', "async": ', CASE WHEN pos % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN duration_seconds % 17 = 0 THEN '' ELSE '}}' END) AS config FROM ({WITH_AGENTS}) AS x"""
add("grf_9_suspending_nodes", lambda s, d: g.suspending_nodes(query(s, d, CONFIGURED).drop("d", "pos")),
    f"""SELECT flow_id, string_agg(node_id, ',' ORDER BY node_id) AS offenders FROM ({CONFIGURED}) AS x WHERE type = 'await_signal' OR (type = 'agent_loop' AND pos % 2 = 0 AND d % 17 <> 0)
        OR (type = 'wait' AND (d % 17 = 0 OR (d % 3 = 2 AND pos % 2 = 0) OR (d > 10 AND d - 10 > CASE d % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE (d % 4 - 1) * 10 END))) GROUP BY flow_id""")
add("grf_10_route", lambda s, d: g.route(view(s, d, "v_cases").select("run_id", "status", "amount"), {"paid": F.col("amount") > 100000, "closed": F.col("status") == "completed", "log": None}).select("run_id", "branch"),
    "SELECT run_id, 'paid' AS branch FROM v_cases WHERE amount > 100000 UNION ALL SELECT run_id, 'closed' FROM v_cases WHERE status = 'completed' UNION ALL SELECT run_id, 'log' FROM v_cases")
# Users' ids as text, of which those of errors are no integers: conditions on them fail.
NAMED = "SELECT event_id, event_type, concat(CASE WHEN event_type = 'error' THEN 'u' ELSE '' END, user_id) AS name FROM events"


def _failing(s, d):
    n = F.col("name").try_cast("long")
    wrong = F.when(n.isNull(), F.concat(F.lit("no integer: "), F.col("name")))
    return g.route(query(s, d, NAMED), {"early": n < 100, "bought": F.col("event_type") == "purchase", "log": None}, {"early": wrong}).select("event_id", "branch", "error")


add("grf_10b_failing_conditions", _failing,
    f"""SELECT event_id, unnest(CASE WHEN event_type = 'error' THEN [NULL] ELSE list_filter([CASE WHEN TRY_CAST(name AS BIGINT) < 100 THEN 'early' END, CASE WHEN event_type = 'purchase' THEN 'bought' END, 'log'], lambda b: b IS NOT NULL) END) AS branch,
       CASE WHEN event_type = 'error' THEN concat('no integer: ', name) ELSE '' END AS error FROM ({NAMED}) AS x""")
# Cases as they stood 300 days after they began: what began later is not there yet, what began in the last 200 days is pending.
STATES = """SELECT a.run_id, a.node_id, max_by(CASE WHEN a.started_at > c.started_at + INTERVAL '100' DAY THEN 'pending' ELSE a.status END, a.iteration) AS status
  FROM v_attempts a JOIN v_cases c ON a.run_id = c.run_id WHERE a.started_at <= c.started_at + INTERVAL '300' DAY GROUP BY a.run_id, a.node_id"""
add("grf_11_frontier", lambda s, d: g.frontier_report(view(s, d, "v_flow_nodes"), view(s, d, "v_flow_edges").filter("loop_edge = 0"), query(s, d, STATES), view(s, d, "v_waits")),
    f"""WITH st AS ({STATES})
       SELECT n.flow_id, n.node_id, CASE WHEN max(s.status) <> 'pending' THEN max(s.status) WHEN bool_or(w.run_id IS NOT NULL) THEN 'waiting' WHEN count(e.src) = 0 OR bool_and(coalesce(p.status = 'completed', false)) THEN 'ready'
         WHEN count(DISTINCT e.src) > 1 AND bool_or(coalesce(p.status IN ('failed', 'skipped'), false)) THEN 'skipped' WHEN max(s.status) = 'pending' AND NOT coalesce(bool_or(f.bad), false) THEN 'orphaned' ELSE 'blocked' END AS state
       FROM v_flow_nodes n LEFT JOIN st s ON s.run_id = n.flow_id AND s.node_id = n.node_id LEFT JOIN (SELECT * FROM v_flow_edges WHERE loop_edge = 0) e ON e.flow_id = n.flow_id AND e.dst = n.node_id LEFT JOIN st p ON p.run_id = e.flow_id AND p.node_id = e.src
       LEFT JOIN (SELECT DISTINCT run_id, node_id FROM v_waits) w ON w.run_id = n.flow_id AND w.node_id = n.node_id LEFT JOIN (SELECT run_id, bool_or(status = 'failed') AS bad FROM st GROUP BY run_id) f ON f.run_id = n.flow_id GROUP BY n.flow_id, n.node_id""")
VALUE = "CASE WHEN x0 >= 1500 THEN x0 WHEN x0 * 1.5 >= 1500 THEN x0 * 1.5 WHEN x0 * 2.25 >= 1500 THEN x0 * 2.25 ELSE x0 * 3.375 END"


def _registered(spark, d):
    ops, line = e.Operators(), "l_orderkey bigint, l_linenumber {0}, l_extendedprice double, l_discount double"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    takes = line.format(lines.schema["l_linenumber"].dataType.simpleString())
    ops.register(spark, "net", lambda df: df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), takes, "net double")
    ops.register(spark, "big", lambda df: df.filter(F.col("net") > 50_000), "net double", "net double")
    return ops.apply(lines, "net", "big").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net")


add("udf_1_register", _registered, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")


def _dotted(row):
    parts = row["signal_type"].split(".")
    for n in range(1, len(parts) + 1):
        yield row["event_id"], ".".join(parts[:n])


def _from_sql(spark, d):
    """A table function that is registered by name and called from SQL, over parts of its table."""
    e.register_table_function(spark, "dotted_prefixes", _dotted, "event_id bigint, prefix string")
    view(spark, d, "v_signals").createOrReplaceTempView("all_signals")
    return spark.sql("SELECT event_id, prefix FROM dotted_prefixes(TABLE(SELECT event_id, signal_type FROM all_signals) PARTITION BY event_id)")


add("udf_1b_table_function", _from_sql, "SELECT event_id, unnest(list_transform(range(1, len(string_split(signal_type, '.')) + 1), lambda n: array_to_string(list_slice(string_split(signal_type, '.'), 1, n), '.'))) AS prefix FROM v_signals")


def _catalog(s, d):
    """The types of the flows' nodes with their output keys and config fields, in order."""
    one = lambda df, c, name: df.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]), " ").alias(name))
    schema = e.config_schema(s)
    numbers = schema.groupBy("type").agg(F.count_if(F.col("kind") == "integer").alias("n_integers"))
    n = view(s, d, "v_flow_nodes").groupBy("type").agg(F.count("*").alias("n"))
    return n.join(one(e.catalog(s), "key", "keys"), "type").join(one(schema, "field", "fields"), "type").join(numbers, "type")


add("udf_2_catalog", _catalog, "SELECT n.type, count(*) AS n, keys, fields, n_integers FROM v_flow_nodes n JOIN (VALUES " + ", ".join(f"('{t}', '{k}', '{f}', CAST({x} AS BIGINT))" for t, (k, f, x) in KEYS.items()) + ") AS c(type, keys, fields, n_integers) ON n.type = c.type GROUP BY n.type, keys, fields, n_integers")
add("udf_3_refine", lambda s, d: e.refine(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_retailprice").alias("price")), lambda x: x.withColumn("price", F.col("price") * 1.5), F.col("price") >= 1500, "price", 3).select("p_partkey", "price", F.col("passes").cast("long").alias("passes"), F.size("history").cast("long").alias("n_history"), "exhausted"),
    f"SELECT p_partkey, {VALUE} AS price, CAST(k AS BIGINT) AS passes, CAST(k AS BIGINT) AS n_history, x0 * 3.375 < 1500 AS exhausted FROM (SELECT p_partkey, p_retailprice AS x0, CASE WHEN p_retailprice >= 1500 THEN 0 WHEN p_retailprice * 1.5 >= 1500 THEN 1 WHEN p_retailprice * 2.25 >= 1500 THEN 2 ELSE 3 END AS k FROM part) AS x".replace("x0 * 1.5 >= 1500", "x0 * 1.5 >= 1500"))
