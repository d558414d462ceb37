"""The canonical views over the driver tables: one SQL text each, the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    "v_cases": r"""
SELECT o_orderkey AS run_id, o_custkey AS app_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'waiting' ELSE 'queued' END AS status,
       o_orderpriority AS label, o_totalprice AS amount, o_orderdate AS started_at
FROM orders
""",
    "v_attempts": r"""
SELECT l_orderkey AS run_id, concat('n', l_linenumber) AS node_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate, l_partkey, l_suppkey) AS BIGINT) AS iteration,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'return' ELSE 'step' END AS node_type,
       CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'completed' END AS status,
       CASE l_linestatus WHEN 'O' THEN 'continue' ELSE 'fail' END AS on_error,
       CAST(floor(l_quantity) AS BIGINT) AS input_tokens,
       CAST(floor(l_extendedprice / 100) AS BIGINT) AS output_tokens,
       l_shipdate AS started_at, l_partkey AS part_id, l_suppkey AS source_id
FROM lineitem
""",
    "v_signals": r"""
SELECT event_id, concat('k-', user_id, '-', CAST(floor(value) AS BIGINT)) AS idempotency_key,
       user_id AS app_id,
       CASE WHEN event_id % 3 = 0 THEN concat(event_type, '.retry')
            WHEN event_id % 7 = 0 THEN concat(event_type, 'x') ELSE event_type END AS signal_type,
       concat('c', user_id % 50) AS correlation_key,
       CAST(1704067200 + event_id * 259 AS BIGINT) AS observed_unix,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('', event_id % 4) END AS payload_outcome,
       event_type AS payload_reason
FROM events
""",
    "v_waits": r"""
SELECT c_custkey AS wait_id, c_custkey AS run_id, concat('n', c_nationkey % 5) AS node_id,
       CASE WHEN c_custkey % 4 = 0 THEN 'timer' ELSE 'signal' END AS kind,
       CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('c', c_custkey % 50) END AS correlation_key,
       CASE c_nationkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
            WHEN 3 THEN 'signup' WHEN 4 THEN 'view' ELSE '' END AS signal_type,
       c_custkey % 2 = 0 AS needs_outcome,
       CAST(1704067200 + c_custkey * 1500 AS BIGINT) AS parked_unix,
       CAST(CASE WHEN c_custkey % 5 = 0 THEN 0
            ELSE 1704067200 + c_custkey * 1500 + (c_custkey % 5) * 86400 END AS BIGINT) AS resume_unix
FROM customer
""",
    "v_flow_nodes": r"""
SELECT l_orderkey AS flow_id, CAST(l_linenumber AS BIGINT) AS pos, concat('n', l_linenumber) AS node_id,
       CASE WHEN max(l_returnflag) = 'A' THEN 'return'
            WHEN min(l_partkey) % 9 = 0 THEN 'await_signal' WHEN min(l_partkey) % 9 = 1 THEN 'wait'
            WHEN min(l_partkey) % 9 = 2 THEN 'map' WHEN min(l_partkey) % 9 = 3 THEN 'mystery'
            ELSE 'api_fetch' END AS type,
       CAST(floor(sum(l_quantity)) AS BIGINT) AS duration_seconds
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "v_flow_edges": r"""
WITH n AS (SELECT l_orderkey AS f, l_linenumber AS i,
                  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
                  CAST(floor(sum(l_quantity)) AS BIGINT) AS q
           FROM lineitem GROUP BY l_orderkey, l_linenumber),
     w AS (SELECT f, i, r, q, lead(i) OVER (PARTITION BY f ORDER BY i) AS nx,
                  min(i) OVER (PARTITION BY f) AS mn FROM n)
SELECT f AS flow_id, CAST(i AS BIGINT) AS pos, concat('n', i) AS src, concat('n', nx) AS dst,
       concat('results.n', i, '.status == ''success''') AS condition, CAST(0 AS BIGINT) AS max_traversals,
       0 AS loop_edge
FROM w WHERE nx IS NOT NULL
UNION ALL
SELECT f, CAST(1000 + i AS BIGINT), concat('n', i), concat('n', mn), concat('results.n', i, '.outcom != ''0'''), q % 3, 1
FROM w WHERE r = 1
""",
    "v_flow_nodes_raw": r"""
SELECT l_orderkey AS flow_id, concat('n', l_linenumber) AS node_id, l_partkey AS part_id FROM lineitem
""",
    "v_flow_edges_raw": r"""
SELECT l_orderkey AS flow_id, concat('n', l_linenumber - 1) AS src, concat('n', l_linenumber) AS dst
FROM lineitem WHERE l_linenumber > 1
""",
    "v_responses": r"""
SELECT doc_id, source, lang,
       CASE doc_id % 5
         WHEN 0 THEN text
         WHEN 1 THEN concat('```json', chr(10), '{"outcome_index": ', doc_id % 4, ', "confidence": "high", "reasoning": "r', doc_id, '"}', chr(10), '```')
         WHEN 2 THEN concat(substr(text, 1, 40), ' {"note": 1} then {"outcome_index": ', doc_id % 4, ', "reasoning": "two"}')
         WHEN 3 THEN '{"outcome_index": 9, "confidence": null, "reasoning": "range"}'
         ELSE concat('{"outcome_index": ', doc_id % 3, ', "confidence": "low", "reasoning": "c", "citations": ["a", "b"]}')
       END AS raw
FROM documents
""",
    "v_reports": r"""
SELECT doc_id AS report_id,
       CASE doc_id % 6
         WHEN 0 THEN concat('{"status": "success", "outcome": ', doc_id % 3, ', "tags": ["x"]}')
         WHEN 1 THEN '{"status": "   "}' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'not json'
         WHEN 4 THEN '{"decision": "cancel", "confidence": "low", "reasoning": null, "extra": true}'
         ELSE '{"status": 5, "decision": "reaffirm"}' END AS body
FROM documents
""",
    "v_fetches": r"""
SELECT event_id AS fetch_id, user_id AS app_id,
       CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 404 ELSE 500 END AS INT) AS http_status,
       props AS body
FROM events
""",
    "v_sources": r"""
SELECT l_partkey AS app_id, l_suppkey AS source_id, l_returnflag AS outcome,
       CASE WHEN l_quantity < 3 THEN 'failed' ELSE 'success' END AS status
FROM lineitem
""",
    "v_revisions": r"""
SELECT l_orderkey AS run_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS revision,
       CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'running' END AS status
FROM lineitem
""",
    "v_callbacks": r"""
SELECT o_orderkey AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'waiting' ELSE 'failed' END AS status,
       CAST(o_orderkey % 70 AS BIGINT) AS attempts, o_orderkey % 3 = 0 AS delivered,
       CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'https://callback.example' END AS url,
       CAST(1704067200 + o_orderkey AS BIGINT) AS last_attempt_unix
FROM orders
""",
    "v_inputs": r"""
SELECT o_orderkey AS run_id, 'market.question' AS k, concat('Will order ', o_orderkey, ' ship?') AS v FROM orders
UNION ALL SELECT o_orderkey, 'market.outcomes_json', '["Yes","No","Other"]' FROM orders
UNION ALL SELECT o_orderkey, 'market.priority', o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, 'api_token', 'hidden' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, '__depth', '1' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, '  ', 'blank key' FROM orders WHERE o_orderkey % 5 = 0
""",
    "v_hops": r"""
SELECT a.run_id, a.node_id AS src, e.dst, a.iteration, e.loop_edge, e.max_traversals,
       a.status = 'completed' AS satisfied, a.started_at, a.part_id, a.source_id
FROM v_attempts a JOIN v_flow_edges e ON a.run_id = e.flow_id AND a.node_id = e.src
""",
    "v_issues": r"""
SELECT flow_id, 'UNKNOWN_NODE_TYPE' AS code, node_id AS target, 'error' AS severity,
       concat('Unknown node type "', type, '".') AS message
FROM v_flow_nodes WHERE type = 'mystery'
UNION ALL
SELECT flow_id, 'EDGE_UNKNOWN_OUTPUT_KEY', concat(src, '->', dst), 'warning',
       concat('Edge references "results.', src, '.outcom".')
FROM v_flow_edges WHERE loop_edge = 1
""",
    "v_urls": r"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://localhost:8080/x' WHEN 1 THEN 'http://10.1.2.3/'
       WHEN 2 THEN 'http://169.254.169.254/latest' WHEN 3 THEN 'not a url' ELSE url END AS url
FROM pages
""",
}


# Views that window or group lines by order, and how many lines a task gets for that.
BY_ORDER, LINES = {"v_attempts", "v_flow_nodes", "v_flow_edges", "v_revisions"}, 1_250_000


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows dealt by key to as many tasks as give each some `most` rows, whatever their number. Windows and groups of the key, alone or
    with others, then sort within these tasks, and need no other shuffle."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(n, key)


def needs(sql: str) -> list[str]:
    """The views that a text names, with those that they name, in an order in which they can be defined."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in [*needs(VIEWS[name]), name] if x not in found]
    return found


def with_views(sql: str) -> str:
    """The text with the views that it names as common table expressions, as any SQL engine runs it."""
    defs = [f"{n} AS ({VIEWS[n].strip()})" for n in needs(sql)]
    body = sql.strip()
    if not defs:
        return body
    own = re.match(r"WITH (RECURSIVE )?", body)
    return f"WITH {own and own[1] or ''}{', '.join(defs)}" + (f",\n{body[own.end():]}" if own else f"\n{body}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The text over the tables of a directory."""
    full = with_views(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", full):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t == "lineitem" and BY_ORDER.intersection(needs(sql)):
                rows = dealt(rows, "l_orderkey", LINES)
            rows.createOrReplaceTempView(t)
    return spark.sql(full)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}")
