"""Queries of the text, JSON and batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as b
from ..operators import judgments as j
from .views import query, view, with_views

Q, SQL = {}, {}


def add(name, build, sql):
    Q[name] = build
    if sql:
        SQL[name] = with_views(sql)


def over(view_name, f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, view_name))


def table(name, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


MAPPING = {"click": "yes", "purchase": "yes", "error": "no", "view": ""}
ALLOWED = '["Yes","No","Other"]'

add("txt_1_json_path", table("events", lambda e: j.json_path_extract(e.withColumn("body", F.when(F.col("event_id") % 5 == 0, "no json").when(F.col("event_id") % 5 == 1, "[1]").when(F.col("event_id") % 5 == 2, '{"a": {"k": null}}').otherwise(F.concat(F.lit('{"a": '), "props", F.lit("}")))), "body", "a.k").select("event_id", "extracted", "error")),
    "SELECT event_id, CASE WHEN event_id % 5 > 2 THEN json_extract_string(props, '$.k') ELSE '' END AS extracted, CASE event_id % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object at a' ELSE '' END AS error FROM events")
add("txt_2_map_outcome", table("events", lambda e: j.map_outcome(e, "event_type", MAPPING).select("event_id", "outcome")),
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'yes' WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' ELSE event_type END AS outcome FROM events")
RAW = "CASE doc_id % 5 WHEN 1 THEN concat('{\"outcome_index\": ', doc_id % 4, ', \"confidence\": \"high\", \"reasoning\": \"r', doc_id, '\"}') "
WS = "regexp_replace(%s, '^\\s+|\\s+$', '', 'g')"
add("txt_3_trim_code_fence", over("v_responses", lambda r: r.select("doc_id", j.trim_code_fence(F.col("raw")).alias("body"))), f"SELECT doc_id, {RAW} ELSE {WS % 'raw'} END AS body FROM v_responses")
add("txt_4_extract_json", over("v_responses", lambda r: j.extract_json(r.withColumn("t", j.trim_code_fence(F.col("raw"))), "t").select("doc_id", "json")),
    f"SELECT doc_id, {RAW} WHEN 2 THEN concat('{{\"outcome_index\": ', doc_id % 4, ', \"reasoning\": \"two\"}}') ELSE {WS % 'raw'} END AS json FROM v_responses")
JUDGED = """SELECT doc_id, CASE WHEN idx >= 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN idx IS NULL OR idx >= 3 THEN 'inconclusive' ELSE CAST(idx AS VARCHAR) END AS outcome,
  CASE k WHEN 1 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END AS confidence, CASE k WHEN 1 THEN concat('r', doc_id) WHEN 2 THEN 'two' WHEN 3 THEN 'range' WHEN 4 THEN 'c' ELSE '' END AS reasoning,
  CAST(CASE WHEN k = 4 THEN 2 ELSE 0 END AS BIGINT) AS citation_count, false AS index_missing
  FROM (SELECT doc_id, doc_id % 5 AS k, CASE doc_id % 5 WHEN 1 THEN doc_id % 4 WHEN 2 THEN doc_id % 4 WHEN 3 THEN 9 WHEN 4 THEN doc_id % 3 END AS idx FROM documents) AS x"""
add("txt_5_parse_judgments", over("v_responses", lambda r: j.parse_judgments(r, "raw", F.lit(ALLOWED)).select("doc_id", "status", "outcome", "confidence", "reasoning", "citation_count", "index_missing")), JUDGED)
add("txt_6_confidence", table("events", lambda e: e.select("event_id", j.normalize_confidence(F.when(F.col("event_id") % 4 == 0, ' "High" ').when(F.col("event_id") % 4 == 1, "null").when(F.col("event_id") % 4 == 2, " ").otherwise(F.col("event_type"))).alias("confidence"))),
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 3 THEN event_type ELSE 'medium' END AS confidence FROM events")
add("txt_7_outcome_range", table("events", lambda e: e.select("event_id", j.check_outcome_range(F.col("event_id") % 5 - 1, F.when(F.col("user_id") % 9 == 0, "oops").otherwise(ALLOWED)).alias("error"))),
    "SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'allowed outcomes are no list' WHEN event_id % 5 - 1 NOT BETWEEN 0 AND 2 THEN 'outcome out of range' ELSE '' END AS error FROM events")


def _validate(r):
    missing, extra = j.validate_structured(F.col("body"), ["status", "outcome"], ["status", "outcome", "decision"])
    return r.select("report_id", missing.alias("missing"), F.array_join(extra, ",").alias("extra"))


add("txt_8_validate", over("v_reports", _validate), "SELECT report_id, CASE report_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'outcome' WHEN 5 THEN 'outcome' ELSE 'status' END AS missing, CASE report_id % 6 WHEN 0 THEN 'tags' WHEN 4 THEN 'confidence,extra,reasoning' ELSE '' END AS extra FROM v_reports")
add("txt_9_flatten", over("v_reports", lambda r: r.select("report_id", F.explode(j.flatten_structured(F.col("body"))).alias("k", "v"))),
    """SELECT report_id, unnest([ 'output.status', 'output.outcome', 'output.tags' ]) AS k, unnest(['success', CAST(report_id % 3 AS VARCHAR), '["x"]']) AS v FROM v_reports WHERE report_id % 6 = 0
       UNION ALL SELECT report_id, 'output.status', '   ' FROM v_reports WHERE report_id % 6 = 1
       UNION ALL SELECT report_id, unnest(['output.decision', 'output.confidence', 'output.reasoning', 'output.extra']), unnest(['cancel', 'low', '', 'true']) FROM v_reports WHERE report_id % 6 = 4
       UNION ALL SELECT report_id, unnest(['output.status', 'output.decision']), unnest(['5', 'reaffirm']) FROM v_reports WHERE report_id % 6 = 5""")
add("txt_10_finalize", over("v_responses", lambda r: j.finalize_resolution(j.extract_json(r.withColumn("t", j.trim_code_fence(F.col("raw"))), "t"), "json", F.lit(ALLOWED)).select("doc_id", "status", "outcome", "error")),
    """SELECT doc_id, CASE WHEN idx IS NULL OR idx >= 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN idx IS NULL OR idx >= 3 THEN 'inconclusive' ELSE CAST(idx AS VARCHAR) END AS outcome,
         CASE WHEN idx IS NULL THEN 'the resolution is no JSON object' WHEN idx >= 3 THEN 'outcome out of range' ELSE '' END AS error
       FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 3 THEN 9 WHEN 4 THEN doc_id % 3 ELSE doc_id % 4 END AS idx FROM documents) AS x""")
add("txt_11_normalize_return", over("v_reports", lambda r: r.select("report_id", j.normalize_return(F.col("body")).alias("error"))),
    "SELECT report_id, CASE report_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'status is blank' WHEN 2 THEN 'not an object' WHEN 3 THEN 'invalid JSON' ELSE 'status must be text' END AS error FROM v_reports")
add("txt_12_truncate", table("documents", lambda d: d.select("doc_id", "text", j.truncate_payload(F.col("text"), 1000).alias("p")).select("doc_id", (F.col("p") == F.col("text")).alias("whole"), F.coalesce(F.get_json_object("p", "$.original_bytes").try_cast("bigint"), F.lit(0)).alias("original_bytes"), F.coalesce(F.when(F.col("p") != F.col("text"), F.get_json_object("p", "$.content")), F.lit("")).alias("content"))),
    """SELECT doc_id, strlen(text) <= 1000 AS whole, CASE WHEN strlen(text) > 1000 THEN strlen(text) ELSE 0 END AS original_bytes,
         CASE WHEN strlen(text) > 1000 THEN left(text, CAST(list_max(list_filter(range(0, 745), lambda k: strlen(left(text, k)) <= 744)) AS BIGINT)) ELSE '' END AS content FROM documents""")
add("txt_13_message_text", table("conversations", lambda m: m.select("conv_id", "turn", j.message_text(F.array(F.concat(F.lit("["), "role", F.lit("]")), F.lit("  "), F.col("text"))).alias("t"))),
    "SELECT conv_id, turn, CASE WHEN regexp_full_match(text, '\\s*') THEN concat('[', role, ']') ELSE concat('[', role, ']', chr(10), text) END AS t FROM conversations")
add("txt_14_tail", table("conversations", lambda m: j.transcript_tail(m, 60)),
    f"SELECT conv_id, right(b, CAST(list_max(list_filter(range(0, 61), lambda k: strlen(right(b, k)) <= 60)) AS BIGINT)) AS tail FROM (SELECT conv_id, arg_max({WS % 'text'}, turn) AS b FROM conversations WHERE NOT regexp_full_match(text, '\\s*') GROUP BY conv_id) AS x")
add("txt_15_compact", table("conversations", lambda m: j.compact_transcript(m, 3, pairs=False).select("conv_id", "turn")),
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) AS x WHERE k <= 3")
add("txt_15b_compact_pairs", table("conversations", lambda m: j.compact_transcript(m, 4).select("conv_id", "turn")),
    """WITH RECURSIVE g AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END AS fresh FROM conversations),
      m AS (SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM g),
      s AS (SELECT conv_id, segment, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY segment DESC) AS k FROM m GROUP BY conv_id, segment),
      walk AS (SELECT conv_id, segment, k, n <= 4 AS stays, CASE WHEN n <= 4 THEN n ELSE 0 END AS used FROM s WHERE k = 1
        UNION ALL SELECT s.conv_id, s.segment, s.k, used + n <= 4, CASE WHEN used + n <= 4 THEN used + n ELSE used END FROM walk JOIN s ON s.conv_id = walk.conv_id AND s.k = walk.k + 1)
      SELECT m.conv_id, m.turn FROM m JOIN walk ON m.conv_id = walk.conv_id AND m.segment = walk.segment WHERE stays""")
add("txt_16_call_stats", table("conversations", lambda m: j.tool_call_stats(m.filter("role <> 'system'").withColumn("call", F.concat("role", F.col("turn").cast("string"))))),
    "SELECT conv_id, count(*) AS n_calls, string_agg(concat(role, turn), ',' ORDER BY turn, role) AS calls FROM conversations WHERE role <> 'system' GROUP BY conv_id")
add("txt_17_classify", over("v_fetches", lambda f: j.classify_responses(f, "k", {"7": "seven"}).select("fetch_id", "status", "error", "outcome")),
    "SELECT fetch_id, CASE WHEN http_status < 300 THEN 'success' ELSE 'failed' END AS status, CASE WHEN http_status < 300 THEN '' ELSE concat('HTTP ', http_status) END AS error, CASE WHEN http_status >= 300 THEN '' WHEN k = '7' THEN 'seven' ELSE k END AS outcome FROM (SELECT *, json_extract_string(body, '$.k') AS k FROM v_fetches) AS x")

ITEMS = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"


def _arrays(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("items"))


add("bat_1_explode_items", lambda s, d: b.explode_items(_arrays(s, d), "items", 15).select("o_custkey", F.col("pos").cast("long").alias("pos"), F.col("item").try_cast("bigint").alias("item"), "error"),
    f"SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey AS item, '' AS error FROM orders WHERE o_custkey IN (SELECT o_custkey FROM ({ITEMS}) AS x WHERE n <= 15) UNION ALL SELECT o_custkey, 0, NULL, 'too many items' FROM ({ITEMS}) AS x WHERE n > 15")
add("bat_2_batch", table("orders", lambda o: b.batch(o, ["o_custkey"], ["o_orderkey"], 4)),
    "SELECT o_custkey, CAST(i // 4 AS BIGINT) AS batch_index, CAST(min(i) AS BIGINT) AS batch_start_index, CAST(max(i) AS BIGINT) AS batch_end_index, count(*) AS batch_item_count FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) AS x GROUP BY o_custkey, i // 4")


class StepsFailed(ValueError):
    """All steps of a batch failed; what they used counts."""

    def __init__(self, batch):
        super().__init__("all steps failed")
        self.usage = (sum(batch["input_tokens"]), 0)


def _tokens(batch):
    if all(s == "failed" for s in batch["status"]):
        raise StepsFailed(batch)
    used = sum(batch["output_tokens"])
    return used, sum(batch["input_tokens"]), used


def _apply(on_error, concurrency=1):
    return over("v_attempts", lambda a: b.apply_batches(a.select("run_id", "node_id", "status", "input_tokens", "output_tokens"), ["run_id", "node_id"], _tokens, "result long", on_error, concurrency, lists=True))


APPLIED = """SELECT run_id, node_id, bool_and(status = 'failed') AS bad, CAST(sum(output_tokens) AS BIGINT) AS out_tokens, CAST(sum(input_tokens) AS BIGINT) AS in_tokens FROM v_attempts GROUP BY run_id, node_id"""
add("bat_3_apply_batches", _apply("continue"),
    f"SELECT run_id, node_id, CASE WHEN NOT bad THEN out_tokens END AS result, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'all steps failed' ELSE '' END AS error, in_tokens AS input_tokens, CASE WHEN bad THEN 0 ELSE out_tokens END AS output_tokens FROM ({APPLIED}) AS x")
add("bat_3b_fail_fast", _apply("fail"),
    f"""SELECT run_id, node_id, CASE WHEN NOT bad AND NOT off THEN out_tokens END AS result, CASE WHEN off THEN 'skipped' WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad AND NOT off THEN 'all steps failed' ELSE '' END AS error,
        CASE WHEN off THEN 0 ELSE in_tokens END AS input_tokens, CASE WHEN bad OR off THEN 0 ELSE out_tokens END AS output_tokens
        FROM (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY run_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS off FROM ({APPLIED}) AS x) AS y""")
BATCHES = "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY node_id, iteration) AS BIGINT) AS idx, status, CASE WHEN status = 'failed' THEN concat('e-', node_id) ELSE '' END AS error, output_tokens FROM v_attempts"
SKIP = f"SELECT run_id, idx, error, output_tokens, CASE WHEN max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'skipped' ELSE status END AS status FROM ({BATCHES}) AS x"
add("bat_4_skip_after_failure", lambda s, d: b.skip_after_failure(query(s, d, BATCHES), "run_id", "idx").select("run_id", "idx", "status"), f"SELECT run_id, idx, status FROM ({SKIP}) AS y")
add("bat_5_rollup", lambda s, d: b.batch_rollup(b.skip_after_failure(query(s, d, BATCHES), "run_id", "idx"), "run_id", "idx", "output_tokens"),
    f"""SELECT run_id, count(*) AS total, completed, failed, skipped, first_error, usage, CASE WHEN completed = total THEN 'success' WHEN completed > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT run_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, coalesce(min_by(error, CASE WHEN status = 'failed' THEN idx END), '') AS first_error, CAST(sum(output_tokens) AS BIGINT) AS usage FROM ({SKIP}) AS y GROUP BY run_id) AS z""".replace("SELECT run_id, count(*) AS total, completed", "SELECT run_id, total, completed", 1))


def _nested(spark, d):
    """Orders of a customer, with the lines of each, as JSON: groups that stay small."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    orders = t("orders").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "parts")))).alias("orders"))
    rows = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "orders")
    out = b.nested_explode(rows, ["orders", "parts"], max_items=12)
    return out.select("c_custkey", F.col("pos").cast("long").alias("pos"), F.col("item").try_cast("bigint").alias("part"), "error")


add("bat_6_nested_explode", _nested, """WITH o AS (SELECT c_custkey, o_orderkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey),
  l AS (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos FROM lineitem)
  SELECT DISTINCT c_custkey, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS part, 'too many items' AS error FROM o WHERE n > 12
  UNION ALL SELECT c_custkey, pos, l_partkey, '' FROM o JOIN l ON o_orderkey = l_orderkey WHERE n <= 12 AND m <= 12
  UNION ALL SELECT c_custkey, 0, NULL, 'too many items' FROM o JOIN (SELECT DISTINCT l_orderkey FROM l WHERE m > 12) AS x ON o_orderkey = l_orderkey WHERE n <= 12""")
