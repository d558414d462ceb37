"""Queries of lookups, projections and condition functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conditions as c
from ..operators import context as x
from .views import query, view, with_views

Q, SQL = {}, {}


def add(name, build, sql):
    Q[name], SQL[name] = build, with_views(sql)


def over(view_name, f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, view_name))


def table(name, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def inputs(f):
    return lambda spark, sf_dir: f(x.inputs_map(view(spark, sf_dir, "v_inputs")))


def results(attempts: DataFrame) -> DataFrame:
    """(run_id, inputs, results) with each node's last tokens as outputs, and all of them as runs."""
    n = attempts.groupBy("run_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("iteration", "status", "output_tokens"))).alias("r"))
    outputs = F.create_map(F.lit("status"), F.element_at("r", -1)["status"], F.lit("tokens"), F.element_at("r", -1)["output_tokens"].cast("string"))
    runs = F.transform("r", lambda e: F.create_map(F.lit("tokens"), e["output_tokens"].cast("string")))
    n = n.select("run_id", F.struct(F.col("node_id").alias("key"), F.struct(outputs.alias("outputs"), runs.alias("runs")).alias("value")).alias("e"))
    return n.groupBy("run_id").agg(F.map_from_entries(F.collect_list("e")).alias("results")).withColumn("inputs", F.create_map(F.lit("app.id"), F.col("run_id").cast("string")))


LAST = "SELECT run_id, node_id, arg_max(status, iteration) AS status, arg_max(output_tokens, iteration) AS tokens, count(*) AS n FROM v_attempts GROUP BY run_id, node_id"
PICK = "SELECT run_id, max(CASE WHEN k = 'market.question' THEN v END) AS q, max(CASE WHEN k = 'market.priority' THEN v END) AS p, max(CASE WHEN k = 'api_token' THEN 1 ELSE 0 END) AS t, max(CASE WHEN k = '__depth' THEN 1 ELSE 0 END) AS dp, max(CASE WHEN k = '  ' THEN 1 ELSE 0 END) AS b FROM v_inputs GROUP BY run_id"

add("prj_1_lookup", over("v_attempts", lambda a: results(a).select("run_id", x.lookup("run.id").alias("id"), x.lookup("inputs.app.id").alias("app"), x.lookup("results.n1.status").alias("status"), x.lookup("results.n1.tokens").alias("tokens"), x.lookup("n1.status").alias("bare"), F.size(F.from_json(x.lookup("results.n1.history"), "array<map<string,string>>")).cast("long").alias("n_history"))),
    f"SELECT r.run_id, CAST(r.run_id AS VARCHAR) AS id, CAST(r.run_id AS VARCHAR) AS app, coalesce(status, '') AS status, coalesce(CAST(tokens AS VARCHAR), '') AS tokens, '' AS bare, coalesce(n, 0) AS n_history FROM (SELECT DISTINCT run_id FROM v_attempts) r LEFT JOIN ({LAST}) l ON r.run_id = l.run_id AND l.node_id = 'n1'")
add("prj_2_interpolate", inputs(lambda d: d.select("run_id", x.interpolate("Q: {{ inputs.market.question }} [{{inputs.market.priority}}] {{missing}} {{run.id}} {{open").alias("prompt"))),
    f"SELECT run_id, concat('Q: ', q, ' [', coalesce(p, ''), ']  ', run_id, ' {{{{open') AS prompt FROM ({PICK}) AS x")
add("prj_3_interpolate_json", inputs(lambda d: d.select("run_id", x.interpolate_json({"status": "success", "id": "{{run.id}}", "n": 3, "list": ["{{inputs.market.priority}}", True]}).alias("body")).select("run_id", F.get_json_object("body", "$.id").alias("id"), F.get_json_object("body", "$.list[0]").alias("first"), F.get_json_object("body", "$.n").alias("n"))),
    f"SELECT run_id, CAST(run_id AS VARCHAR) AS id, coalesce(p, '') AS first, '3' AS n FROM ({PICK}) AS x")
add("prj_4_flatten_context", over("v_attempts", lambda a: results(a).select("run_id", F.explode(x.flatten_context(F.col("inputs"), F.col("run_id"), F.col("results"))).alias("k", "v")).groupBy("run_id").agg(F.count("*").alias("n_keys"), F.max(F.when(F.col("k") == "results.n1.status", F.col("v"))).alias("n1_status"))),
    f"SELECT run_id, CAST(2 + 3 * count(*) AS BIGINT) AS n_keys, max(CASE WHEN node_id = 'n1' THEN status END) AS n1_status FROM ({LAST}) AS x GROUP BY run_id")
add("prj_5_where_truthy", over("v_signals", lambda s: x.where_truthy(s, "payload_outcome").select("event_id", "payload_outcome")), "SELECT event_id, payload_outcome FROM v_signals WHERE payload_outcome <> ''")
add("prj_6_compute", over("v_cases", lambda d: x.compute(d.select("run_id", F.col("status").alias("state"), "amount"), open_=F.col("state") != "completed", share=F.col("amount").cast("double") / 4096, next_id=F.col("run_id") + 1, name=F.concat("state", F.lit("-"), F.col("run_id").cast("string"))).select("run_id", "open_", "next_id", "name", "status", "share")),
    "SELECT run_id, CASE WHEN status <> 'completed' THEN 'true' ELSE 'false' END AS open_, CAST(run_id + 1 AS VARCHAR) AS next_id, concat(status, '-', run_id) AS name, 'success' AS status, regexp_replace(CAST(amount / 4096.0::DOUBLE AS VARCHAR), '\\.0$', '') AS share FROM v_cases")
add("prj_7_to_text", over("v_attempts", lambda a: a.select("run_id", "node_id", "iteration", c.to_text(F.col("input_tokens"), "bigint").alias("t"), c.to_text(F.col("status") == "failed", "boolean").alias("b"), c.to_text(F.when(F.col("iteration") > 1, F.col("status")), "string").alias("s"), c.to_text(F.col("input_tokens").cast("double"), "double").alias("d"), c.to_text(F.col("output_tokens") / F.lit(1024.0), "double").alias("f"), c.to_text((F.col("input_tokens") % 9 + 1) * F.lit(1e15), "double").alias("large"), c.to_text((F.col("input_tokens") % 9 + 1) / F.lit(1e12), "double").alias("small"))),
    "SELECT run_id, node_id, iteration, CAST(input_tokens AS VARCHAR) AS t, CASE WHEN status = 'failed' THEN 'true' ELSE 'false' END AS b, CASE WHEN iteration > 1 THEN status ELSE '' END AS s, CAST(input_tokens AS VARCHAR) AS d, regexp_replace(CAST(output_tokens / 1024.0::DOUBLE AS VARCHAR), '\\.0$', '') AS f, concat(input_tokens % 9 + 1, repeat('0', 15)) AS large, concat('0.00000000000', input_tokens % 9 + 1) AS small FROM v_attempts")
add("prj_8_infer_typed", table("events", lambda e: e.select("event_id", F.try_variant_get(x.infer_typed(F.col("props")), "$.k", "bigint").alias("k"), x.infer_typed(F.col("event_type")).isNull().alias("plain"))),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS plain FROM events")
add("prj_9_referenced_fields", over("v_flow_edges", lambda e: e.select("flow_id", "pos", F.array_join(x.referenced_fields(F.col("condition")), ",").alias("fields"))),
    "SELECT flow_id, pos, regexp_extract(condition, '^[a-z0-9_.]+') AS fields FROM v_flow_edges")
add("prj_10_readable", inputs(lambda d: d.select("run_id", F.array_join(F.array_sort(F.map_keys(x.readable(F.col("inputs")))), ",").alias("keys"), F.size(x.readable(F.col("inputs"), ["api_token", "market.question", "__depth"])).cast("long").alias("n_allowed"))),
    f"SELECT run_id, concat(CASE WHEN b = 1 THEN '  ,' ELSE '' END, 'market.outcomes_json', CASE WHEN p IS NULL THEN '' ELSE ',market.priority' END, ',market.question') AS keys, CAST(1 + t AS BIGINT) AS n_allowed FROM ({PICK}) AS x")


def _get(d):
    values, missing, denied = x.context_get(F.col("inputs"), [" market.priority ", "market.nothing", "", "api_token", "  ", "__depth"])
    own, _, barred = x.context_get(F.col("inputs"), ["api_token ", "market.question", "__depth"], ["api_token", "__depth"])
    return d.select("run_id", F.size(values).cast("long").alias("n_values"), F.array_join(missing, ",").alias("missing"), F.array_join(denied, ",").alias("denied"), F.size(own).cast("long").alias("n_allowed"), F.array_join(barred, ",").alias("barred"))


add("prj_11_context_get", inputs(_get), f"SELECT run_id, CAST(CASE WHEN p IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_values, concat(CASE WHEN p IS NULL THEN 'market.priority,' ELSE '' END, 'market.nothing') AS missing, 'api_token,__depth' AS denied, CAST(t AS BIGINT) AS n_allowed, 'market.question,__depth' AS barred FROM ({PICK}) AS x")
add("prj_12_approved", table("events", lambda e: e.select("event_id", x.approved(F.when(F.col("event_type") == "click", F.lit(" YES ")).when(F.col("event_type") == "view", F.lit("Passed")).otherwise(F.col("event_type"))).alias("ok"))),
    "SELECT event_id, event_type IN ('click', 'view') AS ok FROM events")
add("prj_13_display_name", over("v_flow_nodes", lambda n: n.select("flow_id", "node_id", x.display_name(F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" Step "), F.col("type"))).otherwise("  "), F.col("node_id")).alias("name"))),
    "SELECT flow_id, node_id, CASE WHEN pos % 2 = 0 THEN concat('Step ', type) ELSE node_id END AS name FROM v_flow_nodes")
add("prj_14_clean_inputs", inputs(lambda d: d.select("run_id", F.size(x.clean_inputs(F.col("inputs"))).cast("long").alias("n"))), f"SELECT run_id, CAST(2 + t + dp + CASE WHEN p IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n FROM ({PICK}) AS x")
add("prj_15_map_inputs", inputs(lambda d: d.withColumn("args", F.to_json(F.struct(F.col("run_id").alias("n")))).withColumn("m", x.map_inputs({"question": "inputs.market.question", "": "run.id", "n": "$args.n", "gone": "inputs.none"}, F.col("args"))).select("run_id", F.col("m")["question"].alias("question"), F.col("m")["n"].alias("n"), F.col("m")["gone"].alias("gone"), F.size("m").cast("long").alias("n_inputs"))),
    f"SELECT run_id, q AS question, CAST(run_id AS VARCHAR) AS n, '' AS gone, CAST(3 AS BIGINT) AS n_inputs FROM ({PICK}) AS x")
add("prj_16_valid_run_id", table("pages", lambda p: p.select("page_id", x.valid_run_id(F.col("url")).alias("url_ok"), x.valid_run_id(F.concat(F.lit("run_"), F.col("page_id").cast("string"))).alias("id_ok"))),
    "SELECT page_id, regexp_full_match(url, '[A-Za-z0-9_-]{1,128}') AS url_ok, true AS id_ok FROM pages")


def _ready(w):
    at, elapsed, remaining, error = x.ready_at(F.col("parked_unix"), F.col("wait_id") % 7 * 86400, F.lit(1706000000))
    return w.select("wait_id", at.alias("ready_at"), elapsed.alias("elapsed"), remaining.alias("remaining"), error.alias("error"))


add("prj_17_ready_at", over("v_waits", _ready), "SELECT wait_id, a AS ready_at, a <= 1706000000 AS elapsed, greatest(a - 1706000000, 0) AS remaining, '' AS error FROM (SELECT wait_id, parked_unix + wait_id % 7 * 86400 AS a FROM v_waits) AS x")


def _deferred(w):
    start = F.element_at(F.array(*map(F.lit, ["", "deadline", "resolution_pending_since", "now", "elsewhere"])), (F.col("wait_id") % 5 + 1).cast("int"))
    since = F.when(F.col("wait_id") % 3 == 0, F.lit(None)).otherwise(F.col("parked_unix")).cast("string")
    return x.defer_waits(w, start, F.col("wait_id") % 9 * 3600, F.col("resume_unix"), since, F.lit(1705000000)).select("wait_id", "start_from", "ready_at", "elapsed", "remaining", "error")


add("prj_17b_defer_waits", over("v_waits", _deferred), """SELECT wait_id, s AS start_from, CASE WHEN e = '' THEN z END AS ready_at, CASE WHEN e = '' THEN z <= 1705000000 END AS elapsed, CASE WHEN e = '' THEN greatest(z - 1705000000, 0) END AS remaining, e AS error
    FROM (SELECT wait_id, s, a + wait_id % 9 * 3600 AS z, CASE WHEN s = 'now' THEN 'a deferred wait needs an anchor that does not move' WHEN a IS NULL THEN 'anchor is missing or no integer' ELSE '' END AS e
      FROM (SELECT wait_id, CASE wait_id % 5 WHEN 2 THEN 'resolution_pending_since' WHEN 3 THEN 'now' WHEN 4 THEN 'elsewhere' ELSE 'deadline' END AS s,
          CASE wait_id % 5 WHEN 0 THEN resume_unix WHEN 1 THEN resume_unix WHEN 2 THEN CASE WHEN wait_id % 3 <> 0 THEN parked_unix END END AS a FROM v_waits) AS x) AS y""")


def _spec(w):
    w = w.withColumns({"timeout_seconds": F.col("wait_id") % 3 * 100, "reason": F.when(F.col("wait_id") % 2 == 0, " on hold ").otherwise(" "), "required_payload": F.array(F.lit(" outcome "), F.lit(""), F.col("signal_type"))})
    w = w.withColumn("timeout_outputs", F.when(F.col("wait_id") % 5 == 0, F.create_map(F.lit("status"), F.lit("late"))))
    return x.wait_spec(w).select("wait_id", "wait_key", "deadline_unix", "reason", F.array_join("required_payload", ",").alias("required"), F.col("timeout_outputs")["status"].alias("at_timeout"), "error")


add("prj_18_wait_spec", over("v_waits", _spec),
    """SELECT wait_id, CASE WHEN correlation_key = '' THEN concat(run_id, ':', node_id) ELSE correlation_key END AS wait_key, parked_unix + CASE WHEN wait_id % 3 > 0 THEN wait_id % 3 * 100 ELSE 172800 END AS deadline_unix,
       CASE WHEN wait_id % 2 = 0 THEN 'on hold' ELSE 'await signal' END AS reason, array_to_string(list_sort(list_filter(['outcome', signal_type], lambda k: k <> '')), ',') AS required, CASE WHEN wait_id % 5 = 0 THEN 'late' ELSE 'timeout' END AS at_timeout,
       CASE WHEN signal_type = '' THEN 'signal type is required' ELSE '' END AS error FROM v_waits""")


def _provider(p):
    model = F.concat(F.element_at(F.array(*map(F.lit, ["claude-", "gpt-", "gemini-", "other-", "o3-"])), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_brand"))
    provider, error = x.provider_of(model, F.when(F.col("p_partkey") % 7 == 0, "google").otherwise(""))
    return p.select("p_partkey", F.coalesce(provider, F.lit("")).alias("provider"), error.alias("error"))


add("prj_19_provider_of", table("part", _provider), """SELECT p_partkey, CASE WHEN g THEN 'google' ELSE f END AS provider, CASE WHEN f = '' THEN 'unknown model' WHEN g AND f <> 'google' THEN 'provider mismatch' ELSE '' END AS error
    FROM (SELECT p_partkey, p_partkey % 7 = 0 AS g, CASE p_partkey % 5 WHEN 0 THEN 'anthropic' WHEN 2 THEN 'google' WHEN 3 THEN '' ELSE 'openai' END AS f FROM part) AS x""")
ASK = "SELECT CAST(c_custkey * 7 AS BIGINT) AS run_id FROM customer"
CANCELLED = f"""SELECT coalesce(c.run_id, a.run_id) AS run_id, CASE WHEN c.run_id IS NULL THEN 'not_found' WHEN a.run_id IS NOT NULL AND status NOT IN ('completed', 'failed', 'cancelled') THEN 'cancelled' ELSE status END AS status,
        CASE WHEN c.run_id IS NOT NULL AND a.run_id IS NOT NULL AND status NOT IN ('completed', 'failed', 'cancelled') THEN 'run cancelled' ELSE '' END AS error,
        CASE WHEN a.run_id IS NULL OR status IN ('completed', 'failed', 'cancelled') THEN label END AS return_json FROM v_cases c FULL JOIN ({ASK}) a ON c.run_id = a.run_id"""
add("prj_20_cancel_cases", lambda s, d: x.cancel_cases(view(s, d, "v_cases").withColumnRenamed("label", "return_json"), query(s, d, ASK)), CANCELLED)
add("prj_20b_drop_waits", lambda s, d: x.drop_waits(view(s, d, "v_waits").select("wait_id", "run_id"), x.cancel_cases(view(s, d, "v_cases"), query(s, d, ASK))),
    f"SELECT wait_id, run_id FROM v_waits WHERE run_id NOT IN (SELECT run_id FROM ({CANCELLED}) AS gone WHERE error = 'run cancelled')")
add("prj_21_case_status", lambda s, d: x.case_status(view(s, d, "v_cases"), query(s, d, ASK)), f"SELECT a.run_id, coalesce(c.status, 'not_found') AS status FROM ({ASK}) a LEFT JOIN v_cases c ON c.run_id = a.run_id")

# Condition functions over texts and events. Texts are cut by functions, not by the queries.
DOC = lambda f: table("documents", lambda d: d.select("doc_id", f(d["text"]).alias("v")))
EVT = lambda f: table("events", lambda e: e.select("event_id", f(e).alias("v")))


def doc(name, f, sql):
    add(name, DOC(f), f"SELECT doc_id, {sql} AS v FROM documents")


def evt(name, f, sql):
    add(name, EVT(f), f"SELECT event_id, {sql} AS v FROM events")


WORDS = lambda t: c.split(t, " ")
doc("fn_1_size", lambda t: c.size(t), "CAST(length(text) AS BIGINT)")
doc("fn_2_contains", lambda t: c.contains(t, "the") & ~c.starts_with(t, "A") | c.ends_with(t, "."), "(contains(text, 'the') AND NOT starts_with(text, 'A')) OR ends_with(text, '.')")
doc("fn_3_matches", lambda t: c.matches(t, "[0-9]+@|e[rn]s "), "regexp_matches(text, '[0-9]+@|e[rn]s ')")
doc("fn_4_exists", lambda t: c.exists(WORDS(t), lambda w: F.char_length(w) > 14), "len(list_filter(string_split(text, ' '), lambda w: length(w) > 14)) > 0")
doc("fn_5_all", lambda t: c.every(WORDS(t), lambda w: F.char_length(w) < 16), "len(list_filter(string_split(text, ' '), lambda w: length(w) >= 16)) = 0")
doc("fn_6_filter", lambda t: F.size(c.keep(WORDS(t), lambda w: w.startswith("t"))).cast("long"), "CAST(len(list_filter(string_split(text, ' '), lambda w: starts_with(w, 't'))) AS BIGINT)")
doc("fn_7_map", lambda t: F.array_join(c.each(WORDS(t), lambda w: F.char_length(w).cast("string")), "-"), "array_to_string(list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS VARCHAR)), '-')")
evt("fn_8_has_in", lambda e: c.is_in(e["event_type"], F.array(F.lit("click"), F.lit("view"))) | c.has_key(F.from_json(e["props"], "map<string,string>"), "z"), "event_type IN ('click', 'view')")
evt("fn_9_field", lambda e: c.field(e["props"], "k"), "json_extract_string(props, '$.k')")
doc("fn_10_char_at", lambda t: c.char_at(t, 4), "substr(text, 5, 1)")
evt("fn_11_format", lambda e: c.format_text("%s:%d", e["event_type"], e["user_id"]), "format('{}:{}', event_type, user_id)")
doc("fn_12_index_of", lambda t: c.index_of(t, "on"), "CAST(strpos(text, 'on') - 1 AS BIGINT)")
doc("fn_13_last_index_of", lambda t: c.last_index_of(t, "on"), "CAST(CASE WHEN strpos(text, 'on') = 0 THEN -1 ELSE length(text) - strpos(reverse(text), 'no') - 1 END AS BIGINT)")
doc("fn_14_ascii_case", lambda t: F.concat(c.lower_ascii(t), c.upper_ascii(t)), "concat(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))")
doc("fn_15_replace", lambda t: c.replace(t, ".", "!"), "replace(text, '.', '!')")
doc("fn_16_split", lambda t: F.size(c.split(t, ". ")).cast("long"), "CAST(len(string_split(text, '. ')) AS BIGINT)")
doc("fn_17_substring", lambda t: F.concat(c.substring(t, 3, 9), F.lit("|"), c.substring(t, 20)), "concat(substr(text, 4, 6), '|', substr(text, 21))")
doc("fn_18_trim_reverse", lambda t: c.reverse(c.trim(F.concat(F.lit(" \t"), t, F.lit("\n ")))), "reverse(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")
doc("fn_19_join", lambda t: c.join(c.split(t, " "), "_"), "replace(text, ' ', '_')")
evt("fn_20_algebra", lambda e: F.when((e["value"] > 50) & ~(e["event_type"] == "error"), F.concat(e["event_type"], F.lit("+"))).otherwise(F.lit("-")), "CASE WHEN value > 50 AND NOT event_type = 'error' THEN concat(event_type, '+') ELSE '-' END")
evt("fn_21_conversions", lambda e: F.coalesce(c.to_int(c.field(e["props"], "k")), F.lit(-1)) + F.coalesce(c.to_int(e["event_type"]), F.lit(1)), "CAST(json_extract(props, '$.k') AS BIGINT) + 1")


def _converted(e):
    n = c.field(F.col("props"), "k")
    stamp = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("event_id") % 60, 2, "0"), F.lit("Z")))
    span = F.when(F.col("event_id") % 4 == 0, "soon").when(F.col("event_id") % 4 == 1, F.concat((F.col("event_id") % 5).cast("string"), F.lit("h1h.5s250ms"))).when(F.col("event_id") % 7 == 0, "-0").otherwise(F.concat((F.col("event_id") % 5).cast("string"), F.lit("h30m1.5s")))
    return e.select(
        "event_id", F.coalesce(c.to_uint(F.concat(F.when(F.col("event_id") % 2 == 0, "-").otherwise(""), n)).cast("string"), F.lit("none")).alias("uint"), F.octet_length(c.to_bytes(F.col("event_type"))).cast("long").alias("n_bytes"),
        F.unix_timestamp(c.to_timestamp(stamp)).alias("at"), c.to_duration(span).alias("seconds"), F.concat_ws(",", c.type_of(F.col("event_id")), c.type_of(F.col("value")), c.type_of(F.col("event_type")), c.type_of(F.col("value") > 1), c.type_of(F.array("value"))).alias("types"),
    )


add("fn_21b_conversions", table("events", _converted), """SELECT event_id, CASE WHEN event_id % 2 = 1 OR CAST(json_extract_string(props, '$.k') AS BIGINT) = 0 THEN json_extract_string(props, '$.k') ELSE 'none' END AS uint, strlen(event_type) AS n_bytes,
    CASE WHEN event_id % 3 <> 0 THEN 1704067200 + event_id % 60 END AS at, CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 5 * 3600 + 3600.75 AS DOUBLE) WHEN event_id % 4 <> 0 AND event_id % 7 = 0 THEN 0.0::DOUBLE WHEN event_id % 4 <> 0 THEN CAST(event_id % 5 * 3600 + 1801.5 AS DOUBLE) END AS seconds, 'int,double,string,bool,list' AS types FROM events""")
