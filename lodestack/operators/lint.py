"""Linting of step configs and whole definitions: one predicate per issue code, over config JSON as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import FLOW, folder
from . import graphs
from .extension import CATALOG, FIELDS, KINDS, catalog
from .matching import unknown_output_refs
from .outcomes import issue_summary, union_issues

MAX_TIMEOUT, MAX_INLINE = 604_800, 300
# codes' prefixes, methods, limits of a policy and built-in tools.
PREFIX = {"api_fetch": "API", "llm_call": "LLM"}
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
NUMBERS = KINDS["integer"]
LIMITS = ["max_nodes", "max_edges", "max_depth", "max_total_time_seconds", "max_total_tokens"]
BUILTINS = ["context.get", "context.list", "source.fetch", "json.extract", "blueprint.run"]


def raw(path: str) -> Column:
    return F.get_json_object("config", f"$.{path}")


def text(path: str) -> Column:
    return F.trim(F.coalesce(raw(path), F.lit("")))


def number(path: str) -> Column:
    return F.coalesce(raw(path).try_cast("bigint"), F.lit(0))


def negative(*paths: str) -> Column:
    out = F.lit(False)
    for p in paths:
        out = out | (number(p) < 0)
    return out


def blank_but_given(path: str) -> Column:
    return (F.coalesce(raw(path), F.lit("")) != "") & (text(path) == "")


def any_tool(test) -> Column:
    """Whether a tool of the config passes a test of its JSON text."""
    return F.coalesce(F.exists(F.from_json(raw("tools"), "array<string>"), test), F.lit(False))


def of(tool: Column, field: str) -> Column:
    return F.trim(F.coalesce(F.get_json_object(tool, f"$.{field}"), F.lit("")))


def kind(tool: Column) -> Column:
    given = F.lower(of(tool, "kind"))
    return F.when(given != "", given).when(of(tool, "inline") != "", "blueprint").otherwise("builtin")


def builtin(tool: Column) -> Column:
    return F.when(of(tool, "builtin") != "", of(tool, "builtin")).otherwise(of(tool, "name"))


def bad_parameters(tool: Column) -> Column:
    """Whether a tool has parameters that are no JSON object."""
    given = F.get_json_object(tool, "$.parameters")
    return given.isNotNull() & F.json_object_keys(given).isNull()


def rules() -> dict[str, list[tuple[str, Column]]]:
    """GRF-7: (code, predicate) of each step type."""
    sources = sum((F.when(text(p) != "", 1).otherwise(0) for p in ("blueprint_json", "blueprint_json_key", "inline")), F.lit(0))
    given = lambda p: F.array_contains(F.json_object_keys("config"), p)
    value_ok = F.coalesce(F.trim(raw("value.status")) != "", F.lit(False)) & F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("config"), "$.value.status", "variant")) == "STRING", F.lit(False))
    url, mode, output = text("url"), text("mode"), F.lower(text("output_mode"))
    policy = negative(*(f"dynamic_blueprint_policy.{k}" for k in LIMITS))
    return {
        "api_fetch": [("API_URL_REQUIRED", url == ""), ("API_URL_INVALID", (url != "") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$")), ("API_METHOD_INVALID", (text("method") != "") & ~F.upper(text("method")).isin(*METHODS)), ("API_TIMEOUT_INVALID", negative("timeout_seconds"))],
        "llm_call": [("LLM_PROMPT_REQUIRED", text("prompt") == ""), ("LLM_ALLOWED_OUTCOMES_KEY_INVALID", blank_but_given("allowed_outcomes_key"))],
        "await_signal": [("AWAIT_SIGNAL_TYPE_REQUIRED", text("signal_type") == ""), ("AWAIT_SIGNAL_TIMEOUT_INVALID", ~number("timeout_seconds").between(0, MAX_TIMEOUT)), ("AWAIT_SIGNAL_REQUIRED_PAYLOAD_INVALID", F.coalesce(F.exists(F.from_json(raw("required_payload"), "array<string>"), lambda k: F.trim(k) == ""), F.lit(False)))],
        "wait": [("WAIT_DURATION_INVALID", negative("duration_seconds")), ("WAIT_MODE_INVALID", ~mode.isin("", "sleep", "defer")), ("WAIT_START_FROM_INVALID", ~text("start_from").isin("", "now", "deadline", "resolution_pending_since")), ("WAIT_DEFER_START_NOW_UNSUPPORTED", (mode == "defer") & (text("start_from") == "now")), ("WAIT_MAX_INLINE_TOO_LARGE", number("max_inline_seconds") > MAX_INLINE)],
        "return": [("RETURN_CONFIG_INVALID", (given("value").cast("int") + (text("from_key") != "").cast("int") != 1) | (given("value") & ~value_ok))],
        "cel_eval": [("CEL_EVAL_EXPRESSIONS_REQUIRED", F.coalesce(F.size(F.json_object_keys(raw("expressions"))), F.lit(0)) < 1)],
        "map": [("MAP_ITEMS_KEY_REQUIRED", text("items_key") == ""), ("MAP_INLINE_REQUIRED", F.coalesce(F.json_array_length(raw("inline.nodes")), F.lit(0)) == 0), ("MAP_BATCH_SIZE_INVALID", negative("batch_size")), ("MAP_MAX_CONCURRENCY_INVALID", negative("max_concurrency")), ("MAP_MAX_ITEMS_INVALID", negative("max_items")), ("MAP_MAX_DEPTH_INVALID", negative("max_depth")), ("MAP_TIMEOUT_INVALID", negative("per_batch_timeout_seconds")), ("MAP_ON_ERROR_INVALID", ~text("on_error").isin("", "fail", "continue"))],
        "gadget": [("GADGET_BLUEPRINT_SOURCE_REQUIRED", sources == 0), ("GADGET_BLUEPRINT_SOURCE_CONFLICT", sources > 1), ("GADGET_TIMEOUT_INVALID", negative("timeout_seconds")), ("GADGET_MAX_DEPTH_INVALID", negative("max_depth")), ("GADGET_DYNAMIC_POLICY_INVALID", policy), ("GADGET_BLUEPRINT_JSON_INVALID", (text("blueprint_json") != "") & ~text("blueprint_json").contains("{{") & F.try_parse_json(text("blueprint_json")).isNull())],
        "validate_blueprint": [("VALIDATE_BLUEPRINT_KEY_REQUIRED", text("blueprint_json_key") == "")],
        "agent_loop": [
            ("AGENT_LOOP_PROMPT_REQUIRED", text("prompt") == ""), ("AGENT_LOOP_OUTPUT_MODE_INVALID", ~output.isin("", "text", "structured", "resolution")), ("AGENT_LOOP_OUTPUT_TOOL_REQUIRED", (output == "structured") & (text("output_tool.parameters") == "")), ("AGENT_LOOP_OUTPUT_TOOL_INVALID", (text("output_tool.parameters") != "") & F.json_object_keys(raw("output_tool.parameters")).isNull()), ("AGENT_LOOP_TIMEOUT_INVALID", negative("timeout_seconds", "tool_timeout_seconds")),
            ("AGENT_LOOP_LIMIT_INVALID", negative("max_steps", "max_tool_calls", "max_tool_result_bytes", "max_tokens")), ("AGENT_LOOP_ALLOWED_OUTCOMES_KEY_INVALID", blank_but_given("allowed_outcomes_key")), ("AGENT_LOOP_TOOL_NAME_REQUIRED", any_tool(lambda t: of(t, "name") == "")), ("AGENT_LOOP_TOOL_PARAMETERS_INVALID", any_tool(bad_parameters)), ("AGENT_LOOP_TOOL_TIMEOUT_INVALID", any_tool(lambda t: F.coalesce(of(t, "timeout_seconds").try_cast("bigint"), F.lit(0)) < 0)),
            ("AGENT_LOOP_TOOL_MAX_DEPTH_INVALID", any_tool(lambda t: F.coalesce(of(t, "max_depth").try_cast("bigint"), F.lit(0)) < 0)), ("AGENT_LOOP_BUILTIN_TOOL_INVALID", any_tool(lambda t: (kind(t) == "builtin") & ~builtin(t).isin(*BUILTINS))), ("AGENT_LOOP_DYNAMIC_BLUEPRINT_DISABLED", any_tool(lambda t: (kind(t) == "builtin") & (builtin(t) == BUILTINS[-1])) & (text("enable_dynamic_blueprints") != "true")),
            ("AGENT_LOOP_BLUEPRINT_TOOL_INLINE_REQUIRED", any_tool(lambda t: (kind(t) == "blueprint") & (F.coalesce(F.json_array_length(F.get_json_object(t, "$.inline.nodes")), F.lit(0)) == 0))), ("AGENT_LOOP_TOOL_KIND_INVALID", any_tool(lambda t: ~kind(t).isin("builtin", "blueprint"))), ("AGENT_LOOP_DYNAMIC_POLICY_INVALID", policy),
        ],
    }


def config_issues(nodes: DataFrame) -> DataFrame:
    """Coded issues of (flow_id, node_id, type, config): config that is no object, has unknown fields or text for a number is invalid and has no other issue."""
    keys = F.json_object_keys("config")
    found = F.array().cast("array<string>")
    for type_, own in rules().items():
        known = F.array(*map(F.lit, FIELDS[type_]))
        wrong_number = F.lit(False)
        for n in NUMBERS:
            if n in FIELDS[type_]:
                wrong_number = wrong_number | (raw(n).isNotNull() & raw(n).try_cast("bigint").isNull())
        invalid = keys.isNull() | (F.size(F.array_except(keys, known)) > 0) | wrong_number
        code = f"{PREFIX.get(type_, type_.upper())}_CONFIG_INVALID"
        found = F.when(F.col("type") == type_, F.when(F.coalesce(invalid, F.lit(True)), F.array(F.lit(code))).otherwise(F.array_compact(F.array(*(F.when(p, F.lit(c)) for c, p in own))))).otherwise(found)
    pos = F.col("pos") if "pos" in nodes.columns else F.lit(0)
    n = nodes.select("flow_id", "node_id", "type", F.coalesce("config", F.lit("{}")).alias("config"), pos.cast("long").alias("place"))
    # Codes hang on type and config alone, and reading a config by all rules costs far more than finding its like. A filter does not pass a
    # column that is not deterministic; below the distinct rows it would judge every node.
    judged = n.select("type", "config").distinct().select("type", "config", found.alias("codes"), F.monotonically_increasing_id().alias("_at"))
    n = n.join(judged.filter(F.col("_at") >= 0), ["type", "config"]).select("flow_id", F.posexplode("codes").alias("k", "code"), F.col("node_id").alias("target"), "place")
    message = F.concat(F.lit("Node "), "target", F.lit(" breaks "), "code")
    return n.select("flow_id", "code", "target", F.lit("error").alias("severity"), message.alias("message"), F.lit(graphs.NODE).alias("stage"), "place", "k")


def nested(nodes: DataFrame) -> DataFrame:
    """(flow_id, node_id, type, place, child, body, i): definitions within configs of map, gadget and agent steps, as flows of their own; flow_id is the parent's."""
    tools = F.transform(F.from_json(raw("tools"), "array<string>"), lambda t: F.when(kind(t) == "blueprint", F.get_json_object(t, "$.inline")))
    own = F.when(~text("blueprint_json").contains("{{"), raw("blueprint_json"))
    bodies = F.when(F.col("type") == "map", F.array(raw("inline"))).when(F.col("type") == "agent_loop", tools).when(F.col("type") == "gadget", F.array(raw("inline"), own))
    pos = F.col("pos") if "pos" in nodes.columns else F.lit(0)
    n = nodes.select("flow_id", "node_id", "type", pos.cast("long").alias("place"), F.posexplode(bodies).alias("i", "body")).filter(F.try_parse_json("body").isNotNull())
    n = n.filter(F.coalesce(F.json_array_length(F.get_json_object("body", "$.nodes")), F.lit(0)) > 0)
    child = F.concat_ws("/", F.col("flow_id").cast("string"), "node_id", F.col("i").cast("string"))
    return n.select("flow_id", "node_id", "type", "place", child.alias("child"), "body", "i")


def written(df: DataFrame, label: str) -> DataFrame:
    path = folder(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inline_issues(nodes: DataFrame) -> DataFrame:
    """Steps whose nested definition is broken, at any depth: bodies of map steps and agent tools by their structure and returns, bodies
    of gadgets by all rules, nested ones included. One round per level that is there, each a written table."""
    n = written(nested(nodes), "nested")
    f = n.withColumn("f", F.from_json("body", FLOW))
    inner = f.select(F.col("child").alias("flow_id"), "type", F.posexplode("f.nodes").alias("pos", "n"))
    inner = inner.select("flow_id", F.col("type").alias("of"), F.col("pos").cast("long").alias("pos"), F.col("n.id").alias("node_id"), "n.type", "n.config")
    links = f.select(F.col("child").alias("flow_id"), F.posexplode("f.edges").alias("pos", "e"))
    links = links.select("flow_id", F.col("pos").cast("long").alias("pos"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.max_traversals", F.lit(0)).alias("max_traversals"))
    broken = graphs.structure_issues(inner.select("flow_id", "pos", "node_id", "type"), links, sorted({*CATALOG, *FIELDS})).select("flow_id")
    full = inner.filter("of = 'gadget'").drop("of")
    broken = broken.union(config_issues(full).select("flow_id"))
    if not nested(full).isEmpty():
        broken = broken.union(inline_issues(full).select("flow_id"))
    broken = broken.distinct().withColumnRenamed("flow_id", "child")
    code = F.when(F.col("type") == "map", "MAP_INLINE_INVALID").when(F.col("type") == "agent_loop", "AGENT_LOOP_BLUEPRINT_TOOL_INLINE_INVALID")
    code = code.when(F.col("i") == 0, "GADGET_INLINE_INVALID").otherwise("GADGET_BLUEPRINT_INVALID")
    message = F.concat(F.lit("nested definition of "), "node_id", F.lit(" is invalid"))
    out = n.join(broken, "child").select("flow_id", code.alias("code"), F.col("node_id").alias("target"), F.lit("error").alias("severity"), message.alias("message"), F.lit(graphs.NODE).alias("stage"), "place")
    return out.distinct()


def lint(flows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-12: one row per flow of (flow_id, raw): valid, issue_count, first_code, first_target, issues_text, issues_json; blank and unparsable text are issues."""
    blank, broken = F.trim(F.coalesce("raw", F.lit(""))) == "", F.try_parse_json("raw").isNull()
    empty = F.coalesce(F.json_array_length(F.get_json_object("raw", "$.nodes")), F.lit(0)) == 0
    whole = F.when(blank, F.array(F.lit("BLUEPRINT_JSON_REQUIRED"))).when(broken, F.array(F.lit("BLUEPRINT_JSON_INVALID")))
    whole = whole.otherwise(F.array_compact(F.array(F.when(empty, "EMPTY_BLUEPRINT"), F.when(F.octet_length("raw") > graphs.MAX_BYTES, "BLUEPRINT_TOO_LARGE"))))
    own = flows.select("flow_id", F.posexplode(whole).alias("place", "code"))
    own = own.select("flow_id", "code", F.lit("").alias("target"), F.lit("error").alias("severity"), F.lit("the definition's text is not usable").alias("message"), F.lit(graphs.WHOLE).alias("stage"), F.col("place").cast("long").alias("place"))
    refs = unknown_output_refs(edges, nodes, catalog(flows.sparkSession))
    message = F.concat(F.lit("unknown output, nearest: "), "suggestion")
    refs = refs.select("flow_id", F.lit("EDGE_UNKNOWN_OUTPUT_KEY").alias("code"), F.concat_ws(".", "node_id", "key").alias("target"), F.lit("warning").alias("severity"), message.alias("message"), F.lit(graphs.REFERENCE).alias("stage"), F.col("pos").alias("place"))
    known = sorted({*CATALOG, *FIELDS})
    issues = union_issues(own, graphs.structure_issues(nodes, edges, known), config_issues(nodes), inline_issues(nodes), refs)
    j = flows.select("flow_id").join(issue_summary(issues), "flow_id", "left")
    text_ = lambda k, default: F.coalesce(k, F.lit(default)).alias(k)
    return j.select(
        "flow_id", F.coalesce("valid", F.lit(True)).alias("valid"), F.coalesce("issue_count", F.lit(0)).cast("long").alias("issue_count"),
        text_("first_code", ""), text_("first_target", ""), text_("issues_text", "Blueprint is valid."), text_("issues_json", "[]"),
    )
