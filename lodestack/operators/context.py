"""Lookups, templates and projections over a case's inputs and results, held as map columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conditions as c

# What makes a key look secret.
SECRET = ["secret", "password", "token", "api_key", "apikey", "private_key"]


def inputs_map(long_form: DataFrame) -> DataFrame:
    """(run_id, inputs MAP) from (run_id, k, v); keys are unique per run."""
    return long_form.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("inputs"))


def lookup(path: str, run: str = "run_id", inputs: str = "inputs", results: str = "results") -> Column:
    """PRJ-1: run.<field>, inputs.<key>, results.<node>.<field>, results.<node>.history; anything else is ''."""
    space, _, rest = path.strip().partition(".")
    if space == "run" and rest in ("id", "blueprint_id", "started_at"):
        return c.text(F.col(run if rest == "id" else rest).cast("string"))
    if space == "inputs" and rest:
        return c.text(F.try_element_at(F.col(inputs), F.lit(rest)))
    if space == "results" and "." in rest:
        node, _, field = rest.partition(".")
        found = F.try_element_at(F.col(results), F.lit(node))
        return F.coalesce(F.to_json(found["runs"]), F.lit("[]")) if field == "history" else c.text(F.try_element_at(found["outputs"], F.lit(field)))
    return F.lit("")


def interpolate(template: str, of=lookup) -> Column:
    """PRJ-2: {{ path }} once over; unknown is '', an unclosed {{ stays, values are not read again."""
    parts, at = [], 0
    while (start := template.find("{{", at)) >= 0 and (end := template.find("}}", start)) >= 0:
        parts += [F.lit(template[at:start]), of(template[start + 2 : end].strip())]
        at = end + 2
    return F.concat(*parts, F.lit(template[at:]))


def interpolate_json(value, of=lookup) -> Column:
    """PRJ-3: JSON text of a literal whose string leaves are templates."""
    if isinstance(value, str):
        quoted = F.to_json(F.struct(interpolate(value, of).alias("v")))
        return F.substring(quoted, 6, 2**30).substr(F.lit(1), F.char_length(quoted) - 6)
    if isinstance(value, dict):
        items = [F.concat(F.lit(json.dumps(k) + ": "), interpolate_json(v, of)) for k, v in value.items()]
        return F.concat(F.lit("{"), F.array_join(F.array(*items), ", "), F.lit("}")) if items else F.lit("{}")
    if isinstance(value, list):
        return F.concat(F.lit("["), F.array_join(F.array(*(interpolate_json(v, of) for v in value)), ", "), F.lit("]")) if value else F.lit("[]")
    return F.lit(json.dumps(value))


def flatten_context(inputs: Column, run: Column, results: Column | None = None) -> Column:
    """PRJ-4: one flat map of inputs.*, run.id and, from results, results.<node>.<field> and .history."""
    maps = [F.transform_keys(inputs, lambda k, _: F.concat(F.lit("inputs."), k)), F.create_map(F.lit("run.id"), run.cast("string"))]
    if results is not None:
        entry = lambda e: F.concat(F.transform(F.map_entries(e["value"]["outputs"]), lambda f: F.struct(F.concat(F.lit("results."), e["key"], F.lit("."), f["key"]).alias("key"), f["value"].alias("value"))), F.array(F.struct(F.concat(F.lit("results."), e["key"], F.lit(".history")).alias("key"), F.to_json(e["value"]["runs"]).alias("value"))))
        maps.append(F.map_from_entries(F.flatten(F.transform(F.map_entries(results), entry))))
    return F.map_concat(*maps)


def where_truthy(df: DataFrame, name: str) -> DataFrame:
    """PRJ-5: the rows whose column is truthy by its type."""
    return df.where(c.truthy(F.col(name), df.schema[name].dataType.simpleString()))


def compute(df: DataFrame, **expressions: Column) -> DataFrame:
    """PRJ-6: named expressions over the same input, as text, by name, and status; none sees another."""
    if not expressions:
        raise ValueError("no expressions")
    typed = df.select("*", *(e.alias(f"__{k}") for k, e in sorted(expressions.items())))
    return typed.select(*df.columns, *(c.to_text(F.col(f"__{k}"), typed.schema[f"__{k}"].dataType.simpleString()).alias(k) for k in sorted(expressions)), F.lit("success").alias("status"))


def infer_typed(text: Column) -> Column:
    """PRJ-8: the variant of text that starts as a list or object and parses, else null."""
    return F.when(F.substring(text, 1, 1).isin("[", "{"), F.try_parse_json(text))


# Words in conditions that are no fields, and the methods that may end a dotted one.
RESERVED = [
    "true", "false", "null", "in", "int", "uint", "double", "bool", "string", "bytes", "list", "map", "type", "has", "size",
    "contains", "startsWith", "endsWith", "matches", "exists", "all", "filter", "timestamp", "duration",
]
METHODS = [
    "contains", "startsWith", "endsWith", "matches", "exists", "all", "filter", "size", "has", "charAt", "format", "indexOf",
    "lastIndexOf", "lowerAscii", "replace", "split", "substring", "trim", "upperAscii", "reverse", "join",
]


def referenced_fields(condition: Column) -> Column:
    """PRJ-9: the distinct identifiers of a condition, in order: runs of letters, digits, _ and dots outside of quotes that are no
    reserved word and begin with neither a digit nor a dot; a method's name at the end is cut off."""
    bare = F.regexp_replace(condition, r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)", " ")
    names = F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9_.]+"), 0)
    names = F.filter(names, lambda n: ~n.isin(*RESERVED) & ~n.rlike(r"^[0-9.]"))
    cut = F.transform(names, lambda n: F.regexp_replace(n, rf"(?<=.)\.(?:{'|'.join(METHODS)})$", ""))
    return F.array_distinct(F.filter(cut, lambda n: n != ""))


def readable(inputs: Column, allow: list[str] | None = None) -> Column:
    """PRJ-10: without keys that start with __; with an allowlist those only, else none that look secret."""
    hidden = lambda k: k.startswith("__")
    if allow is not None:
        return F.map_filter(inputs, lambda k, _: ~hidden(k) & k.isin(*allow))
    return F.map_filter(inputs, lambda k, _: ~hidden(k) & ~F.lower(k).rlike("|".join(re.escape(s) for s in SECRET)))


def context_get(inputs: Column, keys: list[str], allow: list[str] | None = None) -> tuple[Column, Column, Column]:
    """PRJ-11: the values found, the keys that are missing or empty, the keys that may not be read. Keys are trimmed and blank ones
    skipped; those of an allowlist may be read if there is one, else those that do not look secret (PRJ-10)."""
    keys = list(dict.fromkeys(k.strip() for k in keys if k.strip()))
    secret = re.compile("|".join(re.escape(s) for s in SECRET))
    may = [k for k in keys if not k.startswith("__") and (k in allow if allow is not None else not secret.search(k.lower()))]
    value = lambda k: F.coalesce(F.try_element_at(inputs, k), F.lit(""))
    listed = lambda ks: F.array(*map(F.lit, ks)).cast("array<string>")
    return F.map_filter(inputs, lambda k, v: k.isin(*may) & (v != "")), F.filter(listed(may), lambda k: value(k) == ""), listed([k for k in keys if k not in may])


# What counts as approval.
APPROVALS = ["1", "true", "yes", "y", "on", "approved", "pass", "passed", "complete", "completed"]


def approved(col: Column) -> Column:
    """PRJ-12."""
    return F.coalesce(F.lower(c.trim(col)).isin(*APPROVALS), F.lit(False))


def display_name(label: Column, name: Column) -> Column:
    """PRJ-13."""
    return F.coalesce(F.nullif(c.trim(label), F.lit("")), name)


def clean_inputs(inputs: Column) -> Column:
    """PRJ-14: without blank keys."""
    return F.map_filter(inputs, lambda k, _: c.trim(k) != "")


def map_inputs(mapping: dict[str, str], arguments: Column | None = None) -> Column:
    """PRJ-15: child inputs from parent paths, or from $args.<k> of a JSON argument column; blank names are skipped."""
    pairs = [(k, F.coalesce(F.get_json_object(arguments, "$." + v.removeprefix("$args.")), F.lit("")) if v.startswith("$args.") and arguments is not None else lookup(v)) for k, v in mapping.items() if k.strip() and v.strip()]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))


def valid_run_id(col: Column) -> Column:
    """PRJ-16."""
    return F.coalesce(col.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def ready_at(anchor: Column, duration: Column, now: Column, mode: str = "defer") -> tuple[Column, Column, Column, Column]:
    """PRJ-17: (ready_at, elapsed, remaining, error); a negative duration is 0 when sleeping."""
    a, n, d = anchor.try_cast("bigint"), now.try_cast("bigint"), duration.try_cast("bigint")
    d = F.greatest(d, F.lit(0)) if mode == "sleep" else d
    at = a + d
    error = F.when(a.isNull(), "anchor is missing or no integer").when(n.isNull(), "now is missing or no integer").otherwise("")
    return at, at <= n, F.greatest(at - n, F.lit(0)).cast("long"), error


def defer_waits(waits: DataFrame, start_from: Column, duration: Column, deadline: Column, pending_since: Column, now: Column) -> DataFrame:
    """PRJ-17 with its anchor: deadline by default, or resolution_pending_since; now is refused, since it moves. Adds start_from,
    ready_at, elapsed, remaining and error; rows with an error have none of the others."""
    start = F.coalesce(F.nullif(F.trim(start_from), F.lit("")), F.lit("deadline"))
    anchor = F.when(start == "deadline", deadline.cast("string")).when(start == "resolution_pending_since", pending_since.cast("string"))
    at, elapsed, remaining, error = ready_at(anchor, duration, now)
    error = F.when(start == "now", "a deferred wait needs an anchor that does not move").otherwise(error)
    ok = error == ""
    return waits.select("*", start.alias("start_from"), F.when(ok, at).alias("ready_at"), F.when(ok, elapsed).alias("elapsed"), F.when(ok, remaining).alias("remaining"), error.alias("error"))


def wait_spec(waits: DataFrame, default_timeout: int = 172_800) -> DataFrame:
    """PRJ-18: key, deadline, reason, required keys, timeout outputs and error of a wait. Blank and 'auto' keys become <run>:<node>;
    reason, required_payload and timeout_outputs are read where waits has them, and have defaults."""
    key = F.when(F.trim("correlation_key").isin("", "auto"), F.concat_ws(":", F.col("run_id").cast("string"), "node_id")).otherwise(F.trim("correlation_key"))
    timeout = F.when(F.col("timeout_seconds") > 0, F.col("timeout_seconds")).otherwise(default_timeout)
    error = F.when(F.trim("signal_type") == "", "signal type is required").otherwise("")
    has = lambda name, kind: F.col(name) if name in waits.columns else F.lit(None).cast(kind)
    reason = F.coalesce(F.nullif(F.trim(has("reason", "string")), F.lit("")), F.lit("await signal"))
    given = has("timeout_outputs", "map<string,string>")
    outputs = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.create_map(F.lit("status"), F.lit("timeout")))
    required = F.coalesce(has("required_payload", "array<string>"), F.array().cast("array<string>"))
    required = F.array_sort(F.array_distinct(F.filter(F.transform(required, lambda k: F.trim(k)), lambda k: k != "")))
    own = [c for c in waits.columns if c not in ("reason", "timeout_outputs", "required_payload")]
    return waits.select(*own, key.alias("wait_key"), (F.col("parked_unix") + timeout).cast("long").alias("deadline_unix"), reason.alias("reason"), required.alias("required_payload"), outputs.alias("timeout_outputs"), error.alias("error"))


# Model name prefixes of providers.
PROVIDERS = {"claude-": "anthropic", "gpt-": "openai", "o1-": "openai", "o3-": "openai", "o4-": "openai", "gemini-": "google"}


def provider_of(model: Column, provider: Column, prefixes: dict[str, str] = PROVIDERS) -> tuple[Column, Column]:
    """PRJ-19: (provider, error) of a model name by prefix; a provider that is given must agree."""
    found = F.lit(None).cast("string")
    for k, v in prefixes.items():
        found = F.when(model.startswith(k), v).otherwise(found)
    given = F.nullif(F.trim(provider), F.lit(""))
    return F.coalesce(given, found), F.when(found.isNull(), "unknown model").when(given.isNotNull() & (given != found), "provider mismatch").otherwise("")


def cancel_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """PRJ-20: requested cases that have not ended become cancelled, and lose what they return (return_json, where cases has it); unknown ids come out as not_found."""
    j = cases.join(ids.select("run_id", F.lit(True).alias("asked")).distinct(), "run_id", "full_outer")
    ended = F.col("status").isin("completed", "failed", "cancelled")
    hit = F.coalesce("asked", F.lit(False)) & ~ended
    status = F.when(F.col("status").isNull(), "not_found").when(hit, "cancelled").otherwise(F.col("status"))
    kept = [F.when(~F.coalesce(hit, F.lit(False)), F.col("return_json")).alias("return_json")] if "return_json" in cases.columns else []
    return j.select("run_id", status.alias("status"), F.when(hit & F.col("status").isNotNull(), "run cancelled").otherwise("").alias("error"), *kept)


def drop_waits(waits: DataFrame, cancelled: DataFrame) -> DataFrame:
    """PRJ-20: the waits that stay parked when the runs that cancel_cases gives are cancelled."""
    return waits.join(cancelled.filter("error = 'run cancelled'").select("run_id"), "run_id", "left_anti").select(*waits.columns)


def case_status(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """PRJ-21: the status of requested runs."""
    return ids.distinct().join(cases.select("run_id", "status"), "run_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
