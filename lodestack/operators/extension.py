"""The extension surface: named user operators, the catalog of step types, bounded refinement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from ..sources.records import folder


@dataclass
class Operators:
    """UDF-1: named operators DataFrame -> DataFrame, with the columns and types that they take and give, and table functions for SQL."""

    known: dict[str, tuple[Callable[[DataFrame], DataFrame], StructType, StructType]] = field(default_factory=dict)

    def register(self, spark: SparkSession, name: str, fn: Callable[[DataFrame], DataFrame], takes: str, gives: str) -> None:
        """The operator is built over an empty table of what it takes, which runs nothing: a column that it does not give, or gives as another type, is an error here."""
        takes, gives = (StructType.fromDDL(x) for x in (takes, gives))
        fits(name, fn(spark.createDataFrame([], takes)).schema, gives)
        self.known[name] = (fn, takes, gives)

    def apply(self, df: DataFrame, *names: str) -> DataFrame:
        """All names are checked before anything is built, and each operator's columns before anything runs."""
        if missing := [n for n in names if n not in self.known]:
            raise KeyError(f"unknown operators: {', '.join(missing)}")
        for n in names:
            fn, takes, gives = self.known[n]
            fits(n, df.schema, takes, "takes")
            df = fn(df)
            fits(n, df.schema, gives)
        return df


def fits(name: str, found: StructType, wanted: StructType, verb: str = "gives") -> None:
    """An error unless all wanted columns are found with their types."""
    types = {f.name: f.dataType for f in found}
    if wrong := [f"{f.name} {f.dataType.simpleString()} (not {types[f.name].simpleString() if f.name in types else 'there'})" for f in wanted if types.get(f.name) != f.dataType]:
        raise TypeError(f"{name} {verb} {', '.join(wrong)}")


def register_table_function(spark: SparkSession, name: str, rows: Callable, gives: str) -> None:
    """UDF-1 in SQL: SELECT * FROM name(TABLE(...)), for a function of one row that gives any number of tuples. PARTITION BY in the call spreads the rows."""

    class Rows:
        def eval(self, row):
            yield from rows(row)

    spark.udtf.register(name, udtf(Rows, returnType=gives))


# Step types and the output keys that they declare, in order.
CATALOG = {
    "api_fetch": ["status", "outcome", "raw", "json_path_value", "error", "http_status"],
    "llm_call": ["status", "outcome", "reasoning", "confidence", "raw", "citations_json", "error"],
    "agent_loop": [
        "status", "error", "outcome", "summary", "text", "output_json", "raw", "resolution_status", "confidence", "reasoning", "citations_json", "citations_count",
        "tool_calls_count", "tool_calls_json", "steps_json", "transcript_tail",
    ],
    "return": ["status"],
    "await_signal": ["status"],
    "wait": ["status", "waited", "mode", "start_from", "anchor_ts", "ready_at", "remaining_seconds"],
    "cel_eval": [],
    "map": ["status", "results", "total_items", "total_batches", "completed_batches", "failed_batches", "skipped_batches", "first_error"],
    "gadget": ["status", "error", "run_status", "child_run_id", "return_json"],
    "validate_blueprint": ["status", "valid", "issue_count", "issues_json", "issues_text", "blueprint_json", "first_issue_code", "first_issue_message", "first_issue_target"],
}
# Output keys that steps give without declaring them.
UNDECLARED = {
    "api_fetch": ["status_code", "content_type", "extracted"],
    "llm_call": ["citations_count"],
    "agent_loop": ["output"],
    "gadget": ["first_issue_code", "first_issue_message", "first_issue_target"],
}
# The fields of each step type's config, in declared order.
FIELDS = {
    "api_fetch": ["url", "method", "headers", "body", "basic_auth", "json_path", "outcome_mapping", "timeout_seconds"],
    "llm_call": ["provider", "model", "prompt", "timeout_seconds", "web_search", "allowed_outcomes_key"],
    "agent_loop": [
        "provider", "model", "system_prompt", "prompt", "auto_continue", "require_explicit_yield", "max_continues", "timeout_seconds", "tool_timeout_seconds", "max_steps",
        "max_tool_calls", "max_tool_result_bytes", "tool_result_history", "max_history_messages", "max_tokens", "reasoning", "output_mode", "output_tool", "tools",
        "context_allowlist", "allowed_outcomes_key", "can_complete_key", "completion", "enable_dynamic_blueprints", "dynamic_blueprint_policy", "async",
    ],
    "return": ["value", "from_key"],
    "await_signal": ["reason", "signal_type", "correlation_key", "timeout_seconds", "required_payload", "default_outputs", "timeout_outputs"],
    "wait": ["duration_seconds", "mode", "start_from", "max_inline_seconds"],
    "cel_eval": ["expressions"],
    "map": [
        "items_key", "inline", "batch_size", "batch_input_key", "batch_index_input_key", "batch_start_index_input_key", "batch_end_index_input_key", "batch_item_count_input_key",
        "max_concurrency", "on_error", "max_items", "max_depth", "per_batch_timeout_seconds", "input_mappings",
    ],
    "gadget": ["blueprint_json", "blueprint_json_key", "inline", "input_mappings", "timeout_seconds", "max_depth", "dynamic_blueprint_policy"],
    "validate_blueprint": ["blueprint_json_key"],
}
# Config fields that are no text.
KINDS = {
    "integer": [
        "timeout_seconds", "duration_seconds", "max_inline_seconds", "batch_size", "max_concurrency", "max_items", "max_depth", "per_batch_timeout_seconds", "max_continues",
        "tool_timeout_seconds", "max_steps", "max_tool_calls", "max_tool_result_bytes", "tool_result_history", "max_history_messages", "max_tokens",
    ],
    "boolean": ["web_search", "auto_continue", "require_explicit_yield", "enable_dynamic_blueprints", "async"],
    "array": ["required_payload", "tools", "context_allowlist"],
    "object": ["headers", "basic_auth", "outcome_mapping", "default_outputs", "timeout_outputs", "value", "expressions", "inline", "input_mappings", "output_tool", "completion", "dynamic_blueprint_policy"],
}


def catalog(spark: SparkSession, undeclared: bool = False) -> DataFrame:
    """UDF-2: (type, rank, key) of the output keys that step types declare, or also of those that they give besides; a fixed, small table. Types whose keys their config names have none."""
    rows = [(t, i, k) for t, keys in CATALOG.items() for i, k in enumerate([*keys, *(UNDECLARED.get(t, []) if undeclared else [])])]
    return spark.createDataFrame(rows, "type string, rank int, key string")


def config_schema(spark: SparkSession) -> DataFrame:
    """UDF-2: (type, rank, field, kind) of the config fields of all step types."""
    kind = {f: k for k, fields in KINDS.items() for f in fields}
    rows = [(t, i, f, kind.get(f, "text")) for t, fields in FIELDS.items() for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "type string, rank int, field string, kind string")


def refine(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column, value: str, max_passes: int) -> DataFrame:
    """UDF-3: rows that are not done go through step again, at most max_passes times; history has their earlier values.

    A pass is written to the shared checkpoint folder, so that plans stay short and a lost executor costs a
    read. What is still not done at the end is exhausted.
    """
    spark = df.sparkSession
    base = folder(df, "refine")
    kind = df.schema[value].dataType.simpleString()
    state = df.withColumns({"history": F.array().cast(f"array<{kind}>"), "passes": F.lit(0)})
    open_, closed = state.filter(~F.coalesce(done, F.lit(False))), state.filter(F.coalesce(done, F.lit(False)))
    for n in range(max_passes):
        before = open_.withColumn("history", F.concat("history", F.array(value))).withColumn("passes", F.col("passes") + 1)
        path = f"{base}/{n}"
        step(before).write.parquet(path)
        after = spark.read.parquet(path)
        closed = closed.unionByName(after.filter(F.coalesce(done, F.lit(False))))
        open_ = after.filter(~F.coalesce(done, F.lit(False)))
        if open_.isEmpty():
            break
    return closed.withColumn("exhausted", F.lit(False)).unionByName(open_.withColumn("exhausted", F.lit(True)))
