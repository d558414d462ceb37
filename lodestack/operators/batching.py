"""Batches over arrays: explode, group, apply with partial failures, roll up."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def explode_items(df: DataFrame, col: str, max_items: int = 100) -> DataFrame:
    """BAT-1: one row per item of a JSON array with its position; blank gives no rows; no array, or too many items, is one row with an error."""
    items = F.from_json(F.col(col), "array<string>")
    d = df.withColumn("__items", items)
    blank = F.trim(F.coalesce(F.col(col), F.lit(""))) == ""
    error = F.when(F.col("__items").isNull(), "not an array").when(F.size("__items") > max_items, "too many items").otherwise("")
    d = d.filter(~blank).withColumn("error", error)
    shown = F.when(F.col("error") == "", F.col("__items")).otherwise(F.array(F.lit(None).cast("string")))
    return d.select(*df.columns, "error", F.posexplode(shown).alias("pos", "item"))


def batch(df: DataFrame, key: list[str], order: list[str], size: int = 1) -> DataFrame:
    """BAT-2: batches of `size` rows of a key: index, first and last place (both within), number of rows."""
    d = df.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).withColumn("batch_index", F.floor(F.col("__i") / size).cast("long"))
    return d.groupBy(*key, "batch_index").agg(F.min("__i").cast("long").alias("batch_start_index"), F.max("__i").cast("long").alias("batch_end_index"), F.count("*").alias("batch_item_count"))


def apply_batches(df: DataFrame, keys: list[str], fn, returns: str = "result string", on_error: str = "continue", concurrency: int = 1, lists: bool = False) -> DataFrame:
    """BAT-3: fn(pandas frame) -> value, or (value, input tokens, output tokens), for every batch, a group of keys.

    A batch ends completed, or failed with the error's text and no value; its tokens are counted by what fn
    gives, or by the error's `usage`. The batches of one keys[:-1] run one after the other in the order of the last key;
    with on_error="fail" fn is not called any more after the first failure, and what is left is skipped. With
    "continue", concurrency is how many of them may run at once, 0 for any number. Different keys run side by
    side. A task holds one batch at a time. With lists fn gets a dict of columns, each a list of Python values: for
    very many small batches, where making a frame of each costs far more than what fn does.
    """
    if on_error not in ("continue", "fail"):
        raise ValueError(f"on_error must be continue or fail, not {on_error}")
    name, owner = returns.split()[0], keys[:-1]
    names = [*keys, name, "status", "error", "input_tokens", "output_tokens"]

    def one(key, batch):
        try:
            out = fn(batch)
            value, used = (out[0], out[1:]) if isinstance(out, tuple) else (out, (0, 0))
            return (*key, value, "completed", "", *used)
        except Exception as e:  # a user's error is a result of its batch
            return (*key, None, "failed", str(e), *getattr(e, "usage", (0, 0)))

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, {returns}, status string, error string, input_tokens long, output_tokens long"
    free = on_error == "continue" and (not concurrency or not owner)
    if free and not lists:
        return df.groupBy(*keys).applyInPandas(lambda key, pdf: pd.DataFrame([one(key, pdf)], columns=names), schema)
    # Rows of a batch follow each other within a partition; nulls of a key are equal, and so are NaNs.
    nan = float("nan")

    def columns_of(frame):
        """A frame's rows by column, and its keys."""
        if lists:
            data = {c: v.to_pylist() for c, v in zip(frame.schema.names, frame.columns, strict=True)}
            found = [[nan if x != x else x for x in data[k]] if pa.types.is_floating(frame.schema.field(k).type) else data[k] for k in keys]
        else:
            data, found = frame, [[None if pd.isna(x) else x for x in frame[k]] for k in keys]
        return data, list(zip(*found, strict=True))

    def cut(data, a, b):
        return {c: v[a:b] for c, v in data.items()} if lists else data.iloc[a:b]

    def whole(parts):
        if len(parts) == 1:
            return parts[0]
        return {c: [x for part in parts for x in part[c]] for c in parts[0]} if lists else pd.concat(parts, ignore_index=True)

    def batches(frame, held):
        """(key, rows) of the batches that end within frame; held is the one that was open before, and at the end the one that is open still."""
        data, found = columns_of(frame)
        edges = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[0] != found[a]:
                yield held[0], whole(held[1])
                held.clear()
            if held:
                held[1].append(cut(data, a, b))
            else:
                held[:] = [found[a], [cut(data, a, b)]]

    def run(frames):
        failed, held = None, []

        def judged(found):
            nonlocal failed
            rows = []
            for key, batch in found:
                off = on_error == "fail" and key[:-1] == failed
                rows.append((*key, None, "skipped", "", 0, 0) if off else one(key, batch))
                if rows[-1][len(keys) + 1] == "failed":
                    failed = key[:-1]
            if not lists:
                return pd.DataFrame(rows, columns=names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(names), arrow, strict=True)], schema=arrow)

        for frame in frames:
            if frame.num_rows if lists else len(frame):
                yield judged(batches(frame, held))
        if held:
            yield judged([(held[0], whole(held[1]))])

    if free:
        dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    else:
        lane = F.lit(0) if on_error == "fail" else F.pmod(F.xxhash64(keys[-1]), F.lit(concurrency))
        dealt = df.withColumn("__lane", lane).repartition(*owner, "__lane") if owner else df.withColumn("__lane", lane).repartition(1)
        dealt = dealt.sortWithinPartitions(*owner, "__lane", keys[-1]).drop("__lane")
    if not lists:
        return dealt.mapInPandas(run, schema)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return dealt.mapInArrow(run, schema)


def skip_after_failure(batches: DataFrame, key: str, index: str) -> DataFrame:
    """BAT-4: what comes after a key's first failure is skipped. The first failure is a minimum, so that rows in some order of the key are not sorted again."""
    at = F.struct(index)  # a null index comes first
    first = F.min(F.when(F.col("status") == "failed", at)).over(Window.partitionBy(key))
    return batches.withColumn("status", F.when(F.coalesce(at > first, F.lit(False)), "skipped").otherwise(F.col("status")))


def batch_rollup(batches: DataFrame, key: str, index: str, usage: str) -> DataFrame:
    """BAT-5: counts by status, the first error, summed usage; success, partial or failed."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = batches.groupBy(key).agg(F.count("*").alias("total"), is_("completed").alias("completed"), is_("failed").alias("failed"), is_("skipped").alias("skipped"), F.min_by("error", F.when(F.col("status") == "failed", F.col(index))).alias("first_error"), F.sum(usage).alias("usage"))
    status = F.when(F.col("completed") == F.col("total"), "success").when(F.col("completed") > 0, "partial").otherwise("failed")
    return g.withColumn("first_error", F.coalesce("first_error", F.lit(""))).withColumn("status", status)


def nested_explode(df: DataFrame, cols: list[str], max_depth: int = 4, max_items: int = 100) -> DataFrame:
    """BAT-6: arrays within items, level by level: cols names the JSON field of each level below the first. A row that fails at some level stays as one row with its error."""
    if len(cols) > max_depth:
        raise ValueError(f"more than {max_depth} levels")
    out = explode_items(df, cols[0], max_items)
    for c in cols[1:]:
        failed = out.filter("error <> ''")
        deeper = out.filter("error = ''").withColumn("__below", F.get_json_object("item", f"$.{c}")).drop("pos", "item", "error")
        out = failed.unionByName(explode_items(deeper, "__below", max_items).drop("__below"))
    return out
