"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a record's key, and the record goes to the shard with the least one:
-ln(u) / weight with u in (0, 1) from the MD5 of key and shard, an exponential race that a shard wins with
probability weight / all weights. A shard's draws depend on nothing but the key and the shard itself, so a new
shard takes records only into itself, a removed one gives away its own alone, and a heavier one only gains.

Where a record goes is a column expression, without any exchange. Places within the shards are numbered over a
range partitioning of narrow rows, so that neither a large shard nor a repeated key comes to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: So many leading hexadecimal digits of an MD5 make a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def record_key(*cols: str) -> Column:
    """A record's key as text: its columns joined by ':', nulls as 'null'."""
    return F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a text key. Shards of weight 0 get nothing; ties go to the smaller shard.

    A null key is null. The work of a row grows with the number of shards.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    u = lambda i: (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    draws = [F.struct((-F.log(u(i)) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.when(key.isNotNull(), F.array_min(F.array(*draws))["shard"])


def assign(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size long, text_crc32 long, shard int, slot long, grown_shard int.

    size is the text's UTF-8 bytes plus 1, slot the place within the shard, from 0 and without gaps, in the order of doc_id;
    grown_shard is where the document goes once a shard of weight `grown` is added (None: null).

    Null ids are one key, null texts are empty, and texts are taken whole. Rows that share an id share its
    shard and have slots of their own, by checksum and size; rows that are equal in all have any of theirs. An
    empty table gives no rows; other columns are left out, whatever their names.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), record_key(id_col)
    after = shard_of(key, [*weights, grown]) if grown is not None else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(key, weights).alias("shard"), after.alias("grown_shard"))
    out = numbered(rows, ["doc_id", "text_crc32", "size"], "slot", group="shard", label="shards")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, keys: Sequence[str] = ("doc_id",), files: int | None = None) -> None:
    """Write docs below path, a folder `shard=<n>` per shard; its files are range-sorted by key.

    The exchange is by shard and key together, so that a shard is written by several tasks. A column named
    shard is replaced by the shard.
    """
    out = docs.withColumn("shard", shard_of(record_key(*keys), weights))
    order = ["shard", *keys]
    out = out.repartitionByRange(files, *order) if files else out.repartitionByRange(*order)
    out.sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(from_shard, to_shard, records): how many records each change of weights or shards moves; those that stay are left out."""
    key = record_key(*keys)
    both = docs.select(shard_of(key, before).alias("from_shard"), shard_of(key, after).alias("to_shard"))
    return both.filter("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("records"))
