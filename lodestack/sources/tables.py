"""Tables in hash buckets by key that batches are merged into: a batch rewrites the buckets that it touches and no others.

A table is a folder with one folder `epoch=<n>` per batch, and in it one `bucket=<b>` per bucket that the batch
wrote, whole. A bucket's newest epoch is its content. An epoch counts once Spark has marked it as complete;
what it replaces is deleted afterwards, so that a table has one folder a bucket however many batches it has seen, and a
batch that fails, or is run again, changes nothing that is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import folder

BUCKETS = 64
#: Bits that monotonically_increasing_id gives the rows of a partition.
ROW_BITS = 33


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in the order, from 0: range partitions are written in order, and one count per partition tells where each begins."""
    path = folder(df, "in-order")
    df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__at", ROW_BITS).cast("int"))
    # As many counts as there are partitions.
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy("__part").count().collect()):
        starts.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    return rows.join(F.broadcast(first), "__part").withColumn(name, place).drop("__part", "__at", "__start")


def _listed(spark: SparkSession, path: str):
    """(the file system, the folders below path by name); none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, {s.getPath().getName(): s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else [])}


def versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The newest complete epoch of every bucket, of epochs below a number: at most one entry per bucket."""
    found: dict[int, int] = {}
    for name in _listed(spark, path)[1]:
        epoch = int(name.removeprefix("epoch=")) if name.startswith("epoch=") else None
        if epoch is None or below is not None and epoch >= below:
            continue
        parts = _listed(spark, f"{path}/{name}")[1]
        if "_SUCCESS" in parts:
            for b in (int(p.removeprefix("bucket=")) for p in parts if p.startswith("bucket=")):
                found[b] = max(epoch, found.get(b, -1))
    return found


def folders(path: str, at: dict[int, int]) -> list[str]:
    return [f"{path}/epoch={e}/bucket={b}" for b, e in sorted(at.items())]


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows; an absent table has none."""
    at = folders(path, versions(spark, path))
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, epoch: int, path: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the table; returns the buckets that were rewritten.

    merge makes one row per key of rows of the table's columns. It should give the same whatever the order and
    however often a row comes, as replays bring rows again. Null keys share a bucket.
    """
    spark, out = batch.sparkSession, f"{path}/epoch={epoch}"
    # A batch that comes again after it was written whole is in the table; what it replaced may be gone by now.
    parts = _listed(spark, out)[1]
    if "_SUCCESS" in parts:
        touched = sorted(int(p.removeprefix("bucket=")) for p in parts if p.startswith("bucket="))
        _drop_older(spark, path, epoch, touched)
        return touched
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = merge(batch).persist()
    try:
        # At most `buckets` rows.
        touched = sorted(r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect())
        if not touched:
            return []
        old = {b: e for b, e in versions(spark, path, epoch).items() if b in set(touched)}
        every = merge(rows.unionByName(spark.read.schema(rows.schema).parquet(*folders(path, old)))) if old else rows
        every.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
    finally:
        rows.unpersist()
    _drop_older(spark, path, epoch, touched)
    return touched


def _drop_older(spark: SparkSession, path: str, epoch: int, touched: list[int]) -> None:
    """Delete what earlier epochs have of the buckets that this one has written."""
    fs, there = _listed(spark, path)
    for name in there:
        if name.startswith("epoch=") and int(name.removeprefix("epoch=")) < epoch:
            parts = _listed(spark, f"{path}/{name}")[1]
            for b in touched:
                if f"bucket={b}" in parts:
                    fs.delete(parts.pop(f"bucket={b}"), True)
            if not any(p.startswith("bucket=") for p in parts):
                fs.delete(there[name], True)


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """Merge all that a stream has into the table, batch by batch, and read it. No state is kept but the table."""
    spark = stream.sparkSession
    sink = lambda batch, epoch: merge_batch(batch, epoch, path, key, merge, buckets) and None
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_table(spark, path, stream.schema)
