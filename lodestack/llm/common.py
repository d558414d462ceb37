"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What separates words, as a Java/Python regex class and as byte values.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_BYTES = bytes([0x20, 9, 10, 11, 12, 13])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set to a local one only where it is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='spark-lodestack-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> "F.Column":
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list, name: str, group: str | None = None, label: str = "numbered") -> DataFrame:
    """df with the column name: the place of each row in the order (columns or names), within its group if one is given, from 0 and without gaps.

    Rows are written, range-partitioned by (group, order) and sorted within partitions; the rows of a group in each
    partition, at most partitions + groups counts, tell where the next partition begins. A row number of its own breaks ties,
    so that rows which are equal in all are dealt over several partitions too. df should be narrow. It must not have
    columns whose names begin with two underscores.
    """
    n = partitions(df.sparkSession)
    # Written first: ranges are sampled from the table, and the row numbers hold when executors are lost.
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), label)
    by = [*([F.col(group)] if group else []), *order, F.col("__row")]
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    rows = materialize(rows, label)
    kind = F.col(group) if group else F.lit(0)
    parts = rows.groupBy(F.col("__pid").alias("__part"), kind.alias("__kind")).agg(F.count("*").alias("__here"), F.min("__at").alias("__first"))
    # One row per partition, and one more per group: as many as the setting says, however large the table.
    whole = Window.partitionBy("__kind").orderBy("__part")
    parts = parts.withColumn("__before", F.sum("__here").over(whole) - F.col("__here")).drop("__here")
    out = rows.join(F.broadcast(parts), (F.col("__pid") == F.col("__part")) & kind.eqNullSafe(F.col("__kind")))
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return out.select(*df.columns, place.alias(name))
