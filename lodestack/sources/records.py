"""Sources and sinks: run records, event logs, flow corpora, revisions, evidence."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUTS = "struct<outputs: map<string,string>, runs: array<map<string,string>>>"
CASE = f"run_id bigint, app_id bigint, status string, error string, inputs map<string,string>, results map<string,{OUTPUTS}>, revision bigint"
EVENT = "id bigint, run_id bigint, type string, created_at string, payload string"
FLOW = "id string, name string, version bigint, nodes array<struct<id: string, type: string, label: string, config: string, on_error: string>>, edges array<struct<from: string, to: string, condition: string, max_traversals: bigint>>"
TERMINAL = ("completed", "failed", "cancelled")


def folder(df: DataFrame, label: str) -> str:
    """A fresh folder below the shared checkpoint directory, or a local one where that is unset."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-lodestack-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: run records, one JSON document per line or file; absent maps are empty; a corrupt record is an error."""
    d = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    return d.withColumns({"inputs": F.coalesce("inputs", F.create_map().cast("map<string,string>")), "results": F.coalesce("results", F.create_map().cast(f"map<string,{OUTPUTS}>"))})


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (events, corrupt lines) of JSON lines; blank lines are ignored."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    d = lines.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return d.filter("e.id IS NOT NULL").select("e.*"), d.filter("e IS NULL OR e.id IS NULL").select("value")


def read_flows(spark: SparkSession, path: str, per_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-3: (flows, nodes, edges) of a corpus with one definition per file, or per line; raw text and declared positions stay."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not per_line).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    d = raw.withColumn("f", F.from_json("raw", FLOW)).withColumn("flow_id", F.col("f.id"))
    flows = d.select("flow_id", "file", "raw", F.col("f.name").alias("name"), F.col("f.version").alias("version"))
    nodes = d.select("flow_id", F.posexplode("f.nodes").alias("pos", "n")).select("flow_id", F.col("pos").cast("long").alias("pos"), F.col("n.id").alias("node_id"), "n.type", "n.label", "n.config", "n.on_error")
    edges = d.select("flow_id", F.posexplode("f.edges").alias("pos", "e")).select("flow_id", F.col("pos").cast("long").alias("pos"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.condition", F.lit("")).alias("condition"), F.coalesce("e.max_traversals", F.lit(0)).alias("max_traversals"))
    return flows, nodes, edges


def explode_results(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-4: (results by field, history by place) of a results map."""
    e = cases.select("run_id", F.explode("results").alias("node_id", "r"))
    rows = e.select("run_id", "node_id", F.explode("r.outputs").alias("field", "value"))
    history = e.select("run_id", "node_id", F.posexplode("r.runs").alias("pos", "m")).select("run_id", "node_id", F.col("pos").cast("long").alias("pos"), F.explode("m").alias("field", "value"))
    return rows, history


def stream_event_log(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "json", files: int = 100) -> DataFrame:
    """SRC-5: the event log as a stream of its files."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def append_events(events: DataFrame, path: str, key: str = "id", shard: int = 1_000_000, batch: int | str | None = None) -> DataFrame:
    """SRC-6: append the events whose id is not there yet; returns those. A null id is an id like others, and is there once.

    The log is partitioned by batch and by ranges of `shard` ids, so that an append looks for known ids only in the
    ranges that its own ids span, not in the whole log. A batch that has a name (a number, or a text for a batch of a stream) replaces
    what was written under it before and does not look at itself; others get the next free number.
    """
    spark = events.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath().getName()[6:] for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().startswith("batch=")]
    batch = str(max((int(b) for b in there if b.isdecimal()), default=-1) + 1 if batch is None else batch)
    fresh = events.dropDuplicates([key]).withColumn("shard", F.floor(F.col(key) / shard))
    if others := [f"{path}/batch={b}" for b in there if b != batch]:
        span = fresh.agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).first()
        log = spark.read.schema(fresh.schema).option("basePath", path).parquet(*others).filter(F.col("shard").isNull() | F.col("shard").between(span["lo"], span["hi"]))
        known = log.select(F.col(key).alias("__known"))
        fresh = fresh.join(known, fresh[key].eqNullSafe(known["__known"]), "left_anti").select(*events.columns, "shard")
    out = f"{path}/batch={batch}"
    fresh.write.mode("overwrite").partitionBy("shard").parquet(out)
    return spark.read.schema(fresh.schema).parquet(out).drop("shard")


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", shard: int = 1_000_000) -> None:
    """SRC-6 as a stream: every batch of it is an append under the stream's and the batch's own name, so that one that is run again after a
    failure adds nothing, and replaces nothing that another stream or an append by hand has written. Streams are told apart by their checkpoints."""
    name = f"stream{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    sink = lambda events, batch: append_events(events, path, key, shard, f"{name}-{batch}") and None
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_revisions(current: DataFrame, incoming: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-7: (table, rejects). An incoming row (run_id, revision, status) may be taken if its revision is the stored one, or 0 for
    a new run, and the stored run has not ended otherwise. Of several of one run the first one by order (a column; else by status)
    is taken, its revision goes up, and all others are stale.

    Equal rows are counted before they meet the table, so that a run with very many of them is one row.
    """
    keys = ["run_id", "revision", "status", *([order] if order else [])]
    i = incoming.groupBy(*keys).agg(F.count("*").alias("n"))
    i = i.select("run_id", F.col("revision").alias("i_rev"), F.col("status").alias("i_status"), F.struct(F.col(order) if order else F.lit(0), F.col("status")).alias("turn"), "n")
    c = current.select("run_id", F.col("revision").alias("c_rev"), F.col("status").alias("c_status"))
    j = i.join(c, "run_id", "left")
    ended = F.col("c_status").isin(*TERMINAL) & (F.col("c_status") != F.col("i_status"))
    ok = F.coalesce((F.col("i_rev") == F.coalesce("c_rev", F.lit(0))) & ~F.coalesce(ended, F.lit(False)), F.lit(False))
    j = j.withColumn("ok", ok)
    won = j.filter("ok").groupBy("run_id").agg(F.min(F.struct("turn", "i_rev")).alias("won"))
    w = won.select("run_id", F.col("won.i_rev").alias("w_rev"), F.col("won.turn.status").alias("w_status"))
    table = c.join(w, "run_id", "full_outer")
    table = table.select("run_id", F.coalesce(F.col("w_rev") + 1, "c_rev").alias("revision"), F.coalesce("w_status", "c_status").alias("status"))
    r = j.join(won, "run_id", "left")
    taken = F.coalesce(F.col("ok") & (F.col("turn") == F.col("won.turn")), F.lit(False)).cast("int")
    r = r.withColumn("left", F.col("n") - taken).filter("left > 0")
    r = r.select("run_id", F.col("i_rev").alias("revision"), F.col("i_status").alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), "left")))
    return table, r.select("run_id", "revision", "status", F.lit("stale").alias("reason"))


def write_evidence(cases: DataFrame, path: str) -> None:
    """SRC-8: final runs as JSON documents by app. Range partitions spread an app of very many runs over several files."""
    cases.repartitionByRange("app_id", "run_id").write.partitionBy("app_id").mode("append").json(path)


def snapshots(revisions: DataFrame) -> DataFrame:
    """SRC-9: an envelope per revision of a table or a stream: app, path, initiator, revision and the run as JSON.

    A stream of envelopes is written by streaming.signals.drain, or any writeStream.
    """
    path = F.concat(F.lit("runs/"), F.col("run_id").cast("string"), F.lit(".json"))
    run = F.to_json(F.struct("run_id", "revision", "status"))
    return revisions.select("app_id", path.alias("path"), "initiator", "run_id", "revision", run.alias("run"))
