"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: knots (t, weight) over training time 0..1, linear in between. Its
integral is the source's weight; the integral's inverse turns cumulative words taken from the source into
training time. Words are prefix sums over a range-partitioned order, so a hot source is spread over all
tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, word_count


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, order): one row per document, with its words and its place in its source's order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return base.withColumn("order", F.xxhash64(F.lit(5), "doc_id", "size"))


def targets(totals: DataFrame, weights: DataFrame, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size) and (source, weight).

    Of ratio * all words each source gets a share by weight, at most cap times its own size; the excess is
    shared again by weight until no target is above. Each round sums up the sources that are full, two
    numbers, and shares what is left among the others; a source that is full stays so, and rounds end when
    none is added. So there may be as many sources as hosts.
    """
    t = totals.join(weights, totals["source"].eqNullSafe(weights["source"])).select(totals["source"], "source_size", "weight")
    t = materialize(t.withColumn("cap", F.lit(float(cap)) * F.col("source_size")), "mix-sources")
    demand, every = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(ratio), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, full = demand / every if every else 0.0, 0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, taken = t.filter(over).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == full or taken >= every:
            return t.select("source", "source_size", "weight", F.when(over, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))
        level, full = (demand - caps) / (every - taken), n


def integrate(schedule: DataFrame) -> DataFrame:
    """(source, weight, segments) from knots (source, t, weight): the integral, and the pieces to invert it."""
    knots = F.array_sort(F.collect_list(F.struct("t", F.col("weight").alias("w"))))
    s = schedule.groupBy("source").agg(knots.alias("k"))
    piece = lambda x, i: F.struct(x["t"].alias("t0"), x["w"].alias("w0"), (F.get("k", i + 1)["t"] - x["t"]).alias("dt"), (F.get("k", i + 1)["w"] - x["w"]).alias("dw"))
    s = s.withColumn("p", F.transform(F.slice("k", 1, F.size("k") - 1), piece))
    s = s.withColumn("area", F.transform("p", lambda x: x["dt"] * (x["w0"] + x["dw"] / 2)))
    with_sums = F.transform("p", lambda x, i: F.struct(x["t0"], x["w0"], x["dt"], x["dw"], F.get("area", i).alias("area"), F.aggregate(F.slice("area", 1, i), F.lit(0.0), lambda a, b: a + b).alias("below")))
    return s.select("source", F.aggregate("area", F.lit(0.0), lambda a, b: a + b).alias("weight"), with_sums.alias("segments"))


def time_of(share) -> "F.Column":
    """The training time at which the share (0..1) of a source's words has been taken; needs columns weight and segments."""
    want = share * F.col("weight")
    seg = F.coalesce(F.get(F.filter("segments", lambda s: (s["below"] + s["area"] >= want) & (s["area"] > 0)), F.lit(0)), F.element_at("segments", -1))
    need, a, b = F.greatest(want - seg["below"], F.lit(0.0)), seg["w0"], seg["dw"]
    # w0 x + dw x^2 / 2 = need / dt, in the form that also holds for dw = 0
    x = F.try_divide(2 * need / seg["dt"], a + F.sqrt(F.greatest(a * a + 2 * b * need / seg["dt"], F.lit(0.0))))
    return seg["t0"] + F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0)) * seg["dt"]


def running(part: DataFrame) -> DataFrame:
    """part, which is sorted within its partitions, with `upto`: the words of a row's source up to it, within its partition."""

    def run(batches):
        seen, last, carry = False, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            source, size = b.column("source").to_pylist(), b.column("size").to_numpy()
            total = np.cumsum(size)
            starts = [0, *(i for i in range(1, len(source)) if source[i] != source[i - 1])]
            base = np.array([total[i - 1] if i else 0 for i in starts], np.int64)
            if seen and source[0] == last:
                base[0] -= carry
            upto = total - np.repeat(base, np.diff([*starts, len(source)]))
            seen, last, carry = True, source[-1], int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], names=[*b.schema.names, "upto"])

    return part.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema) + ", upto long")


def same(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mix(docs: DataFrame, schedule: DataFrame, ratio: float = 1.5, cap: float = 2.0, **cols: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, times array<double>.

    docs are documents; schedule has knots (source, t, weight) for each source of docs. A source's demand runs
    through its documents, in an order by hash, pass after pass. Documents are taken whole: a copy whose last
    word lies within the target is taken, and then the one that comes nearest to what is left. times has the
    position (0..1 of the training) of each copy by the inverse of the source's schedule; rows are range-sorted
    by the first one.

    Empty and null texts have size 0 and are not needed for any target; null is a source like others;
    repeated rows count as rows of their own; an empty table gives no rows; other columns are left out.
    """
    n = partitions(docs.sparkSession)
    order = ["source", "order", "doc_id", "size"]
    # Range partitions take a sample first: of the sizes, so that texts are read once.
    base = materialize(sizes(docs, **cols), "mix-sizes").repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = materialize(running(base.withColumn("pid", F.spark_partition_id())), "mix-order")

    # A row per source and partition; within the order these are at most partitions + sources.
    parts = rows.groupBy("source", "pid").agg(F.sum("size").alias("here"))
    before = F.sum("here").over(Window.partitionBy("source").orderBy("pid")) - F.col("here")
    parts = parts.select("source", "pid", before.alias("offset"))
    shape = integrate(schedule)
    want = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), shape.select("source", "weight"), ratio, cap)
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    want = want.withColumn("full", full)
    plan = parts.alias("p").join(want.alias("w"), same("p", "w")).join(shape.alias("k"), same("p", "k")).select("w.*", "pid", "offset", "segments")
    plan = materialize(plan, "mix-plan")

    on = (F.col("r.pid") == F.col("s.pid")) & same("r", "s")
    placed = rows.alias("r").join(plan.alias("s"), on).select("r.doc_id", "r.source", "size", "source_size", "target", "weight", "segments", "full", (F.col("offset") + F.col("upto")).alias("upto"))
    # The demand of a source runs through its documents again and again; a copy that is over before the target is taken.
    passes = F.sequence(F.lit(0).cast("long"), F.col("full"))
    ends = F.filter(F.transform(passes, lambda e: e * F.col("source_size") + F.col("upto")), lambda x: (x <= F.col("target")) & (F.col("size") > 0))
    placed = placed.withColumn("ends", ends)
    left = placed.groupBy("source").agg((F.first("target") - F.coalesce(F.sum(F.col("size") * F.size("ends")), F.lit(0))).alias("left"))
    left = materialize(left, "mix-left")
    # What no copy of the order fits is filled by the one that comes nearest, if that is nearer than nothing.
    off = F.abs(F.col("left") - F.col("size"))
    best = placed.filter(F.size("ends") <= F.col("full")).alias("d").join(left.alias("l"), same("d", "l")).filter(off < F.col("left")).groupBy("d.source").agg(F.min(F.struct(off.alias("off"), "upto")).alias("best"))
    best = materialize(best.select("source", F.col("best.upto").alias("best")), "mix-best")

    out = placed.alias("d").join(best.alias("b"), same("d", "b"), "left")
    more = (F.col("size") > 0) & F.coalesce(F.col("upto") == F.col("best"), F.lit(False)) & (F.size("ends") <= F.col("full"))
    out = out.select("d.*", F.when(more, F.concat(F.col("ends").cast("array<double>"), F.array(F.col("target") + F.col("size")))).otherwise(F.col("ends").cast("array<double>")).alias("taken_at"))
    # The position of a copy is where its first word falls in the integral of its source's weight, inverted.
    times = F.transform("taken_at", lambda x: time_of(F.least((x - F.col("size")) / F.col("target"), F.lit(1.0))))
    out = out.select("doc_id", "source", "size", "source_size", "target", F.size("taken_at").cast("long").alias("copies"), (F.col("size") * F.size("taken_at")).alias("taken"), times.alias("times"))
    # Range-sorted by the first position; documents that are not taken come last.
    out = materialize(out, "mix-taken")
    position = F.get("times", F.lit(0)).asc_nulls_last()
    return out.repartitionByRange(n, position, "source", "doc_id").sortWithinPartitions(position, "source", "doc_id")


def cycle_schedule(docs: DataFrame, cycle: list[list[tuple[float, float]]], source_col: str = "source") -> DataFrame:
    """Knots (source, t, weight): the schedules of cycle dealt in turn to the sources by code point, null last; an empty table has none.

    Sources are numbered by range partitions and the number of sources in each, a row per partition.
    """
    n = partitions(docs.sparkSession)
    s = docs.select(F.col(source_col).alias("source")).distinct().repartitionByRange(n, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    s = materialize(s.withColumns({"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "source-order")
    parts = s.groupBy("pid").agg(F.count("*").alias("here"), F.min("at").alias("start"))
    parts = parts.withColumn("before", F.sum("here").over(Window.orderBy("pid")) - F.col("here"))
    s = s.join(parts, "pid").select("source", ((F.col("before") + F.col("at") - F.col("start")) % len(cycle)).cast("int").alias("k"))
    knots = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("weight")) for t, w in c)) for c in cycle))
    return s.select("source", F.explode(F.get(knots, F.col("k"))).alias("x")).select("source", "x.t", "x.weight")


def in_training_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by training time.

    Rows that share an id, and those with null ids, are told apart by their size and dealt to the mix's rows
    in turn, so that each is taken as often as one row of the mix.
    """
    key = lambda i: F.coalesce(F.col(i).cast("string"), F.lit("null"))
    turn = lambda k, n, by: F.row_number().over(Window.partitionBy(k, n).orderBy(by))
    copies = mixed.filter(F.size("times") > 0).select(key("doc_id").alias("mix_key"), F.col("size").alias("mix_words"), "times")
    copies = copies.withColumn("mix_turn", turn("mix_key", "mix_words", "times")).select("mix_key", "mix_words", "mix_turn", F.posexplode("times").alias("mix_copy", "mix_time"))
    # One exchange of the texts serves both the numbering and the join.
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), key(id_col).alias("own_key"), word_count(F.col(text_col)).alias("own_words"), F.xxhash64(text_col).alias("own_hash"))
    own = own.withColumn("own_turn", turn("own_key", "own_words", "own_hash"))
    same_key = (F.col("own_key") == F.col("mix_key")) & (F.col("own_words") == F.col("mix_words"))
    out = own.join(copies.hint("merge"), same_key & (F.col("own_turn") - F.col("mix_turn") == 0))
    order = ["mix_time", "mix_key", "mix_words", "own_turn", "mix_copy"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
