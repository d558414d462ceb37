"""Exact top-k search by distributed histogram selection.

Queries are packed into blocks, candidates are dealt into cells, which are written once, and every cell scores
its candidates against every block with one matrix product. A round counts each query's scores in bins between bounds;
the counts of all cells tell which bin holds the k-th highest value, and the next round looks into that
bin alone. When few enough scores lie above a query's lower bound, one last pass emits those, at most k
per cell, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

BINS, BLOCK, CELL = 64, 1024, 4096


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x). Null ids and vectors, and those with a null or non-finite component, are left out; a component that is finite but passes 64 bits is an error."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    whole = lambda e: F.when(F.abs(e * scale) < float(2**63), F.floor(e * scale).cast("long")).otherwise(F.raise_error(F.concat(F.lit("component out of 64 bits: "), e.cast("string"))).cast("long"))
    return df.filter(ok).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(lists), 0), np.int64)


def product(c: np.ndarray, q: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """Integer inner products, candidates by queries, exact. Those of small numbers are done by doubles; others wrap at 64 bits, which is
    exact where the product fits, and doubles tell where it may not: these few are done by integers of any size. One that passes 64 bits is an error, unless `without` marks it."""
    x, y = c.astype(float), q.T.astype(float)
    near, most = x @ y, float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, c.shape[1])
    if most < 2**53:
        return near.astype(np.int64)
    out = c.astype(np.int64) @ q.T.astype(np.int64)
    for i, j in zip(*np.nonzero(np.abs(near) > 2.0**63 - most * 2.0**-40), strict=True):
        if without is not None and without[i, j]:
            continue
        exact = sum(int(a) * int(b) for a, b in zip(c[i], q[j], strict=True))
        if not -(2**63) <= exact < 2**63:
            raise OverflowError(f"an inner product passes 64 bits: {exact}")
        out[i, j] = exact
    return out


def smallest(m: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as bytes: how many rows, then the length of an item of the last one, then all of them."""
    last = np.ascontiguousarray(columns[-1])
    return b"".join([np.array([len(last), last.itemsize], np.int64).tobytes(), *(c.tobytes() for c in columns[:-1]), last.tobytes()])


def unpacked(blob: bytes, columns: int, dim: int) -> list[np.ndarray]:
    """The columns of packed(): all but the last are numbers of 64 bits, the last has dim integers a row."""
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    out = [np.frombuffer(blob, np.int64, n, 16 + 8 * n * i) for i in range(columns - 1)]
    return [*out, np.frombuffer(blob, f"<i{size}", n * dim, 16 + 8 * n * (columns - 1)).reshape(n, dim)]


def flat(t: pa.Table, name: str) -> pa.Array:
    return t.column(name).combine_chunks()


def cells_of(candidates: DataFrame, n_cells: int) -> DataFrame:
    """(dim, cell, packed): the candidates dealt into cells by their id, a row per cell and length, written once for all rounds."""

    def pack(key, t):
        blob = packed(flat(t, "vec_id").to_numpy(), smallest(matrix(flat(t, "v"), key[0].as_py())))
        return pa.table({"dim": [key[0]], "cell": [key[1]], "packed": pa.array([blob], pa.binary())})

    rows = candidates.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_cells)).cast("int").alias("cell"))
    return materialize(rows.groupBy("dim", "cell").applyInArrow(pack, "dim int, cell int, packed binary"), "topk-cells")


def scored(state: DataFrame, cells: DataFrame, n_cells: int, f, schema: str) -> DataFrame:
    """f(query ids, candidate ids, scores, lower bounds, bin widths) for every block of state and cell of candidates."""

    def pack(key, t):
        blob = packed(*(flat(t, c).to_numpy() for c in ("query_id", "lo", "width")), smallest(matrix(flat(t, "v"), key[0].as_py())))
        return pa.table({"dim": [key[0]], "packed": pa.array([blob], pa.binary())})

    def run(key, c, q):
        dim, out = key[0].as_py(), []
        for cell in c.column("packed").to_pylist():
            ids, m = unpacked(cell, 2, dim)
            for blob in q.column("packed").to_pylist():
                query_ids, lo, width, v = unpacked(blob, 4, dim)
                out.append(f(query_ids, ids, product(m, v, ids[:, None] == query_ids), lo, width))
        names = [p.split()[0] for p in schema.split(", ")]
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out]) if out else [], pa.int64()) for i, k in enumerate(names)})

    blocks = state.groupBy(F.size("v").alias("dim"), "block").applyInArrow(pack, "dim int, packed binary")
    blocks = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    return cells.groupBy("dim", "cell").cogroup(blocks.groupBy("dim", "cell")).applyInArrow(run, schema)


def histogram(ids, vec_ids, s, lo, width):
    """(query, bin, count) of scores at or above the lower bound; scores past the last bin count in it."""
    # Differences of 64-bit numbers without a sign hold all that a score can be above its bound.
    at = np.minimum((s.astype(np.uint64) - lo.astype(np.uint64)) // width.astype(np.uint64), BINS - 1).astype(np.int64)
    own = vec_ids[:, None] == ids
    n = len(ids)
    counts = np.bincount((at + np.arange(n) * BINS)[(s >= lo) & ~own], minlength=n * BINS)
    q = np.flatnonzero(counts)
    return ids[q // BINS], q % BINS, counts[q]


def squares(v: str) -> "F.Column":
    """The sum of squares of integers, as a double."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query; ties to the smaller vec_id.

    Both sides are (vec_id long, v array<long>). A query's own vec_id and candidates of another length take
    no part; a query id that is repeated is answered for its smallest vector; repeated candidates rank as
    rows of their own; fewer candidates than k give all; empty tables give none. Products are exact up to 64 bits, and one beyond is an
    error. Other columns are left out, whatever their names.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = candidates.agg(F.count("*").alias("n"), F.max(squares("v")).alias("norm")).first()
    n_queries = queries.count()
    if not size["n"] or not n_queries:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_cells = max(partitions(queries.sparkSession), -(-size["n"] // CELL))
    cells = cells_of(candidates, n_cells)

    # Cauchy-Schwarz bounds every score; done queries need no more rounds.
    norm = F.sqrt(squares("v")) * F.lit(float(size["norm"]) ** 0.5)
    bound = F.when(norm < float(2**62), F.ceil(norm * 1.000001 + 1).cast("long")).otherwise(F.lit(2**63 - 1))
    state = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_queries // BLOCK))).cast("int").alias("block"), (-bound).alias("lo"), (F.floor(bound / (BINS // 2)) + 1).cast("long").alias("width"), F.lit(False).alias("done"))
    state = materialize(state, "topk-state")
    while not state.filter("NOT done").isEmpty():
        bins = scored(state.filter("NOT done"), cells, n_cells, histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        state = materialize(narrowed(state, bins.withColumn("above", above), k), "topk-state")

    def emit(ids, vec_ids, s, lo, width):
        q, v, top = [], [], []
        for j in range(len(ids)):
            at = np.flatnonzero((s[:, j] >= lo[j]) & (vec_ids != ids[j]))
            at = at[np.lexsort((vec_ids[at], -s[at, j]))[:k]]
            q.append(np.full(len(at), ids[j]))
            v.append(vec_ids[at])
            top.append(s[at, j])
        return [np.concatenate(x) for x in (q, v, top)]

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = scored(state, cells, n_cells, emit, "query_id long, vec_id long, score long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def narrowed(state: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The next state: the bin that holds a query's k-th highest score, or done once few scores lie above it.

    Fewer than k scores lie above the bin that is found, and the last bin of the next round counts those
    too, so that the k-th highest stays the one to look for.
    """
    hit = found.filter(F.col("above") >= k).groupBy("query_id").agg(F.max_by(F.struct("bin", "above", "n"), "bin").alias("hit"))
    out = state.alias("s").join(hit.alias("h"), "query_id", "left")
    lo = F.when(F.col("hit").isNull(), F.col("lo")).otherwise((F.col("lo").cast("decimal(20,0)") + F.col("hit.bin").cast("decimal(20,0)") * F.col("width")).cast("long"))
    enough = F.col("hit").isNull() | (F.col("hit.above") <= 4 * k) | (F.col("width") == 1)
    return out.select("query_id", "v", "block", F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done") | enough, F.col("width")).otherwise(F.floor(F.col("width") / BINS) + 1).cast("long").alias("width"), (F.col("done") | enough).alias("done"))
