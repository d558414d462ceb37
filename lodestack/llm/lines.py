"""Line deduplication with keep bitmaps.

Line keys are hashed, range-partitioned by (hash, document) and sorted, so that the lines of a hot key lie
side by side in as many partitions as they fill. A partition is streamed once; keys that cross a boundary
are summed up from a summary of each partition's first and last key. What comes back is one compressed
bitmap of kept lines per document that loses some, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialize, partitions

SPACE_CHARS = SPACE_BYTES.decode()
#: Null ids sort before all others.
NULL_ID = -(2**63)
#: Texts are cut in slices of so many bytes, so that a worker's memory does not hang on the size of a batch.
SLICE_BYTES = 4_000_000


def line_key(line) -> "F.Column":
    """A line without the white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id, uid, pos) of every line whose key has min_chars code points; h1, h2 are 128 bits of the key's hash, uid tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("uid"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "uid", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "uid", "pos")


def runs(part: DataFrame, min_docs: int) -> DataFrame:
    """Stream each sorted partition of key rows: the lines to drop, and those that other partitions decide.

    Out come (pid, h1, h2, n, last, doc_id, uid, pos, open): n documents and the last document of the key
    within its partition. Lines of a partition's first and last key are open unless min_docs documents and
    a later one are already there; n and last are those of the whole partition for open lines. Of the key
    in progress no more is held than the lines of its first min_docs - 1 documents, or of its latest one.
    """

    def run(batches):
        held, seen, first = None, 0, None
        for b in chain(batches, [None]):
            done = b is None
            if done:
                if held is None:
                    return
                cols = held
            elif b.num_rows:
                own = [np.asarray(c) for c in b.columns]
                cols = own if held is None else [np.concatenate(c) for c in zip(held, own, strict=True)]
            else:
                continue
            pid, h1, h2, doc, uid, pos = cols
            first = first or (h1[0], h2[0])
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts, of = np.flatnonzero(new), np.cumsum(new) - 1
            n = np.add.reduceat(np.r_[True, doc[1:] != doc[:-1]] | new, starts, dtype=np.int64)
            n[0] += seen  # documents of the key in progress whose lines are out already
            last = doc[np.r_[starts[1:], len(doc)] - 1]
            drop = (n[of] >= min_docs) & (doc < last[of])
            going_on = ~drop & (of == of[-1])
            edge = going_on if done else ~drop & ~going_on & (h1 == first[0]) & (h2 == first[1])
            held, seen = [c[going_on] for c in cols], int(n[-1]) - 1 if n[-1] >= min_docs else 0
            at = np.flatnonzero(drop | edge)
            full = (pid, h1, h2, n[of], last[of], doc, uid, pos, edge)
            for x in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at[x : x + 50_000]]) for c in full], names=["pid", "h1", "h2", "n", "last", "doc_id", "uid", "pos", "open"])

    return part.select("pid", "h1", "h2", "doc_id", "uid", "pos").mapInArrow(run, "pid int, h1 long, h2 long, n long, last long, doc_id long, uid long, pos int, open boolean")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, **cols: str) -> DataFrame:
    """(doc_id, uid, pos): lines whose key is found in min_docs documents, but for those in its largest doc_id."""
    order = ["h1", "h2", "doc_id"]
    # Range partitions take a sample first: of the written hashes, so that texts are read once.
    keyed = materialize(keyed_lines(docs, min_chars, **cols), "line-keys")
    spread = keyed.repartitionByRange(partitions(docs.sparkSession), *order)
    rows = spread.sortWithinPartitions(*order, "uid", "pos").withColumn("pid", F.spark_partition_id())
    rows = materialize(runs(rows, min_docs), "lines")
    # A document's lines of one key lie in one partition, so documents add up. At most two keys per partition are open.
    waiting = rows.filter("open")
    total = waiting.select("pid", "h1", "h2", "n", "last").distinct().groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    late = waiting.drop("n", "last").join(total, ["h1", "h2"]).filter((F.col("n") >= min_docs) & (F.col("doc_id") < F.col("last")))
    return rows.filter("NOT open").select("doc_id", "uid", "pos").unionByName(late.select("doc_id", "uid", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, **cols: str) -> DataFrame:
    """(doc_id, uid, bitmap): for each document that loses lines a compressed bitmap, 1 for a line that stays; lines past its end stay."""

    def run(batches):
        for b in batches:
            out = []
            for pos in b.column(2):
                at = pos.values.to_numpy()
                keep = np.ones(-(-(int(at.max()) + 1) // 8) * 8, np.uint8)
                keep[at] = 0
                out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "uid", "bitmap"])

    lost = dropped_lines(docs, min_chars, min_docs, **cols).groupBy("doc_id", "uid").agg(F.collect_set("pos").alias("pos"))
    return lost.mapInArrow(run, "doc_id long, uid long, bitmap binary")


def slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES of the text column at; a text that is longer is a part of its own."""
    size = np.cumsum(pa.compute.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
    stops = np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1
    start = 0
    for stop in [*stops.tolist(), b.num_rows]:
        if stop > start:
            yield b.slice(start, stop - start)
        start = stop


def without_lines(texts: pa.Array, maps: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the texts without the lines that their bitmaps drop, their lines before, the lines dropped), by one mask over all bytes."""
    texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    off -= off[0]
    breaks = np.flatnonzero(data == 10)
    ends = np.searchsorted(breaks, off)
    n, lost = np.diff(ends) + 1, np.zeros(len(texts), np.int64)
    keep = np.ones(len(data), bool)
    for i in np.flatnonzero(maps.is_valid().to_numpy(zero_copy_only=False)):
        bits = np.ones(n[i], bool)
        own = np.unpackbits(np.frombuffer(zlib.decompress(maps[i].as_py()), np.uint8), bitorder="little")[: n[i]]
        bits[: len(own)] = own
        lost[i] = n[i] - np.count_nonzero(bits)
        # A line goes with the break behind it; the last line that stays has none.
        stops = np.r_[breaks[ends[i] : ends[i + 1]] + 1, off[i + 1]]
        keep[off[i] : off[i + 1]] = np.repeat(bits, np.diff(np.r_[off[i], stops]))
        if bits.any() and not bits[-1]:
            keep[stops[np.flatnonzero(bits)[-1]] - 1] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    buffers = [None, pa.py_buffer(total[off].astype(np.int32)), pa.py_buffer(data[keep])]
    return pa.Array.from_buffers(pa.string(), len(texts), buffers), n, lost


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the text, and n_lines (before), n_dropped.

    Null and empty texts are one empty line, and come out as an empty text. A null id is a document before
    all others; rows that share an id count as one document; short keys stay; an empty table gives no rows.
    Own columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    cols = docs.columns
    maps = materialize(keep_bitmaps(docs, min_chars, min_docs, id_col=id_col, text_col=text_col), "bitmaps").select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid"), F.col("bitmap").alias("__keep"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A merge join at every size, so that small inputs run the plan of large ones.
    both = docs.join(maps.hint("merge"), (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == maps["__id"]) & (F.xxhash64(text) == maps["__uid"]), "left")
    at = cols.index(text_col)

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                texts, n, lost = without_lines(part.column(at), part.column(len(cols)))
                arrays = [texts if i == at else part.column(i) for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=[*cols, "n_lines", "n_dropped"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.select(*cols, "__keep").mapInArrow(run, f"{types}, n_lines long, n_dropped long")
