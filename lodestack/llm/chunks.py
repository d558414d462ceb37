"""Corpus-wide counts of hashed keys, exchanged as packed blobs and brought back to the documents.

Documents are dealt into chunks of some megabytes by a hash of their id. A chunk's distinct keys (hashes of
shingles, of anchors, ...) are sorted and split into buckets by their leading bits; a bucket's part is one
binary row of byte-packed differences, so that a key costs three bytes or so instead of a row. A bucket adds
up its keys over all chunks and sends each chunk the totals in the chunk's own order. Keys are made distinct
within a chunk first, so that a hot key comes once per chunk and not once per occurrence.

A blob needs some hundred keys to be worth a row, and both chunks and buckets grow with the input, so that
blobs of a direct exchange get smaller. Where they would hold fewer than BLOB_KEYS the exchange has two hops:
chunks send one blob per zone of buckets, a region of chunks merges the blobs of a zone and exchanges the
merged keys with the buckets, and hands the totals back to its chunks. A hot key then comes once per region.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .lines import NULL_ID

CHUNK_BYTES, BUCKET_KEYS, KEY_BITS, BLOB_KEYS = 2_000_000, 1_000_000, 40, 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unsqueeze(b, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as many bytes as are cheapest, with the larger ones listed apart."""
    d = np.diff(keys, prepend=np.uint64(0))
    cost = {w: len(d) * w + 8 * int(np.count_nonzero(d >> np.uint64(8 * w))) for w in (1, 2, 3, 4, 5, 6)}
    w = min(cost, key=cost.get)
    far = np.flatnonzero(d >> np.uint64(8 * w)).astype(np.uint32)
    low = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]
    return b"".join([np.array([w, len(far)], "<u4").tobytes(), far.tobytes(), (d[far] >> np.uint64(8 * w)).astype("<u4").tobytes(), np.ascontiguousarray(low).tobytes()])


def unpack(b: bytes) -> np.ndarray:
    w, n = (int(x) for x in np.frombuffer(b, "<u4", 2))
    low = np.frombuffer(b, np.uint8, offset=8 + 8 * n).reshape(-1, w)
    d = np.zeros((len(low), 8), np.uint8)
    d[:, :w] = low
    d = d.view("<u8").ravel()
    d[np.frombuffer(b, "<u4", n, 8)] |= np.frombuffer(b, "<u4", n, 8 + 4 * n).astype(np.uint64) << np.uint64(8 * w)
    return np.cumsum(d, dtype=np.uint64)


def place(chunks: int, doc_id, text_hash) -> "F.Column":
    """A document's chunk. Its text takes part, so that texts of one id, or of none, are spread."""
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(chunks)).cast("int")


@dataclass
class Deal:
    """Documents dealt into chunks: (chunk, doc_id, text binary), and by how much keys are to be split; stride is the number of buckets of a zone, 1 for a direct exchange."""

    rows: DataFrame
    chunks: int
    buckets: int
    stride: int = 1


def deal(docs: DataFrame, keys_per_byte: float, id_col: str = "doc_id", text_col: str = "text") -> Deal:
    """Null ids become NULL_ID, null texts empty. The number of chunks and buckets follows the size of all texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n, keys = partitions(docs.sparkSession), int(size * keys_per_byte)
    chunks, buckets = max(2 * n, -(-size // CHUNK_BYTES)), max(n, keys // BUCKET_KEYS)
    # Small inputs have small blobs as well, but few of them.
    direct = chunks * buckets <= max(keys // BLOB_KEYS, 4 * n * n)
    zones = buckets if direct else max(1, min(buckets, keys // (chunks * BLOB_KEYS)))
    stride = -(-buckets // zones)
    buckets = stride * -(-buckets // stride)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = ids.select(place(chunks, "doc_id", F.xxhash64("text")).alias("chunk"), "doc_id", F.col("text").cast("binary").alias("text"))
    return Deal(rows, chunks, buckets, stride)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rep, same, copies, u): for every document the smallest doc_id that has its text, and how many have it; same is the text's MD5 where that is more than one, else null; u is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.md5(text).alias("h"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("u"))
    ids = materialize(ids, "text-ids")
    # A table of its own, so that a text with very many copies is a skewed join, which Spark splits.
    reps = materialize(ids.groupBy("h", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "text-reps")
    return materialize(ids.join(reps, ["h", "n"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("copies") > 1, F.col("h")).alias("same"), F.coalesce("copies", F.lit(1)).alias("copies"), "u"), "copies")


def only_copies(copies: DataFrame, d: Deal) -> DataFrame:
    """(chunk, skip): ids whose every text is found under a smaller id, in the chunks of these texts."""
    last = copies.groupBy("doc_id").agg(F.max("rep").alias("rep")).filter("rep < doc_id").select("doc_id")
    at = copies.filter("rep < doc_id").join(last, "doc_id").select(place(d.chunks, "doc_id", F.col("u")).alias("chunk"), F.col("doc_id").alias("skip"))
    return at.distinct()


def copied(copies: DataFrame, d: Deal) -> DataFrame:
    """(chunk, counted, same, copies): of ids that only_copies leaves, each text that has copies, with the number of documents that its first id counts for; under other ids it counts none."""
    c = copies.filter("same IS NOT NULL").groupBy("doc_id", "same", "u").agg(F.first("rep").alias("rep"), F.first("copies").alias("copies"))
    c = c.join(copies.groupBy("doc_id").agg(F.max("rep").alias("last")).filter("last >= doc_id").select("doc_id"), "doc_id")
    return c.select(place(d.chunks, "doc_id", F.col("u")).alias("chunk"), F.col("doc_id").alias("counted"), "same", F.when(F.col("rep") == F.col("doc_id"), F.col("copies")).otherwise(0).alias("copies"))


def multiplicity(ids: np.ndarray, data: np.ndarray, off: np.ndarray, t: pa.Table) -> np.ndarray:
    """How many documents each text of a chunk stands for, by the rows of copied(): the first row of a text with copies for all of them, other rows for none."""
    known = {(i, h): n for i, h, n in zip(*(t.column(c).to_pylist() for c in ("counted", "same", "copies")), strict=True) if i is not None}
    out = np.ones(len(ids), np.int64)
    for at in np.flatnonzero(np.isin(ids, np.array(list({i for i, _ in known}), np.int64))):
        key = (int(ids[at]), hashlib.md5(data[off[at] : off[at + 1]].tobytes()).hexdigest())
        if key in known:
            out[at], known[key] = known[key], 0
    return out


def skipped(t: pa.Table) -> np.ndarray:
    return np.unique(t.column("skip").drop_null().to_numpy())


def without(ids, data, off, skip):
    """The texts of a chunk but for those to skip."""
    keep = ~np.isin(ids, skip)
    lens = np.diff(off)
    return ids[keep], data[np.repeat(keep, lens)], np.concatenate([[0], np.cumsum(lens[keep])])


def texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, all bytes, the len + 1 offsets of each text in them) of a chunk, by doc_id and text: the same in every pass."""
    t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    col = t.column("text").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return t.column("doc_id").to_numpy(), data, off - off[0]


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**KEY_BITS / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def cut(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - KEY_BITS)


def sums(blobs: list, counts: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys of all blobs, sorted; their summed counts; where each blob's keys are among them)."""
    keys = [unpack(b) for b in blobs]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    # Doubles count exactly up to 2^53.
    total = np.bincount(at, np.concatenate([unsqueeze(c, np.uint32) for c in counts]), len(every))
    ends = np.cumsum([0, *map(len, keys)])
    return every, total.clip(max=2**32 - 1).astype(np.uint32), [at[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def totals(parts: DataFrame, d: Deal) -> DataFrame:
    """(chunk, bucket, totals binary) from (chunk, bucket, keys binary, counts binary): counts of each key over all chunks, in the chunk's order."""

    def run(key, t):
        _, total, places = sums(t.column("keys").to_pylist(), t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "totals": pa.array([squeeze(total[p]) for p in places], pa.binary())})

    if d.stride == 1:
        return parts.groupBy("bucket").applyInArrow(run, "chunk int, bucket int, totals binary")

    # Two hops: what chunks send is a blob per zone, named by its place among the zones. A region has as many chunks as a zone has buckets.
    buckets, stride = d.buckets, d.stride
    parts = parts.withColumn("region", F.floor(F.col("chunk") / stride).cast("int")).withColumnRenamed("bucket", "zone")
    parts = materialize(parts, "zone-keys")

    def merge(key, t):
        every, total, _ = sums(t.column("keys").to_pylist(), t.column("counts").to_pylist())
        return parts_of(key[0].as_py(), every, total, buckets)

    def spread(key, t, back):
        found, (_, _, places) = returned(back), sums(t.column("keys").to_pylist(), t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("zone"), "totals": pa.array([squeeze(found[p]) for p in places], pa.binary())})

    back = parts.groupBy("region", "zone").applyInArrow(merge, PARTS).groupBy("bucket").applyInArrow(run, "chunk int, bucket int, totals binary")
    back = back.select(F.col("chunk").alias("region"), F.floor(F.col("bucket") / stride).cast("int").alias("zone"), "bucket", "totals")
    return parts.groupBy("region", "zone").cogroup(back.groupBy("region", "zone")).applyInArrow(spread, "chunk int, bucket int, totals binary")


def parts_of(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, stride: int = 1) -> pa.Table:
    """The rows that a chunk sends to the buckets, or to zones of stride buckets; keys are sorted and distinct."""
    b = bounds(keys, buckets)[::stride]
    full = np.flatnonzero(np.diff(b))
    return pa.table({"chunk": pa.array(np.full(len(full), chunk, np.int32)), "bucket": pa.array(full.astype(np.int32)), "keys": pa.array([pack(keys[b[i] : b[i + 1]]) for i in full], pa.binary()), "counts": pa.array([squeeze(counts[b[i] : b[i + 1]].astype(np.uint32)) for i in full], pa.binary())})


PARTS = "chunk int, bucket int, keys binary, counts binary"


def returned(t: pa.Table) -> np.ndarray:
    """The totals of all keys of a chunk, in the order of its sorted distinct keys."""
    t = t.sort_by("bucket")
    found = [unsqueeze(b, np.uint32) for b in t.column("totals").to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
