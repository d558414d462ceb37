"""Token counts by a separator scan of flat, unindexed token files.

A shard is a run of little-endian token ids of 16 or 32 bits in which an end-of-document id closes every document.
Spark's text reader looks for the bytes of that id in byte ranges of the files, several tasks to a file,
and gives the length of what lies between two finds; no token leaves the reader. A range knows neither how
many documents come before it nor whether its first byte is the first of a token. A prefix scan over the
lengths of a file's ranges tells where each range begins; finds that are at no token's place are no separators; a second
prefix scan, over the separators of each range, numbers the documents across ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .piece_codec import ChunkTable, blocks, load

#: The end-of-sentence id of the vocabularies at hand.
EOD, SHARD_TOKENS = 2, 8_000_000


def separator(eod: int, width: int = 2) -> dict[str, str]:
    """Options by which Spark's text files are separated by the bytes of an id, whatever these are.

    An id whose bytes begin as they end, such as 0x0202, could be found across two tokens before it is found in its
    place, and is an error.
    """
    if width not in (2, 4) or not 0 <= eod < 1 << (8 * width):
        raise ValueError(f"id {eod} does not fit {8 * width} bits, or tokens have neither 16 nor 32")
    raw = eod.to_bytes(width, "little")
    if any(raw[:n] == raw[-n:] for n in range(1, width)):
        raise ValueError(f"id {eod} cannot separate documents: its bytes begin as they end")
    return {"lineSep": raw.decode("latin-1"), "encoding": "ISO-8859-1"}


def write_token_files(docs: DataFrame, path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, compression: str = "none", eod: int | None = None, width: int = 2) -> None:
    """Encode documents into shards path/kind=tokens/shard=..., with the ids of each shard's documents, in order, in path/kind=ids/shard=....

    Null and empty texts are documents of no tokens; a null id is written as nothing; repeated rows are written
    as often as they come; an empty table leaves a folder without shards. Each shard is one row of the task
    that made it, so that no order of rows is needed. Tokens have width bytes, and eod is the vocabulary's own end id unless given; a vocabulary
    that does not fit, and an eod that is a piece of text, is an error. Other columns are left out.
    Plain files can be scanned by several tasks each, compressed ones by one.
    """
    sp = load(model_path)
    if sp.get_piece_size() > 1 << (8 * width):
        raise ValueError(f"{sp.get_piece_size()} pieces do not fit {8 * width} bits")
    eod = sp.eos_id() if eod is None else eod
    if eod < sp.get_piece_size() and not sp.is_control(eod):
        raise ValueError(f"id {eod} stands for text")
    ends = separator(eod, width)

    def run(batches):
        from pyspark import TaskContext

        tab, part, made, n = ChunkTable(load(model_path)), TaskContext.get().partitionId(), 0, 0
        body, ids = [], []

        def shard():
            name = f"{part:06d}-{made:04d}"
            flat = np.concatenate(body)[:-1].astype(f"<u{width}").tobytes()
            texts = "\n".join("" if i is None else str(i) for i in ids).encode()
            return pa.RecordBatch.from_arrays([pa.array(["tokens", "ids"]), pa.array([name] * 2), pa.array([flat, texts], pa.binary())], names=["kind", "shard", "value"])

        for b in batches:
            own, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for s in blocks(list(map(len, texts))):
                flat, lens = tab.encode(texts[s])
                body.append(np.insert(flat.astype(np.int64), np.cumsum(lens), eod))
                ids += own[s]
                n += len(body[-1])
                if n >= shard_tokens:
                    yield shard()
                    body, ids, made, n = [], [], made + 1, 0
        if ids:
            yield shard()

    rows = docs.select(id_col, text_col).mapInArrow(run, "kind string, shard string, value binary")
    rows.select("kind", "shard", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "shard").options(compression=compression, **ends).text(path)


def files_of(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """(value, shard, block) of the files of a kind; block is where the reader's byte range begins. A folder without files gives no rows."""
    rows = spark.read.format("text").option("recursiveFileLookup", "true").options(**options).load(path)
    rows = rows.filter(F.col("_metadata.file_path").contains(f"/kind={kind}/"))
    return rows.select("value", F.regexp_extract("_metadata.file_path", r"shard=([^/]+)/", 1).alias("shard"), F.col("_metadata.file_block_start").alias("block"))


def scan(spark: SparkSession, path: str, eod: int = EOD, width: int = 2) -> DataFrame:
    """(shard, block, at, n): the bytes before each find of the separator's bytes, in the order at within a byte range; behind the last find come the rest of the file, if any."""
    found = files_of(spark, path, "tokens", **separator(eod, width))
    return found.select("shard", "block", F.monotonically_increasing_id().alias("at"), F.octet_length("value").cast("long").alias("n"))


def stitch(scanned: DataFrame, width: int = 2) -> DataFrame:
    """(shard, ordinal, n_tokens): every document, in its shard's order. Tokens behind the last separator are a document too.

    One range is a window of its own; windows over a shard have one row per range.
    """
    rows = materialize(scanned, "token-finds")
    ranges = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard", "block").orderBy("at")
    begins = rows.groupBy("shard", "block").agg(F.sum(F.col("n") + width).alias("bytes")).select("shard", "block", F.coalesce(F.sum("bytes").over(ranges), F.lit(0)).alias("base"))
    end = F.col("base") + F.sum(F.col("n") + width).over(inside) - width
    marked = materialize(rows.join(begins, ["shard", "block"]).select("shard", "block", "at", "n", (end % width == 0).alias("closes")), "token-ends")
    closed = marked.groupBy("shard", "block").agg(F.count_if("closes").alias("docs")).select("shard", "block", F.coalesce(F.sum("docs").over(ranges), F.lit(0)).alias("first"))
    before = F.coalesce(F.sum(F.col("closes").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marked.join(closed, ["shard", "block"]).withColumn("ordinal", F.col("first") + before)
    # A find at another place is part of two tokens: its bytes count.
    size = F.col("n") + F.when(F.col("closes"), 0).otherwise(width)
    return numbered.groupBy("shard", "ordinal").agg((F.sum(size) / width).cast("long").alias("n_tokens"))


def shard_ids(spark: SparkSession, path: str, eod: int = EOD, width: int = 2) -> DataFrame:
    """(shard, ordinal, doc_id) of the shards' documents."""
    files = files_of(spark, path, "ids", wholetext=True)
    # Spark's writer ends each file with the separator.
    ids = F.split(F.decode(F.expr(f"substring(CAST(value AS BINARY), 1, octet_length(value) - {width})"), "UTF-8"), "\n", -1)
    return files.select("shard", F.posexplode(ids).alias("ordinal", "id")).select("shard", F.col("ordinal").cast("long").alias("ordinal"), F.col("id").try_cast("long").alias("doc_id"))


def token_counts(spark: SparkSession, path: str, eod: int = EOD, width: int = 2) -> DataFrame:
    """(doc_id, n_tokens) of all documents of the token files below path; a document of an empty or null text has 0, a null id stays null, a folder without shards gives no rows."""
    return stitch(scan(spark, path, eod, width), width).join(shard_ids(spark, path, eod, width), ["shard", "ordinal"]).select("doc_id", "n_tokens")
