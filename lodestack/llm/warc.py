"""WARC archives: write captures, read records, assemble transactions.

A page becomes three records: the request, the response (or a revisit, if another page has the payload),
and a metadata record; request and metadata name the main record in WARC-Concurrent-To. Archives are
written by Spark's text writer, whose line separator is the two CRLFs that end a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Rows with one page_id and payload that one task writes.
COPIES = 1000
#: The pages have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The digits of base 32 as conv() writes them, and as RFC 4648 does.
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "file string, ordinal int, type string, record_id string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, fields string, payload binary"


def base32_sha1(data) -> "F.Column":
    """Upper-case base-32 SHA-1: twenty bytes are four groups of forty bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), HEX32, RFC32)


def roles(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pages, keepers): (page_id, url, payload, bytes, digest) of every page, and (digest, bytes, keeper, n_keepers, first_url) of every payload
    of min_bytes or more: the largest page_id that has it, how many rows have both, and the least url of those."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    # A row per payload, as a table of its own: a frequent payload is then a skewed join, which Spark splits. Null page_ids are smaller than all.
    one = p.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("u"))
    last = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "n", "u"))
    best = one.groupBy("digest", "bytes").agg(last.alias("k")).select("digest", "bytes", F.col("k.page_id").alias("keeper"), F.col("k.n").alias("n_keepers"), F.col("k.u").alias("first_url"))
    return p, materialize(best, "payloads")


def urn(*parts) -> "F.Column":
    h = F.md5(F.concat_ws(" ", *(F.coalesce(x.cast("string"), F.lit("null")) for x in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def lines_of(*parts) -> "F.Column":
    """Header lines; those whose value is null are left out."""
    return F.array_join(F.array_compact(F.array(*parts)), "\r\n")


def record(kind: str, rid, content_type: str, block, *headers) -> "F.Column":
    head = lines_of(F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head.cast("binary"), F.lit(END).cast("binary"), block)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write (page_id, url, html) as WARC archives below path, one per partition: three records per row.

    Null html is an empty payload, null urls give no target URI; white space and control characters in urls
    are left out. Of equal payloads of min_bytes or more the rows with the largest page_id are responses and the others
    revisit one of them (null page_ids are smaller than all); shorter payloads are all responses. Rows that are equal in
    page_id and payload are captures of their own. An empty table leaves a folder without records. Very long payloads are written whole, in one
    record; other columns are left out, whatever their names.
    """
    p, best = roles(pages, min_bytes)
    best_cols = ["keeper", "n_keepers", "first_url"]
    kept = F.col("n_keepers").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    p = p.join(best, ["digest", "bytes"], "left").withColumn("kind", F.when(kept, F.lit("response")).otherwise(F.lit("revisit")))
    # What others refer to is named by its payload and page; any other record by its place in the job, which nothing refers to.
    place = F.concat_ws("-", F.lit("at"), F.monotonically_increasing_id().cast("string"))
    single = F.when((F.col("kind") == "response") & (F.col("n_keepers") == 1), F.lit("0")).otherwise(place)
    repeated = best.filter("n_keepers > 1")
    if repeated.isEmpty():
        rows = p.withColumn("nonce", single)
    else:
        # Rows that share the keeper's page_id and payload are counted first, so that very many of them are one row in a task, and
        # written as often as they come, in blocks; the first one of the least url is what revisits refer to.
        rows = p.filter(~((F.col("kind") == "response") & F.coalesce(F.col("n_keepers") > 1, F.lit(False)))).withColumn("nonce", single)
        same = p.filter((F.col("kind") == "response") & (F.col("n_keepers") > 1)).groupBy("digest", "bytes", "page_id", "url", *best_cols, "kind").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        same = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("digest", "url", "block")
        same = same.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)))
        first = (F.col("copy") == 0) & F.col("url").eqNullSafe(F.col("first_url"))
        rows = rows.unionByName(same.withColumn("nonce", F.when(first, F.lit("0")).otherwise(F.concat_ws("-", F.lit("copy"), F.coalesce("url", F.lit("null")), F.col("copy").cast("string")))).drop("n", "block", "copy"))
    p = rows.withColumns({"uri": F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), "own": urn(F.col("kind"), F.col("page_id"), F.col("digest"), F.col("nonce")), "of": urn(F.lit("response"), F.col("keeper"), F.col("digest"), F.lit("0"))})
    target, to = F.concat(F.lit("WARC-Target-URI: "), "uri"), F.concat(F.lit("WARC-Concurrent-To: "), "own")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)).cast("binary")
    get = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END)).cast("binary")
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")).cast("binary")
    response = record("response", F.col("own"), "application/http; msgtype=response", F.concat(http, "payload"), target, digest)
    revisit = record("revisit", F.col("own"), "application/http; msgtype=response", http, target, digest, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), "of"))
    side = lambda kind: urn(F.lit(kind), F.col("own"))
    rows = p.select(F.explode(F.array(record("request", side("request"), "application/http; msgtype=request", get, target, to), F.when(F.col("kind") == "response", response).otherwise(revisit), record("metadata", side("metadata"), "application/warc-fields", about, target, to))).alias("r"))
    rows.select(F.col("r").cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def parse(data: bytes, file: str, with_payload: bool):
    """The records of an archive, as tuples of RECORD; a block that is cut short is an error."""
    at = ordinal = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at} of {file}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(head["Content-Length"])
        block = memoryview(data)[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} of {file} is cut short")
        kind, fields, payload, n, digest = head["WARC-Type"], None, None, None, None
        if kind in ("response", "revisit"):
            stop = bytes(block).find(b"\r\n\r\n")
            body = block[stop + 4 :]
            if kind == "response":
                n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                payload = bytes(body) if with_payload else None
            else:  # a revisit has the headers of the whole response and its digest
                http = dict(x.lower().split(": ", 1) for x in bytes(block[:stop]).decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                n, digest = int(http.get("content-length", 0)), head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        else:
            fields = bytes(block).decode("utf-8", "replace")
        yield file, ordinal, kind, head["WARC-Record-ID"], head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), head.get("WARC-Date"), n, digest, fields, payload
        at, ordinal = end + 4 + size + 4, ordinal + 1


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below path (.gz or plain), a row each; archives may have up to 2 GB each, Spark's limit for binary files."""

    def run(batches):
        schema = pa.schema([pa.field(x.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_buffer().to_pybytes()
                if name.endswith(".gz"):
                    parts = []
                    while raw:  # an archive may have a gzip member per record
                        d = zlib.decompressobj(31)
                        parts.append(d.decompress(raw))
                        raw = d.unused_data
                    raw = b"".join(parts)
                rows, size = [], 0
                for r in parse(raw, name, with_payload):
                    rows.append(r)
                    size += 300 + len(r[-1] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, type, refers_to, uri, date, payload_bytes, payload_digest, payload, request, metadata).

    request and metadata are structs, joined by WARC-Concurrent-To, or null where the archive has none; of
    records that share an id one counts; archives without records give no rows.
    """
    records = records.dropDuplicates(["record_id"])
    main = records.filter(F.col("type").isin("response", "revisit")).select("record_id", "type", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "payload")
    for kind in ("request", "metadata"):
        side = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy("concurrent_to").agg(F.min(F.struct(F.col("record_id").alias("id"), "uri", "date", "fields")).alias(kind))
        main = main.join(side, main["record_id"] == side["concurrent_to"], "left").drop("concurrent_to")
    return main
