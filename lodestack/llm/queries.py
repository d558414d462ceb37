"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, licenses, lines, minhash, mixing, piece_codec, quality, repeats, resample, sharding, tokenfiles, topk, warc
from .common import documents, materialize, shared_dir, table
from .oracle_sql import ORACLE_SQL  # noqa: F401


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeated_spans(documents(spark, sf_dir), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path()
    ids = piece_codec.encode(documents(spark, sf_dir), model)
    ids = ids.select("doc_id", "n_tokens", "token_ids", F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"))
    return piece_codec.decode(ids, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Weight schedules of op5, dealt to the sources in turn; their integrals are 3, 1 and 2.
CYCLE = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("lang", "failed_rules")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_token_files(documents(spark, sf_dir), path, tokenizer_path())
    return tokenfiles.token_counts(spark, path)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mixing.mix(docs, mixing.cycle_schedule(docs, CYCLE))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.get("times", F.lit(0)).alias("first_time"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("long")
    found = warc.captures(warc.read_records(spark, path, with_payload=False)).select(page.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "record_id", "refers_to")
    found = materialize(found, "captures")
    keepers = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("keeper"))
    return found.join(keepers, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("keeper").alias("refers_to"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"), F.array_max("licenses.containment").alias("containment"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors.filter("vec_id % 100 = 0"), vectors, 10)


#: Weights of op11's shards 0 to 7; the one that is added has weight 1 too.
SHARDS = [1.0] * 8


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(documents(spark, sf_dir), SHARDS)
    return out.withColumn("law", F.lit("key"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_mix_sources": op5_mix_sources,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_topk_search": op10_topk_search,
    "op11_sharding": op11_sharding,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_alignment": op13_token_alignment,
}
