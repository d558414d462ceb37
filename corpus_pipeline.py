"""From raw documents to training tokens: quality rules, line dedup, near-dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. Empty tables pass through; null and
empty texts fail the quality rules; texts are taken whole, however long. Repeated rows are one class of copies,
whose rows of the smallest doc_id stay; rows that share an id are mixed each on its own. Of a
repeated line the largest doc_id keeps it. More columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import lines, minhash, mixing, piece_codec, quality
from lodestack.llm.common import documents, materialize, table
from lodestack.llm.queries import CYCLE, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoffs."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them hold, but for the largest doc_id's; n_chars follows."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class."""
    classes = minhash.near_duplicates(docs)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first["__id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    mixed = materialize(mixing.mix(docs, mixing.cycle_schedule(docs, CYCLE)), "mix")
    return mixing.in_training_order(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256): a row per training document, with the digest of the text that its ids decode to."""
    out = piece_codec.encode(docs, tokenizer_path(), decoded="decoded")
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_each_class),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", encode),
]

#: Near-duplicate sampling and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
