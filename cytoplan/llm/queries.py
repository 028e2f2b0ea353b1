"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_spans, language_id, media, mixing, near_dedup, piece_encoding, quality, sharding, token_files, toxicity
from .common import documents


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), threshold=0.85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, written = token_files.write_token_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"))
    return written.join(token_files.count_tokens(spark, folder), ["file", "document"]).select("doc_id", "n_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read(media.store(documents(spark, sf_dir)))
    size = F.octet_length("payload")
    return out.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir)).select("doc_id", "slot", "shard")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_encoding.encode_decode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.cut_repeats(documents(spark, sf_dir)).drop("kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": near_dedup.ORACLE_SQL,
        "op5_sharding": sharding.oracle_sql(),
        "op9_suffix_array_dedup": exact_spans.ORACLE_SQL,
        "op10_mixing": mixing.oracle_sql(),
    }
