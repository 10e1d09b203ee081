"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, merkle, minhash, mixing, pii, quality, repair, sharding, simhash, suffix, tokens
from .oracles import ORACLES
from .runtime import load


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "quality")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_removed(load(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"), words=2, percent=80)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digest(chat.format_chat(rows))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents", "doc_id", "text"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(load(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = load(spark, sf_dir, "documents"), sharding.Store(spark)
    # arrivals of three sizes, that is of several tiers
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for part in (turn < 5, turn.isin(5, 6), turn == 7):
        store.append(docs.where(part))
    version = store.compact()
    store.expire()
    return store.read(version, docs.schema).select("doc_id", F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"), F.lit(version).alias("version"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    whole, turns = repair.repair(repair.damage(rows))
    of = lambda df, x: df.withColumnRenamed("conv_id", x)
    out = rows.select("conv_id").distinct().join(of(whole, "w"), F.col("conv_id").eqNullSafe(F.col("w")), "left").join(of(repair.digest(turns), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    altered = merkle.digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, altered)
    out = merkle.manifest(load(spark, sf_dir, "documents", *fields), fields, other=other)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
