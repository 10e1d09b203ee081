"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Documents whose text is null are
empty ones: the quality rules reject them. Extra columns of docs pass through every stage but the last. Every row is
judged by its own text, also where doc_ids are null or repeat: of equal or near texts one row stays, different texts all do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlweft.llm import decontaminate, minhash, mixing, quality, tokens
from crawlweft.llm.queries import vocabulary
from crawlweft.llm.runtime import drop_tables, load, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: base rules failed, or the monotone trees' score below their threshold."""
    ruled = quality.rules(docs.select(F.struct(*docs.columns).alias("row"), "text"), load(spark, sf_dir, "labels", "doc_id", "quality"), of=docs.select("doc_id", "text"))
    return ruled.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays: the smallest id."""
    return minhash.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for every copy that the mix takes of them."""
    return mixing.draw(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids written in the bit-plane format and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.round_trip(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: Trained trees, sketches and a tokeniser are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written once and read by the next; the ones before them are deleted."""
    docs, last = load(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < last:
            docs = materialize(docs, name)
        if k:
            drop_tables(before)
    return docs
