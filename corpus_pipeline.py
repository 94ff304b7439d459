"""A training corpus from the documents table, in stages that each read what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.byte_bpe import encode_documents
from attesta.llm.kneser_ney import classify
from attesta.llm.mixing import mixed_documents
from attesta.llm.near_duplicates import near_duplicates
from attesta.llm.quality_rules import apply_policy, measure, with_ledger


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    return apply_policy(with_ledger(measure(docs, keep_text=True)), "full-1").where("kept").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of least doc_id (nulls last), then of least text digest.

    Rows are told apart by a number of their own, as doc_ids may repeat or be null.
    """
    rows = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80, width=5)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("digest"), "_row")
    each = rows.select("_row", place.alias("place")).join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    first = each.groupBy("component_id").agg(F.min("place").alias("place")).select("place._row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs, weights=(3, 1, 2), percent=150, most=2)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, keep_memo=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier's model and the byte-level BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
