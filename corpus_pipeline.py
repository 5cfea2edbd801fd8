"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from tracewell.llm.common import fresh, table
from tracewell.session import work_dir

GRAM, SHARE = 5, 80  # near duplicates: word shingles and the percentage shared
VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on this stage's labelled documents, calls toxic go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return jaccard_join.keep_one(docs, gram=GRAM, share=SHARE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found secrets are replaced in their texts, and n_chars follows the text."""
    found = secret_scan.scan(docs)
    any_found = F.size("secret_spans") > 0
    text = fresh(found, "_text")[0]
    found = found.withColumn(text, secret_scan.redact(F.col("text"), F.col("secret_spans")))
    new = {"text": F.col(text), "n_chars": F.when(any_found, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Codes of every document; the text is the one that the codes stand for."""
    kept = [c for c in docs.columns if c != "text"]
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep=kept, decoded="text")
    return coded.select("doc_id", "text", *(c for c in kept if c != "doc_id"), "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# a trained classifier and a tokenizer cannot be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = work_dir(spark, f"pipeline-{name.replace(' ', '-')}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
