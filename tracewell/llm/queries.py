"""Queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, conversation_repair, cover_tree, hard_negatives, jaccard_join, licenses, mixing, pii, secret_scan, syncmers, token_count, toxicity, url_filter
from tracewell.llm.common import table
from tracewell.llm.oracle import ORACLES


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the filter list on every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark)).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, keep=["doc_id"])
    labels = lambda column: F.transform(column, lambda m: m["label"])
    listed = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    starts = F.transform("license_places", lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("license_places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(labels("license_places")).alias("base_labels"),
        listed(F.concat(labels("license_places"), labels("license_matches"))).alias("labels"),
        F.col("license_score").alias("score"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of every label."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every document and the text they stand for, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.encode(docs, path, keep=["doc_id"], decoded="decoded")
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 4-grams overlap by 85 percent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are by all anchors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = syncmers.with_edited(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    kept = ["doc_id", "n_chars", "edited_sha256"]
    found = syncmers.add_anchors(both, {"own": "text", "edited_own": "edited", "next_own": "next_text"}, keep=kept)
    found = syncmers.match(found, {"as_edited": ("own", "edited_own"), "as_next": ("own", "next_own")})
    return found.select(
        *kept,
        syncmers.printed(F.col("own")).alias("fingerprint"),
        syncmers.printed(F.col("edited_own")).alias("edited_fingerprint"),
        F.size("own").cast("bigint").alias("n_anchors"),
        syncmers.likeness(F.col("own"), F.col("edited_own"), F.col("as_edited")).alias("near_edited"),
        syncmers.likeness(F.col("own"), F.col("next_own"), F.col("as_next")).alias("near_next"),
        syncmers.passages(F.col("as_edited")).alias("edited_passages"),
        syncmers.passages(F.col("as_next")).alias("next_passages"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, the base kinds as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, keep=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    number = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.described(base), 256).alias("base_sha256"),
        secret_scan.described(F.col("secret_spans")).alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, the base kinds as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.fit(docs), keep=["doc_id"])
    base = F.filter("pii_spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(secret_scan.described(base), 256).alias("base_sha256"),
        secret_scan.described(F.col("pii_spans")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after the labels of every seventh are moved on."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, label, F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations, and the cheapest edits that mend their structure."""
    given = conversation_repair.plain(table(spark, sf_dir, "conversations"))
    mended = conversation_repair.repair(conversation_repair.damage(given))
    told = conversation_repair.fingerprints(mended.edits)
    found = given.select("conv_id").distinct()
    for side in (mended.conversations, told):
        side = side.withColumnRenamed("conv_id", "_conv")
        found = found.join(side, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.add_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


LLM_QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_bpe": op6_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_counts": op13_token_counts,
}
LLM_ORACLES = ORACLES
