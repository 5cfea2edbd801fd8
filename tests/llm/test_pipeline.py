"""The pipeline against its parts on the smallest data, and on odd rows."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_pairs import plain_join
from tests.llm.test_texts import EDGE, SCHEMA
from tracewell.llm import secret_scan, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    scored = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    expected = {r.doc_id for r in toxicity.score(docs, scored).where("toxicity < 0.3").collect()}
    docs = corpus_pipeline.drop_toxic(spark, docs, SMALL).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == expected
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {c for _, c in plain_join(rows, corpus_pipeline.GRAM, corpus_pipeline.SHARE).values()}
    docs = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == expected
    clean = {r.doc_id: r.text for r in secret_scan.scan(docs).where("size(secret_spans) = 0").collect()}
    docs = corpus_pipeline.redact_secrets(spark, docs, SMALL).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == expected
    assert all(clean.get(r.doc_id, r.text) == r.text and r.n_chars == len(r.text) for r in docs.collect())
    assert secret_scan.scan(docs).where("size(secret_spans) > 0").count() == 0


def test_run_encodes_what_the_mix_takes(spark):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and max(sum(r.doc_id == x.doc_id for x in rows) for r in rows[:20]) <= 3
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == b"".join(i.to_bytes(4, "little") for i in ids)


def test_odd_rows_pass_all_stages(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA).withColumn("_text", F.lit(1)).withColumn("_src", F.lit("x"))
    for source in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, source, SMALL)
            assert set(source.columns) <= set(made.columns) and made.count() <= 3 * len(EDGE)
            source = made
