"""Token counts against the library they must equal."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import token_count as tc
from tracewell.llm.queries import op13_token_counts

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = tc.Pieces(PATH)
PROOF = tc.prove(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.one_of(st.sampled_from("abcdefgh tion the  \n\téèü日本🙂▁<s>0123.,\0\xa0﻿"), st.characters(codec="utf-8")), max_size=80)


def counter():
    return tc.Counter(PIECES, PROOF)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_counts_equal_the_library(texts):
    assert counter_once.count(texts) == [len(x) for x in LIBRARY.encode(texts)]


counter_once = counter()


@settings(max_examples=100, deadline=None)
@given(st.text("abt▁éo he", min_size=1, max_size=90))
def test_scan_heap_and_batch_agree(word):
    assert PIECES.scan(word)[0] == PIECES._heap(word)
    word = word.replace(tc.SPACE, "x")
    assert counter_once.learn([word]) == [PIECES.count(tc.SPACE + word)]


def test_long_words_runs_of_spaces_and_special_names():
    texts = ["ab" * 50_000, " " * 5_000, " " * 37 + "b", "<s></s><unk><0x0A>", "▁" * 40, "a▁b", "\n" * 999, "é" * 3_000]
    assert counter_once.count(texts) == [len(x) for x in LIBRARY.encode(texts)]


def test_every_word_piece_that_is_one_token_is_found():
    whole = {p for p in PIECES.costs if p[0] == tc.SPACE and LIBRARY.encode(p[1:], out_type=str) == [p]}
    assert {tc.SPACE + w for w in counter_once.whole if w or tc.SPACE in whole} >= whole


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 20)
    own, texts = counter(), ["thonre anedly  xq", "", "thonre zzqqj " * 9, " anedly"]
    assert [own.count([t])[0] for t in texts * 2] == [len(x) for x in LIBRARY.encode(texts * 2)]


def test_unordered_vocabulary_is_merged_word_by_word():
    own = counter()
    own.ordered = False
    assert own.count(["thonre anedly", "x"]) == counter_once.count(["thonre anedly", "x"])


def test_edges_and_clashes(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "the cat", None), (2, "the cat", None), (3, "a" * 20_000, "z"), (4, "\0", "q")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _text string")
    found = sorted(tuple(r) for r in tc.add_counts(df, PATH, limit=5).select("text", "n_bytes", "n_tokens", "over_limit").fillna("-").collect())
    expected = sorted((t if t is not None else "-", len(t or ""), n := len(LIBRARY.encode(t or "")), n > 5) for _, t, _ in rows)
    assert found == expected
    assert tc.add_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tc.add_counts(df.withColumnRenamed("_text", "N_Tokens"), PATH)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op13_token_counts(spark, SMALL).collect()}
    assert found.keys() == docs.keys()
    for key, text in docs.items():
        n = len(LIBRARY.encode(text))
        assert tuple(found[key]) == (key, len(text.encode()), n, n > 4096)
