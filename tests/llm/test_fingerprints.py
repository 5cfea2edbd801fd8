"""Fingerprints through their query, edge rows included, against plain loops."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import syncmers
from tracewell.llm.queries import op8_fingerprints

LONG = " ".join(f"word{i * 31 % 97}" for i in range(6000))
ROWS = [
    (5, "one two three four five six"), (5, "another text under the same key, é\U0001f600"), (9, None), (2, ""), (None, "no key here at all"),
    (None, "nor here, but longer than the other one"), (-4, " \t"), (7, LONG), (8, LONG), (-(1 << 63), "the smallest key of all"),
    ((1 << 63) - 1, "the largest key of all"),
]


def likeness(a, b):
    """Anchors of one hash are matched first with first, second with second."""
    count = lambda side: {h: sum(x[0] == h for x in side) for h in {x[0] for x in side}}
    one, two = count(a), count(b)
    both = sum(min(one[h], two[h]) for h in one.keys() & two.keys())
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def numbers(fingerprint):
    return [(int(x, 16) >> 32, int(x, 16) & 0xFFFFFFFF) for x in fingerprint.split(".") if x]


def store(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).selectExpr("*", "'x' AS _k", "1 AS own", "2 AS edited").write.parquet(f"{tmp_path}/documents.parquet")


def test_query_on_edge_rows(spark, tmp_path):
    store(spark, tmp_path, ROWS, "doc_id bigint, text string")
    found = op8_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == len(ROWS)
    keys = sorted({k for k, _ in ROWS if k is not None}, reverse=True) + [None]
    expected = {}
    for key, text in ROWS:
        text = text or ""
        following = [t or "" for k, t in ROWS if k == keys[(keys.index(key) + 1) % len(keys)]]
        cut = len(text) // 3
        edited = [text[: len(text) - cut] + t[:cut] for t in following]
        expected.setdefault(key, []).append((len(text), {hashlib.sha256(e.encode()).hexdigest() for e in edited}))
    for r in found:
        assert any(r.n_chars == n and r.edited_sha256 in e for n, e in expected[r.doc_id])
        # the printed anchors are what the likeness is taken from
        assert r.near_edited == pytest.approx(likeness(numbers(r.fingerprint), numbers(r.edited_fingerprint)))
        assert len(numbers(r.fingerprint)) == r.n_anchors
    of = {r.doc_id: r for r in found}
    assert of[7].fingerprint == of[8].fingerprint and of[7].n_anchors > 64 and of[8].near_next == 1.0


@pytest.mark.parametrize("schema, rows", [
    ("doc_id string, text string", [("b", "x y z"), ("a", "u v w"), (None, "t")]), ("doc_id bigint, text string", []), ("doc_id bigint, text string", [(None, "a b"), (None, "a b")]),
])
def test_query_on_other_keys_and_empty_tables(spark, tmp_path, schema, rows):
    store(spark, tmp_path, rows, schema)
    assert op8_fingerprints(spark, str(tmp_path)).count() == len(rows)


def test_texts_are_moved_to_their_key_and_to_their_neighbour_only(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = syncmers.with_edited(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # by key, read twice and run once; then the neighbours, which are joined to, and the next texts
    assert sum("REPARTITION_BY_COL" in line for line in lines) == 2 and sum("ENSURE_REQUIREMENTS" in line for line in lines) == 2


def test_syncmers_are_those_of_the_definition(spark):
    df = spark.createDataFrame([(LONG,), ("a b",), ("a b c",), ("d a b a d c",)], "t string")
    hashed = df.select(syncmers.word_hashes(F.col("t")).alias("h"))
    for r in hashed.select("h", syncmers.anchors(F.col("h")).alias("a")).collect():
        h, k = r.h, syncmers.WORDS
        chosen = [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])] if len(h) >= k else [0]
        assert [x.place for x in r.a] == chosen


def test_printed_anchors_can_be_read_again(spark):
    df = spark.createDataFrame([(t,) for _, t in ROWS], "t string")
    anchored = syncmers.add_anchors(df, {"a": "t"})
    rows = anchored.select("a", syncmers.parsed(syncmers.printed(F.col("a"))).alias("again"), syncmers.printed(F.col("a")).alias("p")).collect()
    assert all(r.a == r.again and re.fullmatch(r"([0-9A-F]+(\.[0-9A-F]+)*)?", r.p) for r in rows)


def test_clashes_are_refused(spark):
    df = spark.createDataFrame([("a b c", 1)], "t string, Own int")
    with pytest.raises(ValueError):
        syncmers.add_anchors(df, {"own": "t"})
    anchored = syncmers.add_anchors(df, {"a": "t"})
    with pytest.raises(ValueError):
        syncmers.match(anchored, {"OWN": ("a", "a")})
    assert syncmers.match(anchored.where("false"), {"m": ("a", "a")}).count() == 0
