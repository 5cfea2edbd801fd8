"""JSON values, states, timestamps, constraints."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import text, values
from tracewell.operators import handoff, normalize
from tracewell.sources import traces


def one(spark, column, **row):
    ddl = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], ddl).select(column.alias("v")).first().v


@pytest.mark.parametrize("value", [None, "", 0, 0.0, [], {}, False])
def test_empty(spark, value):
    assert one(spark, values.is_empty(F.to_json(F.try_parse_json("j"))), j=json.dumps(value))


@pytest.mark.parametrize("value", [True, 1, -0.5, "x", "0", " ", [None], ["x"], {"a": None}])
def test_not_empty(spark, value):
    assert not one(spark, values.is_empty(F.to_json(F.try_parse_json("j"))), j=json.dumps(value))


@pytest.mark.parametrize(
    "given, expected",
    [
        ('{"a": 1.0, "b": {"y": 1, "x": 2}}', {"a": "1", "b": '{"x":2,"y":1}'}),
        (' {"a": null}\n', {"a": "null"}),
        ("[1, 2]", {}), ('"text"', {}), ("not json", {}), ("{broken", {}), ("", {}), (None, {}),
    ],
)
def test_parse_state(spark, given, expected):
    assert one(spark, values.parse_state(F.col("j")), j=given) == expected


@pytest.mark.parametrize(
    "state, raw, expected",
    [
        (None, '{"r": 1}', {"r": "1"}), ("", '{"r": 1}', {"r": "1"}), ("{ }", '{"r": 1}', {"r": "1"}),
        ("[]", '{"r": 1}', {"r": "1"}), ("[1]", '{"r": 1}', {}), ("words", '{"r": 1}', {}),
        ('{"s": 2}', '{"r": 1}', {"s": "2"}), ("{}", None, {}),
    ],
)
def test_state_falls_back_to_raw_text(spark, state, raw, expected):
    assert one(spark, values.state_or_raw(F.col("s"), F.col("r")), s=state, r=raw) == expected


@pytest.mark.parametrize(
    "given, expected",
    [('{"a": [1, 2]}', '{"a":[1,2]}'), (" [1] ", "[1]"), ("{oops", '"{oops"'), ("plain", '"plain"'), ("12", '"12"')],
)
def test_safe_loads(spark, given, expected):
    assert one(spark, values.safe_dumps(values.safe_loads(F.col("j"))), j=given) == expected


def test_merge_keeps_returned_nulls(spark):
    merged = values.merge_state(values.parse_state(F.col("a")), values.parse_state(F.col("b")))
    assert one(spark, merged, a='{"x": 1, "y": 2}', b='{"y": null, "z": 3}') == {"x": "1", "y": "null", "z": "3"}


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2026-01-02T03:04:05", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05+02:00", "2026-01-02 01:04:05"),
        ("2026-01-02T03:04:05.250000+00:00", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"),
        ("2026-01-02 03:04:05", "2026-01-02 03:04:05"), ("2026-01-02", "2026-01-02 00:00:00"),
        ("yesterday", "1970-01-01 00:00:00"), ("", "1970-01-01 00:00:00"), (None, "1970-01-01 00:00:00"),
    ],
)
def test_timestamps(spark, given, expected):
    now = F.timestamp_seconds(F.lit(0))
    assert one(spark, text.format_utc(values.to_utc_timestamp(F.col("t"), now)), t=given) == expected


@pytest.mark.parametrize("given, expected", [("error", "ERROR"), ("Skipped", "SKIPPED"), ("odd", "SUCCESS"), (None, "SUCCESS")])
def test_status(spark, given, expected):
    assert one(spark, values.one_of(F.col("s"), schema.STEP_STATUS, "SUCCESS"), s=given) == expected


def test_token_total(spark):
    df = spark.createDataFrame([(1, 2, 0), (1, 2, 9), (0, 0, 0), (None, 4, None)], "p long, c long, t long")
    found = df.select(values.token_total(F.col("p"), F.col("c"), F.col("t")).alias("v")).collect()
    assert [r.v for r in found] == [3, 9, 0, 4]


@pytest.mark.parametrize(
    "given, expected", [(850.9, "850ms"), (1000.0, "1.0s"), (2540.0, "2.5s"), (0.0, "0ms"), (61234.0, "61.2s")]
)
def test_format_ms(spark, given, expected):
    df = spark.createDataFrame([(given,)], "ms double")
    assert df.select(text.format_ms(F.col("ms")).alias("v")).first().v == expected


def test_quarantine(spark):
    rows = [(1, 0.5, 2, "SUCCESS"), (2, 1.5, 2, "SUCCESS"), (3, None, -1, "LATE")]
    df = spark.createDataFrame(rows, "id int, confidence double, source_count int, status string")
    good, bad = normalize.quarantine(df)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.violations for r in bad.collect()} == {2: ["confidence"], 3: ["source_count", "status"]}


def test_tool_calls_read_result_when_output_is_missing(spark):
    calls = [
        {"name": "a", "output": "fine", "error": None}, {"name": "b", "result": "Error: x"},
        {"name": "c", "output": {"deep": "Error: x"}}, {"name": "d", "output": "", "result": None, "error": ""},
        {"name": "e", "output": {}}, {"name": "f", "error": "boom"},
    ]
    doc = json.dumps({"run_id": "r", "steps": [{"step": 1, "agent": "x", "tool_calls": calls}]})
    docs = traces.parse_traces(spark.createDataFrame([(doc,), ("nonsense",), (None,)], "trace_json string"))
    found = normalize.normalize_steps(docs).first().tool_calls
    assert [(c.name, c.output_text, c.has_output, c.has_error) for c in found] == [
        ("a", "fine", True, False), ("b", "Error: x", True, False), ("c", None, True, False),
        ("d", "", False, False), ("e", None, False, False), ("f", None, False, True),
    ]


def _expected_diff(before: dict, after: dict) -> dict:
    def empty(v):
        return v is None or v == "" or v == [] or v == {} or v is False or (not isinstance(v, bool) and v == 0)

    kinds = {"added": [], "modified": [], "unchanged": [], "dropped": []}
    for key in sorted(before.keys() | after.keys()):
        b, a = before.get(key), after.get(key)
        if empty(b) and empty(a):
            continue
        kind = "added" if empty(b) else "dropped" if empty(a) else "unchanged" if a == b else "modified"
        kinds[kind].append(key)
    return kinds


CASES = [
    ({"a": 1, "b": "x", "c": [1], "d": {}}, {"a": 1.0, "b": "", "c": [2], "d": {"k": 1}}),
    ({}, {"n": 0, "s": "0", "f": False, "t": True}),
    ({"n": 5, "o": {"x": 1, "y": 2}}, {"o": {"y": 2, "x": 1}}),
    ({"z": None, "l": []}, {"z": "", "l": {}}),
    ({"é": "ü", "q'": 'quote"'}, {"é": "ü", "q'": 'quote"s'}),
]


@pytest.mark.parametrize("before, after", CASES)
def test_handoff_diff(spark, before, after):
    df = spark.createDataFrame([(json.dumps(before), json.dumps(after))], "b string, a string")
    df = df.select(values.parse_state(F.col("b")).alias("input_state"), values.parse_state(F.col("a")).alias("output_state"))
    found = handoff.handoff_diff(df).first()
    expected = _expected_diff(before, after)
    assert {k: found[f"{k}_keys"] for k in expected} == expected
    assert found.has_information_loss == bool(expected["dropped"])
    assert found.total_changes == sum(len(expected[k]) for k in ("added", "modified", "dropped"))
    parts = [f"{label}={expected[k]}" for label, k in (("added", "added"), ("modified", "modified"), ("DROPPED", "dropped")) if expected[k]]
    if not any("'" in k for k in before | after):
        assert found.handoff_summary == (", ".join(parts) or "no changes")


def test_the_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2, "a": 3}',)], "s string")
    assert df.select(values.parse_state(F.col("s"))).first()[0] == {"a": "3", "b": "2"}
