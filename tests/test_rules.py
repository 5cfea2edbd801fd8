"""Rules, information loss, ground truth, extraction and verdict resolution."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import Config
from tracewell.functions import similarity, text
from tracewell.operators import arbiter, explain, extract, rules

PROFILE = (
    "run_id string, up_sources int, up_entities int, up_failed boolean, up_step bigint, "
    "down_sources int, down_entities int, down_failed boolean, down_step bigint, "
    "check_sources int, check_entities int, check_failed boolean, check_step bigint"
)


def counts_row(run_id, up=None, down=None, check=None):
    """(sources, entities, failed) per role; a role left out never ran."""
    out = [run_id]
    for number, role in enumerate((up, down, check), 1):
        out += [*role, number] if role else [None] * 4
    return tuple(out)


def expected_loss(up, down):
    """Plain-Python statement of the rule."""
    if up[2] or down[2]:
        return "PASS", 0.0
    deltas = [(down[i] - up[i], up[i]) for i in (0, 1)]
    if any(d <= -3 for d, _ in deltas):
        verdict = "FAIL"
    elif any(d != 0 for d, _ in deltas):
        verdict = "WARNING"
    else:
        return "PASS", 1.0
    ratio = sum(abs(d) / max(base, 1) for d, base in deltas) / 2
    low, slope, high = (0.80, 0.19, 0.99) if verdict == "FAIL" else (0.60, 0.24, 0.84)
    return verdict, min(high, max(low, low + ratio * slope))


def test_information_loss_against_plain_python(spark):
    values = [0, 1, 4, 8, 9, 30]
    pairs = list(itertools.product(values, values, values, values))
    rows, expected = [], {}
    for n, (us, ue, ds, de) in enumerate(pairs):
        up, down = (us, ue, n % 50 == 7), (ds, de, n % 41 == 3)
        rows.append(counts_row(f"r{n}", up, down))
        expected[f"r{n}"] = expected_loss(up, down)
    rows.append(counts_row("alone", (1, 1, False)))
    found = rules.information_loss(spark.createDataFrame(rows, PROFILE)).collect()
    assert len(found) == len(pairs)
    for row in found:
        verdict, confidence = expected[row.run_id]
        assert row.verdict == verdict
        assert row.confidence == pytest.approx(confidence, abs=1.0001e-4)
        assert row.rule_failed == (confidence == 0.0)


def test_loss_summary_text(spark):
    df = spark.createDataFrame([counts_row("r", (8, 10, False), (4, 12, False))], PROFILE)
    row = rules.information_loss(df).first()
    assert row.summary == (
        "Verdict: FAIL\n  source_count: 8 → 4 (DROPPED 4, severity=HIGH)\n"
        "  entity_count: 10 → 12 (ADDED 2, severity=MEDIUM)"
    )
    assert (row.has_information_loss, row.has_information_gain) == (True, True)
    evidence = rules.emit(df, rules.loss_findings()).first()
    assert (evidence.category, evidence.severity, evidence.agent, evidence.value) == ("workflow", "high", "writer", "FAIL")
    assert evidence.evidence_detail == row.summary and evidence.confidence == row.confidence


@pytest.mark.parametrize(
    "up, down, check, fired",
    [
        ((0, 5, False), (0, 5, False), None, {"researcher_quality_v1"}),
        ((3, 5, False), (3, 9, False), None, {"hallucination_v1"}),
        ((3, 5, False), (3, 9, False), (3, 9, False), {"hallucination_v1", "verifier_passthrough_v1"}),
        ((3, 5, False), (3, 9, False), (3, 5, False), {"hallucination_v1"}),
        ((3, 5, True), (3, 9, False), (3, 9, False), set()),
        ((3, 5, False), (3, 9, True), (3, 9, False), set()),
        (None, (3, 9, False), (3, 9, False), set()),
        ((0, 5, True), None, None, set()),
        ((3, 5, False), (3, 4, False), (3, 4, False), set()),
    ],
)
def test_count_rules(spark, up, down, check, fired):
    df = spark.createDataFrame([counts_row("r", up, down, check)], PROFILE)
    assert {r.rule_id for r in rules.emit(df, rules.counts_findings()).collect()} == fired


@pytest.mark.parametrize(
    "agents, fired",
    [
        (["researcher", "writer", "verifier"], []),
        (["writer", "researcher", "verifier"], [("wrong_order_v1", "writer", 1)]),
        (["verifier", "writer", "researcher"], [("wrong_order_v1", "writer", 2), ("wrong_order_v1", "verifier", 1)]),
        (["researcher", "verifier"], [("skipped_step_v1", "writer", None)]),
        (["x"], [("skipped_step_v1", a, None) for a in ("researcher", "writer", "verifier")]),
        (["researcher", "writer", "researcher", "verifier", "writer"], []),
        (["x", "verifier", "researcher", "writer"], [("wrong_order_v1", "verifier", 2)]),
    ],
)
def test_workflow_rules(spark, agents, fired):
    # step numbers differ from list positions on purpose
    rows = [("r", pos, 10 * pos + 5, agent) for pos, agent in enumerate(agents)]
    steps = spark.createDataFrame(rows, "run_id string, pos bigint, step bigint, agent string")
    found = rules.emit(rules.profile(steps), rules.workflow_findings()).orderBy("rule_id", "emit_seq").collect()
    assert [(r.rule_id, r.agent, r.step) for r in found] == fired


PAIRS = [
    ("tide", "diet"), ("diet", "tide"), ("", "x"), ("same", "same"), ("abc" * 120, "x" + "abc" * 120),
    ("The quick brown fox", "the quick brown cat"), ("häuser", "hauser"), ("a" * 300, "a" * 150 + "b" * 150),
]


@pytest.mark.parametrize("autojunk", [True, False])
def test_similarity_is_the_stdlib_ratio(spark, autojunk):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    found = df.select("a", "b", similarity.sequence_ratio(F.col("a"), F.col("b"), autojunk).alias("s")).collect()
    for row in found:
        assert row.s == pytest.approx(difflib.SequenceMatcher(None, row.a, row.b, autojunk=autojunk).ratio())


def test_ground_truth_rule(spark):
    runs = spark.createDataFrame(
        [("hit", "the expected text"), ("same", "equal"), ("none", None), ("blank", ""), ("idle", "x")],
        "run_id string, expected_output string",
    )
    steps = spark.createDataFrame(
        [("hit", 0, "a", "the expected text"), ("hit", 1, "b", "something else"), ("same", 0, "a", "equal"),
         ("none", 0, "a", "x"), ("blank", 0, "a", "x")],
        "run_id string, pos bigint, agent string, raw_output string",
    )
    compared = rules.ground_truth(runs, rules.final_outputs(steps))
    assert {r.run_id for r in compared.collect()} == {"hit", "same"}
    evidence = rules.ground_truth_evidence(compared).collect()
    ratio = difflib.SequenceMatcher(None, "the expected text", "something else").ratio()
    assert [(r.run_id, r.agent, r.severity, r.step) for r in evidence] == [("hit", "b", "critical", None)]
    assert evidence[0].confidence == pytest.approx(1 - ratio)
    assert evidence[0].rule_description.endswith(f"Similarity: {ratio:.2f} (Threshold: 0.85)")
    status = rules.analyzer_status(runs, rules.profile(steps)).where("skipped").collect()
    assert {(r.run_id, r.analyzer_id, r.skip_reason) for r in status} == {
        ("none", "ground_truth_validator", rules.NO_EXPECTED), ("blank", "ground_truth_validator", rules.NO_EXPECTED),
        ("idle", "ground_truth_validator", rules.NO_STEPS_PRESENT), ("idle", "rule_engine", rules.NO_STEPS),
        ("idle", "workflow_validator", rules.NO_STEPS),
    }


# ------------------------------------------------------------------- arbiter


def evidence_frame(spark, rows):
    """rows: (run_id, source, rule_id, category, agent, confidence)"""
    columns = [c for c, _ in schema.EVIDENCE_COLUMNS]
    full = []
    for n, (run_id, source, rule_id, category, agent, confidence) in enumerate(rows):
        values = dict.fromkeys(columns) | {
            "run_id": run_id, "source": source, "rule_id": rule_id, "category": category, "agent": agent,
            "confidence": confidence, "analyzer_ord": 1, "emit_idx": 0, "description": f"finding {n} " + "d" * 200,
            "severity": "high",
        }
        full.append(tuple(values.values()))
    ddl = schema.ddl(schema.EVIDENCE_COLUMNS).replace("emit_seq decimal(38,0)", "emit_seq bigint")
    df = spark.createDataFrame(full, ddl)
    return df.withColumn("emit_seq", F.lit(0).cast("decimal(38,0)"))


def resolve_one(spark, *rows):
    runs = spark.createDataFrame([("r",)], "run_id string")
    return arbiter.resolve(runs, evidence_frame(spark, [("r", *row) for row in rows])).first()


def test_priorities(spark):
    gt = ("ground_truth", "gt_mismatch_v1", "reasoning", "writer", 0.625)
    rule = ("rule_engine", "b_rule", "execution", "researcher", 1.0)
    flow = ("workflow_validator", "a_rule", "reasoning", "verifier", 0.9)
    other = ("consistency_validator", "a_rule", "workflow", "x", 1.0)
    stat = ("metrics_analyzer", None, None, "x", 1.0)
    row = resolve_one(spark, stat, other, flow, rule, gt)
    assert (row.priority_level, row.primary_cause, row.primary_agent, row.grounded) == ("P1", "reasoning", "writer", True)
    assert row.summary == "P1 ground truth mismatch: gt_mismatch_v1 (confidence=62%)"
    row = resolve_one(spark, stat, other, flow, rule)
    assert (row.priority_level, row.primary_cause, row.grounded) == ("P2", "execution", False)
    row = resolve_one(spark, stat, other, flow)
    # the cause of a workflow verdict is always workflow
    assert (row.priority_level, row.primary_cause, row.primary_agent) == ("P3", "workflow", "verifier")
    row = resolve_one(spark, stat, other)
    assert (row.priority_level, row.primary_cause, row.primary_agent) == ("P5", "unknown", None)
    assert row.summary == "No P2 rule matched — P5 fallback." and row.evidence_count == 2
    row = arbiter.resolve(spark.createDataFrame([("r",)], "run_id string"), evidence_frame(spark, [])).first()
    assert (row.priority_level, row.summary, row.evidence_count) == ("P5", "No evidence collected — P5 fallback.", 0)


def test_lowest_rule_id_wins_and_findings_without_rule_come_last(spark):
    row = resolve_one(
        spark,
        ("rule_engine", None, "execution", "x", 1.0),
        ("rule_engine", "rule_b", "execution", "b", 1.0),
        ("rule_engine", "rule_a", "reasoning", "a", 0.5),
    )
    assert (row.deciding_rule, row.primary_agent, row.rule_count) == ("rule_a", "a", 2)
    row = resolve_one(spark, ("rule_engine", None, None, "x", 1.0))
    assert (row.primary_cause, row.summary) == ("unknown", "P2 rule match: unknown (confidence=100%)")


def test_parts_keep_all_findings(spark):
    rows = [("big", "rule_engine", f"rule_{n:03d}", "execution", "a", 1.0) for n in range(25)]
    rows += [("small", "workflow_validator", "w", "workflow", "b", 1.0)]
    evidence = evidence_frame(spark, rows).repartition(5)
    runs = spark.createDataFrame([("big",), ("small",), ("none",)], "run_id string")
    verdicts = arbiter.resolve(runs, evidence)
    prompts = {(r.run_id, r.part): r.prompt for r in explain.prompts(verdicts, evidence, chunk=10).collect()}
    assert set(prompts) == {("big", 0), ("big", 1), ("big", 2), ("small", 0), ("none", 0)}
    joined = "\n".join(prompts[("big", p)] for p in range(3))
    assert all(f"  [{n + 1}] rule=rule_{n:03d}  confidence=100%  description=" in joined for n in range(25))
    assert "d" * 121 in joined
    short = explain.prompts(verdicts, evidence, chunk=10, max_chars=120)
    assert all("d" * 121 not in r.prompt for r in short.collect())
    assert "  (none)" in prompts[("none", 0)] and "primary_agent  : unknown" in prompts[("none", 0)]
    bundles = arbiter.bundles(runs, evidence, 10).collect()
    assert sum(len(r.evidence or []) for r in bundles if r.run_id == "big") == 25
    first = next(r for r in bundles if r.run_id == "big" and r.part == 0)
    assert [e.evidence_no for e in first.evidence] == list(range(1, 11))


def test_explanations(spark):
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    evidence = evidence_frame(spark, [("r", "rule_engine", "x_v1", "execution", "tooler", 1.0)])
    found = {r.run_id: r for r in explain.explain_fallback(arbiter.resolve(runs, evidence)).collect()}
    assert found["r"].summary == (
        "[Fallback — LLM unavailable] The P2 analysis may indicate a execution issue attributed to tooler. "
        "Rule 'x_v1' fired during the Arbiter evaluation."
    )
    assert found["r"].suggested_fix == "Investigate tooler for tool errors, timeouts, or missing outputs."
    assert "attributed to an agent. Rule 'unknown rule'" in found["q"].summary


# ----------------------------------------------------------------- extraction


def test_responses(spark):
    cases = {
        '{"source_count": 3, "entity_count": "4", "numbers": ["7"]}': (3, 4, False),
        '{"source_count": 2.9}': (2, 0, False), "[]": (0, 0, True), "oops": (0, 0, True), "{}": (0, 0, False),
        '{"source_count": -1}': (0, 0, True), '{"source_count": null}': (0, 0, True), '{"entity_count": "many"}': (0, 0, True),
        None: (0, 0, True),
    }
    rows = [("r", n, n, "a", "out", reply, 9) for n, reply in enumerate(cases)]
    rows.append(("r", 99, 99, "a", " \n ", '{"source_count": 3}', 9))
    df = spark.createDataFrame(
        rows, "run_id string, pos bigint, step bigint, agent string, raw_output string, response string, response_tokens bigint"
    )
    found = {r.step: r for r in extract.parse_responses(df).collect()}
    for n, expected in enumerate(cases.values()):
        assert (found[n].source_count, found[n].entity_count, found[n].extraction_failed) == expected, list(cases)[n]
    assert found[99].error_message == extract.EMPTY_OUTPUT and found[99].token_cost == 0
    assert found[0].numbers == ["7"] and found[0].token_cost == 9


@pytest.mark.parametrize(
    "body, expected",
    [
        ("SOURCES:\n- a\n- b\nENTITIES:\n- c\nKEY FINDINGS:\n- d\n- e", (2, 1)),
        ("SOURCES:\n- a\n- b", (2, 0)), ("ENTITIES:\n- c\n- d", (0, 0)), ("KEY FINDINGS:\n- x\nENTITIES:\n- y", (1, 0)),
        ("", (0, 0)),
    ],
)
def test_section_counts(spark, body, expected):
    df = spark.createDataFrame([(body,)], "t string")
    sources, entities = text.section_counts(F.col("t"))
    assert tuple(df.select(sources, entities).first()) == expected


def test_jaccard(spark):
    rows = [("a b c", "b c d", 0.5), ("", "a", 0.0), ("a", None, 0.0), (" ", "\t", 1.0), ("x x", "x", 1.0), ("a b", "b a", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, e double")
    for r in df.select("e", text.jaccard(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(r.e)


@pytest.mark.parametrize("said, ok", [("  Approved, fine", True), ("APPROVED", True), ("\n\tapproved", True), ("Not approved", False), ("", False)])
def test_approval(spark, said, ok):
    df = spark.createDataFrame([("r", 1, said)], "run_id string, step bigint, raw_output string")
    row = extract.checker_approval(df).first()
    assert (row.verified, row.revision_notes) == (ok, "" if ok else said.strip())


def test_loss_evidence_names_the_configured_roles(spark):
    talk = Config(required_agents=("user", "assistant"), upstream="user", downstream="assistant", checker="judge")
    rows = [("r", 0, 1, "user", 8, 10, False), ("r", 1, 2, "assistant", 2, 3, False)]
    steps = spark.createDataFrame(
        rows, "run_id string, pos bigint, step int, agent string, source_count int, entity_count int, extraction_failed boolean"
    )
    found = rules.emit(rules.profile(steps, steps, talk), rules.loss_findings(talk)).first()
    assert found.agent == "assistant" and "User → Assistant" in found.description


def test_findings_of_own_analyzers_take_any_name(spark):
    frame = spark.createDataFrame([("r",)], "run_id string")
    own = rules.Finding("true", "own_checks", "own_v1", "execution", {"description": "'seen'"})
    row = rules.emit(frame, [own]).first()
    assert (row.source, row.rule_id, row.description) == ("own_checks", "own_v1", "seen")
