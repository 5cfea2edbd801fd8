"""Checks of execution, handoffs and verification that go beyond one step or one run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import values
from tracewell.operators.handoff import handoff_diff
from tracewell.operators.ranking import dense_position, sliding
from tracewell.session import materialize

FAILED = ("FAILURE", "ERROR")
LEAST_CHECK = 20  # characters that a checker's answer should have
WINDOW = 5  # consecutive runs without a rejection that make a checker suspicious


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def step_checks(steps: DataFrame, checker: str, least: int = LEAST_CHECK) -> DataFrame:
    """One row per step and ``check`` that it fails; a filter, no shuffle.

    failed_step: status FAILURE or ERROR.  silent_failure: success with nothing put out.
    suspiciously_fast: an output in no time.  trivial_check: the checker's answer, where
    it gave one, has fewer than ``least`` characters.
    """
    empty = _text("raw_output") == ""
    found = {
        "failed_step": F.col("status").isin(*FAILED),
        "silent_failure": (F.col("status") == "SUCCESS") & empty,
        "suspiciously_fast": (F.col("latency_ms") == 0) & ~empty,
        "trivial_check": (F.col("agent") == checker) & ~empty & (F.length(_text("raw_output")) < least),
    }
    names = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in found.items())))
    return steps.withColumn("check", F.explode(names))


# ------------------------------------------------------------ links of steps


def chains(steps: DataFrame, name: str = "chains") -> DataFrame:
    """Where the parents of every step lead: run_id, step, parent_step, child_step, chain, end_step, hops, unlinked, dangling.

    ``chain`` is ``root`` if the parents lead to the run's first step, ``orphan`` if they
    end at a later step without a parent, ``missing`` if they end at a step whose parent
    does not exist, ``cycle`` if they never end; end_step and hops tell where and how far.
    ``unlinked``: the parent names another child.  ``dangling``: the child does not
    exist; the run's last step may name the one that never came.

    Pointer doubling: in each round every unsettled step takes over the pointer, or the
    end, of the step it points at, by an equi-join on (run, step).  Rounds grow with the
    logarithm of the longest run, steps settled in a round are written once, and no task
    walks a run.  Links that are no whole number count as null; of repeated (run, step)
    rows the smallest links count.
    """
    whole = lambda c: F.min(F.col(c).try_cast("bigint")).alias(c)
    links = steps.groupBy("run_id", F.col("step").cast("bigint").alias("step")).agg(whole("parent_step"), whole("child_step"))
    links = materialize(links, name)
    bounds = links.groupBy("run_id").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("n"))
    most = bounds.agg(F.max("n")).first()[0] or 0
    edges = bounds.select("run_id", F.col("first").alias("step"), F.lit(True).alias("is_first"), (F.col("last") == F.col("first")).alias("is_last"))
    edges = edges.unionByName(
        bounds.where("last > first").select("run_id", F.col("last").alias("step"), F.lit(False).alias("is_first"), F.lit(True).alias("is_last"))
    )
    parents = links.select("run_id", F.col("step").alias("parent_step"), F.col("child_step").alias("_named"), F.lit(True).alias("_parent"))
    children = links.select("run_id", F.col("step").alias("child_step"), F.lit(True).alias("_child"))
    known = links.join(edges, ["run_id", "step"], "left").join(parents, ["run_id", "parent_step"], "left").join(children, ["run_id", "child_step"], "left")
    orphan, first = F.col("parent_step").isNull(), F.coalesce("is_first", F.lit(False))
    chain = F.when(orphan & first, "root").when(orphan, "orphan").when(F.col("_parent").isNull(), "missing")
    begun = known.select(
        "run_id", "step", "parent_step", "child_step", chain.alias("chain"),
        F.coalesce(F.col("_parent") & ~F.col("_named").eqNullSafe(F.col("step")), F.lit(False)).alias("unlinked"),
        (F.col("child_step").isNotNull() & F.col("_child").isNull() & ~F.coalesce("is_last", F.lit(False))).alias("dangling"),
        F.when(chain.isNull(), F.col("parent_step")).alias("at"),
        F.when(chain.isNotNull(), F.col("step")).alias("end_step"),
        F.when(chain.isNull(), 1).otherwise(0).cast("bigint").alias("hops"),
    )
    begun = materialize(begun, name)
    settled, todo, reach = [begun.where("chain IS NOT NULL")], begun.where("chain IS NULL"), 1
    while reach < most:
        target = reduce(DataFrame.unionByName, [*settled, todo]).select(
            "run_id", F.col("step").alias("at"), F.col("chain").alias("_chain"), F.col("end_step").alias("_end"), F.col("hops").alias("_hops"), F.col("at").alias("_at")
        )
        moved = todo.drop("chain", "end_step").join(target, ["run_id", "at"]).select(
            *(F.col(c) for c in begun.columns if c not in ("chain", "at", "end_step", "hops")),
            F.col("_chain").alias("chain"), F.col("_at").alias("at"), F.col("_end").alias("end_step"), (F.col("hops") + F.col("_hops")).alias("hops"),
        )
        moved = materialize(moved, name)
        settled.append(moved.where("chain IS NOT NULL"))
        todo, reach = moved.where("chain IS NULL"), reach * 2
        if todo.isEmpty():
            break
    lost = todo.withColumns({"chain": F.lit("cycle"), "end_step": F.lit(None).cast("bigint"), "hops": F.lit(None).cast("bigint")})
    return reduce(DataFrame.unionByName, [*settled, lost]).drop("at")


# -------------------------------------------------------------- verification


def approval_streaks(checked: DataFrame, n: int = WINDOW) -> DataFrame:
    """Runs with how many of the last ``n`` runs of their workflow were rejected, and ``always_approves`` where none of ``n`` was.

    ``checked`` has run_id, workflow, timestamp and approved, one row per run with a check;
    runs follow each other by time, then id.  A null verdict counts as a rejection.
    """
    rejected = F.when(F.coalesce("approved", F.lit(False)), 0).otherwise(1)
    found = sliding(
        checked, ["workflow"], ["timestamp", "run_id"], n,
        {"window_runs": F.count(F.lit(1)), "rejections": F.sum(rejected)},
    )
    return found.withColumn("always_approves", (F.col("window_runs") == n) & (F.col("rejections") == 0))


def circular_checks(steps: DataFrame, checker: str) -> DataFrame:
    """(run_id, pos, previous_pos) of checker steps whose input is what the same agent put out before.

    The agent's steps are numbered inside each run, and each meets the one before by an
    equi-join, so no run is gathered.  Digests are compared first; only where they agree do
    the whole texts travel.  Null and empty inputs are no reference to anything.
    """
    digest = lambda c: F.unhex(F.sha2(F.col(c), 256))
    own = steps.where(F.col("agent") == checker)
    told = own.select("run_id", "pos", digest("raw_input").alias("given"), digest("raw_output").alias("made"), (F.col("raw_input") != "").alias("asks"))
    placed = materialize(dense_position(told, ["run_id"], ["pos"], out="nth"), "checker-steps")
    before = placed.select("run_id", (F.col("nth") + 1).alias("nth"), F.col("pos").alias("previous_pos"), F.col("made").alias("before"))
    same = placed.join(before, ["run_id", "nth"]).where("asks AND given = before").select("run_id", "pos", "previous_pos")
    texts = own.select("run_id", "pos", "raw_input", "raw_output")
    given = same.join(texts.drop("raw_output"), ["run_id", "pos"])
    made = texts.select("run_id", F.col("pos").alias("previous_pos"), "raw_output")
    return given.join(made, ["run_id", "previous_pos"]).where("raw_input = raw_output").select("run_id", "pos", "previous_pos")


# ------------------------------------------------------------------ handoffs


def handoff_contracts(steps: DataFrame, contracts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Steps that are followed by another, with what their handoff loses.

    ``contracts`` lists for each agent the keys it needs.  The next step of the run is
    found by an equi-join on (run, position).  missing_keys: needed by the next agent,
    absent or empty in what the step put out; dropped_keys and shrunk: keys of the input
    that are gone, and fewer keys than before; mutated_keys: changed although the step
    recorded no filtering.  All are arrays in key order, inside the row.
    """
    following = steps.select("run_id", (F.col("pos") - 1).alias("pos"), F.col("agent").alias("next_agent"))
    entries = [x for agent, keys in contracts.items() for x in (F.lit(agent), F.array(*map(F.lit, keys)).cast("array<string>"))]
    needed = F.try_element_at(F.create_map(*entries), F.col("next_agent")) if entries else F.lit(None)
    needed = F.coalesce(needed, F.array().cast("array<string>"))
    filled = lambda state: F.filter(F.map_keys(state), lambda k: ~values.is_empty(F.try_element_at(state, k)))
    unfiltered = F.size(F.map_keys(F.coalesce("filtered_state", F.create_map().cast("map<string,string>")))) == 0
    found = handoff_diff(steps).join(following, ["run_id", "pos"])
    return found.withColumns({
        "missing_keys": F.array_sort(F.array_except(needed, filled(F.col("output_state")))),
        "shrunk": F.size(filled(F.col("output_state"))) < F.size(filled(F.col("input_state"))),
        "mutated_keys": F.when(unfiltered, F.col("modified_keys")).otherwise(F.array().cast("array<string>")),
    })
