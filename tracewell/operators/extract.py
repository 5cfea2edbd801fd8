"""Evidence counts of each step, from responses, step output or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import text, values

EMPTY_OUTPUT = "Empty output — nothing to extract"  # fixed value
_LISTS = ("tool_calls", "claims", "references", "numbers", "dates")


def requests(steps: DataFrame, max_chars: int | None = None) -> DataFrame:
    """What an extracting model is shown: outputs with content, cut to its input limit if it has one."""
    return steps.where(text.strip(F.col("raw_output")) != "").select(
        "run_id", "pos", "step", "agent", text.leading(F.col("raw_output"), max_chars).alias("request")
    )


def _evidence(steps: DataFrame, failed: Column, message: Column, counts: dict[str, Column], cost: Column) -> DataFrame:
    """Typed evidence rows; a failed extraction has zero counts and empty lists."""
    nothing = F.array().cast("array<string>")
    zero = F.lit(0)
    judged = steps.withColumns({"_failed": failed, "_message": message})
    bad = F.col("_failed")
    numbers = {c: (counts[c].cast("int"), zero) for c in ("source_count", "entity_count")}
    lists = {c: (counts.get(c, nothing), nothing) for c in _LISTS}
    tokens = {"token_cost": (cost, zero.cast("bigint"))}

    def usable(value: Column, default: Column) -> Column:
        return F.when(bad, default).otherwise(F.coalesce(value, default))

    return judged.select(
        "run_id",
        "pos",
        "step",
        "agent",
        *(usable(*v).alias(c) for c, v in {**numbers, **lists}.items()),
        bad.alias("extraction_failed"),
        F.col("_message").alias("error_message"),
        *(usable(*v).alias(c) for c, v in tokens.items()),
    )


def _response_count(members: Column, name: str) -> Column:
    """Whole number of a response member: 0 when absent, null when unusable."""
    raw = F.try_element_at(members, F.lit(name))
    number = (
        F.when(raw.isin("true", "false"), (raw == "true").cast("int"))
        .when(raw.startswith('"'), text.strip(values.string_value(raw)).try_cast("int"))
        .otherwise(raw.try_cast("double").try_cast("int"))
    )
    count = F.when(raw.isNull(), F.lit(0)).otherwise(number)
    return F.when(count >= 0, count)


def parse_responses(steps: DataFrame) -> DataFrame:
    """Typed evidence from stored extraction responses.

    ``steps`` needs run_id, pos, step, agent, raw_output, response (JSON text) and
    response_tokens.  Steps without output, responses that are not a JSON object,
    and counts that are not whole numbers from 0 on make the extraction failed.
    """
    parsed = (
        steps.withColumn("_m", values.parse_object(F.col("response")))
        .withColumn("_source", _response_count(F.col("_m"), "source_count"))
        .withColumn("_entity", _response_count(F.col("_m"), "entity_count"))
        .withColumn("_r", F.from_json("response", schema.EXTRACTION_RESPONSE))
    )
    empty = text.strip(F.coalesce("raw_output", F.lit(""))) == ""
    unreadable = F.col("_m").isNull()
    bad_count = F.col("_source").isNull() | F.col("_entity").isNull()
    message = (
        F.when(empty, F.lit(EMPTY_OUTPUT))
        .when(unreadable, F.lit("JSONDecodeError: response is not a JSON object"))
        .when(bad_count, F.lit("ValueError: counts must be whole numbers from 0 on"))
    )
    counts = {c: F.col(f"_r.{c}") for c in _LISTS}
    counts |= {"source_count": F.col("_source"), "entity_count": F.col("_entity")}
    return _evidence(parsed, empty | unreadable | bad_count, message, counts, F.col("response_tokens"))


def counts_from_output(steps: DataFrame) -> DataFrame:
    """Counts the agents themselves put into their JSON output."""
    read = steps.withColumn("_o", values.parse_state(F.col("raw_output")))
    empty = text.strip(F.col("raw_output")) == ""
    counts = {c: F.try_element_at("_o", F.lit(c)).try_cast("int") for c in ("source_count", "entity_count")}
    counts["tool_calls"] = F.transform("tool_calls", lambda c: c["name"])
    return _evidence(read, empty, F.when(empty, F.lit(EMPTY_OUTPUT)), counts, F.lit(0).cast("bigint"))


def counts_from_sections(steps: DataFrame, text_column: str = "raw_output") -> DataFrame:
    """Counts from sectioned research text, with the field lists of the whole text."""
    body = F.col(text_column)
    sources, entities = text.section_counts(body)
    empty = text.strip(body) == ""
    counts = {
        "source_count": sources,
        "entity_count": entities,
        "claims": text.claims(body),
        "references": text.found(body, text.REFERENCE, None),
        "numbers": text.found(body, text.NUMBER),
        "dates": text.found(body, text.DATE),
    }
    return _evidence(steps, empty, F.when(empty, F.lit(EMPTY_OUTPUT)), counts, F.lit(0).cast("bigint"))


def token_cost(extracted: DataFrame, *keys: str) -> DataFrame:
    """Extraction tokens per run, agent or both."""
    return extracted.groupBy(*keys).agg(F.sum("token_cost").alias("token_cost"))


def latest_per_agent(extracted: DataFrame) -> DataFrame:
    """The extraction of each agent's last step in every run.

    All buffers are numbers, so this stays a hash aggregation with map-side
    combine however many steps a run has.
    """
    fields = ("step", "source_count", "entity_count", "extraction_failed")
    return extracted.groupBy("run_id", "agent").agg(*(F.max_by(c, "pos").alias(c) for c in fields))


def checker_approval(steps: DataFrame) -> DataFrame:
    out = F.col("raw_output")
    return steps.select(
        "run_id",
        "step",
        text.strip(out).alias("verification_result"),
        text.approved(out).alias("verified"),
        text.revision_notes(out).alias("revision_notes"),
    )
