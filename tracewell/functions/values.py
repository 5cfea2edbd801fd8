"""JSON values as columns: safe parsing, state maps, emptiness, equality.

A state is carried as ``MAP<STRING, STRING>`` from key to the *canonical JSON
text* of the value.  Canonical text keeps ``0`` and ``"0"`` apart, prints
``1`` and ``1.0`` alike and sorts object keys, so string equality on it is value
equality.  (``true`` and ``1`` stay different.)
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import strip

STATE = "map<string,string>"

# Canonical texts that count as "no content".
EMPTY_TEXTS = ("null", '""', "[]", "{}", "false")
BLANK_STATE = r"^(\{\s*\}|\[\s*\]|\"\"|null|false|-?0(\.0+)?([eE][+-]?[0-9]+)?)?$"
ZERO = r"^-?0(\.0+)?([eE][+-]?[0-9]+)?$"


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def safe_loads(text: Column) -> Column:
    """VARIANT of a JSON object or array; any other text stays a string."""
    trimmed = strip(text)
    parsed = F.when(trimmed.rlike(r"^[\{\[]"), F.try_parse_json(trimmed))
    return F.coalesce(parsed, text.cast("variant"))


def safe_dumps(value: Column) -> Column:
    return F.to_json(value)


def is_empty(json_text: Column) -> Column:
    """Missing, null, "", [], {}, numeric zero and false are empty."""
    return json_text.isNull() | json_text.isin(*EMPTY_TEXTS) | json_text.rlike(ZERO)


def no_state() -> Column:
    return F.create_map().cast(STATE)


def parse_object(text: Column) -> Column:
    """Canonical members of JSON object text; null for anything else.

    Of a repeated key the last value counts, for which the session has to allow them.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    trimmed = strip(text)
    members = F.when(trimmed.startswith("{"), F.try_parse_json(trimmed)).cast("map<string,variant>")
    return F.transform_values(members, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def parse_state(text: Column) -> Column:
    """Canonical state map of JSON object text; an empty map for anything else."""
    return F.coalesce(parse_object(text), no_state())


def state_or_raw(state: Column, raw: Column) -> Column:
    """The handoff state, or the raw text parsed when the state holds nothing.

    Text that is not JSON at all is content, and parses to an empty state.
    """
    given = F.coalesce(strip(state), F.lit(""))
    return parse_state(F.when(given.rlike(BLANK_STATE), raw).otherwise(given))


def merge_state(before: Column, returned: Column) -> Column:
    """``before`` overridden by every key present in ``returned``."""
    kept = F.map_filter(before, lambda k, _: ~F.map_contains_key(returned, k))
    return F.map_concat(kept, returned)


def string_value(json_text: Column) -> Column:
    """Display text of a canonical value: strings without their quotes."""
    return F.when(json_text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")).otherwise(json_text)


def state_text(state: Column, key: str) -> Column:
    """Non-empty member of a state as text, else null."""
    member = F.try_element_at(state, F.lit(key))
    return F.when(~is_empty(member), string_value(member))


def to_utc_timestamp(text: Column, now: Column | None = None) -> Column:
    """ISO text to TIMESTAMP; text without a zone is UTC, unreadable text is now."""
    text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text)
    zoned = F.when(
        text.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$") | ~text.rlike(r"[0-9]:[0-9]"), text
    ).otherwise(F.concat(text, F.lit("+00:00")))
    return F.coalesce(F.try_to_timestamp(zoned), F.current_timestamp() if now is None else now)


def one_of(text: Column, domain: tuple[str, ...], fallback: str) -> Column:
    upper = F.upper(text)
    return F.when(upper.isin(*domain), upper).otherwise(F.lit(fallback))


def token_total(prompt: Column, completion: Column, total: Column) -> Column:
    """Missing total is the sum of its parts."""
    p, c, t = (F.coalesce(x, F.lit(0).cast("bigint")) for x in (prompt, completion, total))
    return F.when((t == 0) & ((p > 0) | (c > 0)), p + c).otherwise(t)
