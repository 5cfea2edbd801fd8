"""Text expressions: token overlap, section counts, field lists, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that separate words (Unicode white space).
WHITE_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# Fixed value: the same characters as a set to strip from the ends of a text.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# What counts as a reference, a number and a date in plain text.
REFERENCE = r"https?://[A-Za-z0-9./_%#?=&:~-]+"
NUMBER = r"[0-9]+(?:\.[0-9]+)?%?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def words(text: Column) -> Column:
    """Distinct white-space separated words."""
    return F.array_distinct(F.filter(F.split(text, WHITE_SPACE), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Word overlap of two texts; 0 when either is missing or ''."""
    wa, wb = words(a), words(b)
    both = F.size(F.array_intersect(wa, wb)).cast("double")
    either = F.size(wa) + F.size(wb) - F.size(F.array_intersect(wa, wb))
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, F.lit(0.0)).when(either == 0, F.lit(1.0)).otherwise(both / either)


def bullet_count(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("\n- "), F.lit("")))) / 3).cast("bigint")


def section_counts(text: Column) -> tuple[Column, Column]:
    """(sources, entities) of text with ENTITIES and KEY FINDINGS sections.

    Bullets before the first ENTITIES are sources (all bullets when there is no
    such section); bullets from there to the first KEY FINDINGS are entities.
    """
    ent = F.instr(text, "ENTITIES")
    key = F.instr(text, "KEY FINDINGS")
    sources = F.when(ent > 0, bullet_count(F.substring(text, F.lit(1), ent - 1))).otherwise(bullet_count(text))
    entities = F.when(
        (ent > 0) & (key > ent), bullet_count(F.substring(text, ent, key - ent))
    ).otherwise(F.lit(0).cast("bigint"))
    return sources, entities


def found(text: Column, pattern: str, limit: int | None = None) -> Column:
    """Distinct matches in order of appearance."""
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return hits if limit is None else F.slice(hits, 1, limit)


def claims(text: Column, limit: int | None = None) -> Column:
    """The sentences of a text, or the leading ones."""
    sentences = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s))
    said = F.filter(sentences, lambda s: s != "")
    return said if limit is None else F.slice(said, 1, limit)


def leading(text: Column, chars: int | None) -> Column:
    """The text, or its first characters."""
    return text if chars is None else F.substring(text, 1, chars)


def approved(text: Column) -> Column:
    return F.upper(strip(text)).startswith("APPROVED")


def revision_notes(text: Column) -> Column:
    return F.when(approved(text), F.lit("")).otherwise(strip(text))


def format_ms(ms: Column) -> Column:
    """'2.5s' from one second on, '850ms' below."""
    seconds = F.format_string("%.1fs", F.bround(ms / 1000, 1))
    return F.when(ms >= 1000, seconds).otherwise(F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))


def format_time(ts: Column) -> Column:
    """Wall-clock time to the second, as the column shows it in the session."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_utc(ts: Column) -> Column:
    """The same for a TIMESTAMP column, in UTC whatever the session's zone."""
    return format_time(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))


def percent(ratio: Column) -> Column:
    """'63%' with ties to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def bar_percent(value: Column, maximum: Column) -> Column:
    """Share of the maximum in percent, at most 100; 0 when there is no maximum."""
    return F.when(F.coalesce(maximum, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), value / maximum * 100)
    )


def agent_of_function(name: Column) -> Column:
    return F.replace(name, F.lit("_node"), F.lit(""))
