"""URL filter lists by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.values import quoted
from tracewell.llm.common import ascii_lower, fresh

# fixed values: (verdict, rule), a rule being a host and the start of a path
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
HASH_DIGITS = 8  # hexadecimal digits of a digest that are joined on
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """Rules as a table (verdict, rule)."""
    rows = ", ".join(f"({quoted(v)}, {quoted(r)})" for v, r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(verdict, rule)")


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#``; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Add url_host, url_path, url_rule, url_verdict to every row.

    Each distinct URL is expanded into host suffixes times path prefixes, of which
    only the label counts and prefix lengths that some rule has can match.  Their
    SHA-256 digests are joined with those of the rules on the first ``HASH_DIGITS``
    digits, then the full digests are compared.  The longest rule wins; of equal
    ones the longer host, then the one that blocks.

    * null URL or one without ``://``: empty host and path, no rule, the default.
    * ties and repeated URLs: judged once, every row gets the result.
    * rules without ``/`` are taken as whole hosts; null rules match nothing.
    * no rules or no rows: every row gets the default; no rows stay none.
    * columns named like the new ones: refused with ValueError.
    """
    new = ["url_host", "url_path", "url_rule", "url_verdict"]
    if clash := {c.lower() for c in pages.columns} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist already")
    slash = F.instr("rule", "/")
    known = rules.where("rule is not null and verdict is not null").select(
        "verdict",
        F.when(slash > 0, F.col("rule")).otherwise(F.concat("rule", F.lit("/"))).alias("rule"),
    ).select(
        "verdict", "rule",
        F.substring_index("rule", "/", 1).alias("_host"),
    ).withColumn("_path", F.expr("substring(rule, length(_host) + 1)"))
    digested = known.select(
        "verdict", "rule", "_host", F.sha2("rule", 256).alias("_digest")
    ).withColumn("_short", F.substring("_digest", 1, HASH_DIGITS))
    # both lists are bounded by the longest rule, not by the number of rules
    labels = known.select(F.size(F.split("_host", r"\.", -1)).alias("n")).distinct().orderBy("n").collect()
    lengths = known.select(F.length("_path").alias("n")).distinct().orderBy("n").collect()
    label_counts = F.array(*(F.lit(r.n) for r in labels)).cast("array<int>")
    path_lengths = F.array(*(F.lit(r.n) for r in lengths)).cast("array<int>")
    link = fresh(pages, "_url")[0]
    distinct = pages.select(F.col(url).alias(link)).where(F.col(link).isNotNull()).distinct()
    parts = distinct.select(
        link, F.split(url_host(F.col(link)), r"\.", -1).alias("_labels"), url_path(F.col(link)).alias("_path")
    )
    suffixes = F.transform(
        F.filter(label_counts, lambda n: n <= F.size("_labels")),
        lambda n: F.array_join(F.slice("_labels", F.size("_labels") - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(path_lengths, lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n)
    )
    expressions = (
        parts.select(link, F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
        .select(link, "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select(link, F.sha2(F.concat("_suffix", "_prefix"), 256).alias("_own"))
    )
    hits = (
        expressions.withColumn("_short", F.substring("_own", 1, HASH_DIGITS))
        .join(digested, "_short")
        .where("_own = _digest")
        .groupBy(link)
        .agg(
            F.max(
                F.struct(F.length("rule"), F.length("_host"), F.col("verdict") == "block", F.col("rule"), "verdict")
            ).alias("_best")
        )
        .select(F.col(link).alias(f"{link}_hit"), F.col("_best.rule").alias(new[2]), F.col("_best.verdict").alias("_said"))
    )
    return pages.join(hits, F.col(url) == F.col(f"{link}_hit"), "left").select(
        *pages.columns,
        url_host(F.col(url)).alias(new[0]),
        url_path(F.col(url)).alias(new[1]),
        new[2],
        F.coalesce("_said", F.lit(default)).alias(new[3]),
    )
