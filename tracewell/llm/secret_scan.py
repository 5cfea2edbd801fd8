"""Secrets in texts: fixed patterns, and weak parts that only count together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, refuse_clash
from tracewell.session import materialize


def either_case(words: str) -> str:
    """Pattern for ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
# fixed values: the three base kinds
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){ASSIGNED}({VALUE}+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
# parts that mean nothing alone
RANDOM = r"[A-Za-z0-9+/]{32,}"
NAMED = f"{either_case('(?:pwd|pass|auth|credential|private_?key)')}{ASSIGNED}{VALUE}{{6,}}"
IDENTIFIER = (
    r"(?:AKIA|ASIA)[A-Z0-9]{12,}|"
    + either_case("(?:client_?id|access_?key_?id|account|user(?:name)?|login)")
    + ASSIGNED
    + r"[A-Za-z0-9+/_.@=-]{3,}"
)
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._@:-]+|[a-z0-9-]+\.amazonaws\.com"
SCOPE = 200  # code points that may lie between two parts
BUCKET = 1024
KINDS = ("assign", "access", "hex", "identifier", "linked")
SPAN = "array<struct<start:bigint,stop:bigint>>"


def spans(text: Column, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Places of all leftmost, non-overlapping matches as (start, stop), in code points.

    The lengths of the matches and of the pieces between them give the places.  With
    ``value_group``, only matches whose group has ``least`` characters are kept.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.arrays_zip(
        found.alias("m"), F.split(text, pattern, -1).alias("g"),
        F.regexp_extract_all(text, regex, F.lit(value_group)).alias("v"),
    )
    empty = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["g"])
        stop = start + F.length(part["m"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        fits = F.length(part["v"]) >= least if least else F.lit(True)
        return F.struct(stop.alias("at"), F.when(fits, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    walked = F.aggregate(F.filter(parts, lambda p: p["m"].isNotNull()), begin, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def named_spans(found: Column, *more: Column) -> Column:
    """Spans with further fields between start and stop, so that they sort by start and those."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), *more, s["stop"].alias("stop")))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": spans(text, ASSIGN, 2, LEAST_VALUE),
        "access": spans(text, ACCESS),
        "hex": spans(text, HEX),
    }


def linked_parts(docs: DataFrame, text: str) -> DataFrame:
    """Per distinct text (given by hashes and length) the spans found by linking.

    Random-looking strings need an identifier within SCOPE code points, named weak
    secrets an identifier or an endpoint.  Parts of one text are joined by buckets of
    places: a weak part lies in all buckets that its scope touches, the other part in
    all that it touches itself.
    """
    t = F.col("_t")
    texts = docs.select(F.col(text).cast("string").alias("_t")).where(t.rlike(f"{RANDOM}|{NAMED}"))
    base = F.concat(*base_spans(t).values())
    classes = {
        "random": F.filter(
            spans(t, RANDOM),
            lambda s: F.substring(t, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).rlike(
                "(?s)^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
            ),
        ),
        "named": spans(t, NAMED),
    }
    classes = {
        k: F.filter(v, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        for k, v in classes.items()
    } | {"identifier": spans(t, IDENTIFIER), "endpoint": spans(t, ENDPOINT)}
    listed = [named_spans(v, F.lit(k).alias("part")) for k, v in classes.items()]
    parts = (
        texts.withColumn("_base", base)
        .select(*text_key(t), F.explode(F.concat(*listed)).alias("p"))
        .select("_h1", "_h2", "_n", "p.*")
        .distinct()
    )
    key = ["_h1", "_h2", "_n"]
    parts = materialize(parts, "secret-parts")
    weak = parts.where("part in ('random', 'named')").withColumn(
        "bucket", F.explode(F.expr(f"sequence((start - {SCOPE}) div {BUCKET}, (stop + {SCOPE}) div {BUCKET})"))
    )
    other = parts.where("part in ('identifier', 'endpoint')").select(
        *key, F.col("part").alias("part_o"), F.col("start").alias("start_o"), F.col("stop").alias("stop_o"),
        F.explode(F.expr(f"sequence(start div {BUCKET}, stop div {BUCKET})")).alias("bucket"),
    )
    pairs = weak.join(other, [*key, "bucket"]).where(
        f"greatest(start, start_o) - least(stop, stop_o) between 0 and {SCOPE} and (part = 'named' or part_o = 'identifier')"
    )
    span = lambda kind, start, stop: F.struct(
        F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(stop).alias("stop")
    )
    return (
        pairs.select(*key, F.explode(F.array(
            span("linked", "start", "stop"),
            F.when(F.col("part_o") == "identifier", span("identifier", "start_o", "stop_o")),
        )).alias("s"))
        .where("s is not null")
        .groupBy(*key)
        .agg(F.collect_set("s").alias("_linked"))
    )


def text_key(text: Column) -> list[Column]:
    """Stands for a text in joins: two hashes and the length."""
    return [
        F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"), F.length(text).cast("bigint").alias("_n"),
    ]


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add secret_spans to every row: (kind, start, stop) by start, then kind in order of KINDS.

    Places are code points, the end exclusive.  Kinds assign, access and hex are
    matches of the base patterns; ``linked`` is a weak secret next to a complementary
    part, ``identifier`` the identifier it goes with.  Weak parts alone are no finding.

    * null or empty text: an empty list.  Repeated texts: scanned each, linked once.
    * overlapping matches of different kinds are all kept.
    * very long texts are searched whole; time grows with the text and, through the
      list of matches, with the square of the matches in one text.
    * an empty table stays empty; a column named secret_spans: ValueError.
    """
    kept = list(docs.columns if keep is None else keep)
    refuse_clash(kept, ["secret_spans"])
    linked = materialize(linked_parts(docs, text), "secret-links")
    slot, h1, h2, n = fresh(docs, "_t", "_h1", "_h2", "_n")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [
        named_spans(v, F.lit(i + 1).alias("place"), F.lit(k).alias("kind")) for i, (k, v) in enumerate(base_spans(t).items())
    ]
    keys = [c.alias(x) for c, x in zip(text_key(F.col(text).cast("string")), (h1, h2, n), strict=True)]
    found = docs.select(*kept, *keys, F.concat(*own).alias(slot))
    linked = linked.select(
        *(F.col(c).alias(f"{c}_l") for c in ("_h1", "_h2", "_n")),
        F.transform("_linked", lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("place"),
            s["kind"].alias("kind"), s["stop"].alias("stop"),
        )).alias("_more"),
    )
    same = (F.col(h1) == F.col("_h1_l")) & (F.col(h2) == F.col("_h2_l")) & (F.col(n) == F.col("_n_l"))
    both = F.array_sort(F.array_distinct(F.concat(F.col(slot), F.coalesce("_more", F.array().cast(
        "array<struct<start:bigint,place:int,kind:string,stop:bigint>>"
    )))))
    return found.join(linked, same, "left").select(
        *kept,
        F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
        .alias("secret_spans"),
    )


def described(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redact(text: Column, found: Column, by: str = "[SECRET]") -> Column:
    """The text with every found span replaced; overlapping spans are replaced together."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (
            F.when(s["stop"] <= acc["at"], acc)
            .when(s["start"] < acc["at"], F.struct(s["stop"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], gap, F.lit(by)).alias("out")))
        )

    whole = F.aggregate(
        found, begin, step,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(found) > 0, whole).otherwise(text)
