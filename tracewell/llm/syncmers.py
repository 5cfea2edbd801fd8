"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, refuse_clash, running_sums
from tracewell.session import materialize

WORDS = 3  # words of a k-mer; its inner substrings are single words
SALTS = 64  # ways that rows without a key are dealt
SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hash of every word; null and empty texts have none."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), ""), lambda w: F.hash(w))


def anchors(hashes: Column, k: int = WORDS) -> Column:
    """(hash, place) of every closed syncmer: a k-mer whose smallest word hash is its first or last.

    Whether a k-mer is chosen depends on its own words only, so common passages have
    common anchors wherever they stand.  Fewer words than ``k`` make one anchor.
    ``hashes`` must be a column, not an expression, or it is computed again and again.
    """
    n = F.size(hashes)
    edges = lambda i: F.least(F.get(hashes, i - 1), F.get(hashes, i + (k - 2)))
    chosen = F.filter(
        F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_min(F.slice(hashes, i, F.lit(k))) == edges(i)
    )
    anchor = lambda value, place: F.struct(value.alias("hash"), place.alias("place"))
    return (
        F.when(n >= k, F.transform(chosen, lambda i: anchor(F.hash(F.slice(hashes, i, F.lit(k))), i - 1)))
        .when(n > 0, F.array(anchor(F.hash(hashes), F.lit(0))))
        .otherwise(F.array().cast("array<struct<hash:int,place:int>>"))
    )


def match(pairs: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Add the matches between the anchors of two columns under each name of ``sides``, by place.

    All anchors count.  Of anchors with one hash, the first in one text is matched with
    the first in the other, the second with the second, and so on, wherever they stand.
    A match is one number: its place in the first text, shifted left by 32 bits, plus
    that in the second; matches are in that order.  Time grows with n log n of the
    anchors, also where one of them is repeated all the time.

    No anchors on a side: no matches.  An empty table stays empty; columns named like
    the new ones: ValueError.
    """
    kept = pairs.columns
    refuse_clash(kept, list(sides))
    numbers = [f"{i}" for i in range(len(sides))]
    merged, parts = fresh(pairs, *(f"_merged{i}" for i in numbers)), fresh(pairs, *(f"_parts{i}" for i in numbers))

    def packed(found: str, side: int) -> Column:  # hash, side and place in one number
        return F.transform(found, lambda a: F.shiftleft(a["hash"].cast("bigint"), 32).bitwiseOR(
            F.lit(side << 31).cast("bigint")).bitwiseOR(a["place"].cast("bigint")))

    def begins(m: Column) -> Column:  # where the anchors of one hash and one text begin
        new = lambda i: (i == 0) | (F.shiftright(F.get(m, i), 31) != F.shiftright(F.get(m, i - 1), 31))
        return F.when(F.size(m) > 0, F.filter(F.sequence(F.lit(0), F.size(m) - 1), new)).otherwise(F.array().cast("array<int>"))

    def matches(m: Column, p: Column) -> Column:
        hashed = lambda j: F.shiftright(F.get(m, F.get(p, j)), 32)
        place = lambda i: F.get(m, i).bitwiseAND(0x7FFFFFFF)

        def both(j):
            start, middle, end = F.get(p, j), F.get(p, j + 1), F.coalesce(F.get(p, j + 2), F.size(m))
            last = F.least(middle - start, end - middle) - 1
            return F.transform(
                F.sequence(F.lit(0), last), lambda r: F.shiftleft(place(start + r), 32).bitwiseOR(place(middle + r))
            )

        met = F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda j: hashed(j) == hashed(j + 1))
        return F.when(F.size(p) > 1, F.sort_array(F.flatten(F.transform(met, both)))).otherwise(F.array().cast("array<bigint>"))

    both = pairs.select(*kept, *(
        F.sort_array(F.concat(packed(a, 0), packed(b, 1))).alias(m) for m, (a, b) in zip(merged, sides.values(), strict=True)
    ))
    both = both.select(*kept, *merged, *(begins(F.col(m)).alias(p) for m, p in zip(merged, parts, strict=True)))
    return both.select(*kept, *(
        matches(F.col(m), F.col(p)).alias(name) for name, m, p in zip(sides, merged, parts, strict=True)
    ))


def likeness(a: Column, b: Column, matched: Column) -> Column:
    """Matches between all anchors of two texts, as a share of both; two texts without anchors are alike."""
    either = F.size(a) + F.size(b) - F.size(matched)
    return F.when(either == 0, 1.0).otherwise(F.size(matched).cast("double") / either)


def passages(matched: Column) -> Column:
    """How many passages the matches form: matches in a row that stand equally far apart in both texts.

    ``matched`` must be a column, not an expression.
    """
    shift = lambda v: v.bitwiseAND(0x7FFFFFFF) - F.shiftright(v, 32)
    new = lambda i: (i == 0) | (shift(F.get(matched, i)) != shift(F.get(matched, i - 1)))
    found = F.filter(F.sequence(F.lit(0), F.size(matched) - 1), new)
    return F.when(F.size(matched) > 0, F.size(found)).otherwise(0).cast("bigint")


def printed(found: Column) -> Column:
    """All anchors, in the order of the text, as a string: hash and place of each as one hexadecimal number."""
    number = lambda a: F.shiftleft(a["hash"].cast("bigint"), 32).bitwiseOR(a["place"].cast("bigint"))
    return F.array_join(F.transform(found, lambda a: F.hex(number(a))), ".")


def parsed(fingerprint: Column) -> Column:
    """The anchors that a string of ``printed`` stands for."""
    half = lambda digits: F.conv(digits, 16, 10).cast("bigint")
    whole = lambda n: F.lpad(n, 16, "0")
    signed = lambda n: F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")
    anchor = lambda n: F.struct(
        signed(half(F.substring(whole(n), 1, 8))).alias("hash"), half(F.substring(whole(n), 9, 8)).cast("int").alias("place")
    )
    return F.transform(F.array_remove(F.split(fingerprint, "\\."), ""), anchor)


def add_anchors(docs: DataFrame, texts: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Add all anchors, with their places, of the texts that each new column is named for.  No shuffle.

    * null or empty text, or blanks only: no anchors.  Texts are read whole.
    * equal texts have equal anchors; repeated rows keep their own rows.
    * an empty table stays empty; a column with such a name: ValueError.
    """
    kept = list(docs.columns if keep is None else keep)
    refuse_clash(kept, list(texts))
    hashes = fresh(docs, *(f"_hashes_{name}" for name in texts))
    split = docs.select(*kept, *(word_hashes(F.col(t).cast("string")).alias(h) for h, t in zip(hashes, texts.values(), strict=True)))
    return split.select(*kept, *(anchors(F.col(h)).alias(name) for name, h in zip(texts, hashes, strict=True)))


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = 3) -> DataFrame:
    """(key, text, edited, next_text): each text, its edited text and the next document's text.

    The last 1/part of the code points give way to as many from the start of the next
    document in descending order of ``key``; the last one is followed by the first.

    * keys of any type that can be ordered.  Rows without a key stand last, as one
      document; of several rows with one key, the one whose text has the smallest hash
      serves as next document, and all of them get results.
    * null texts are empty; texts of any length are read whole; an empty table stays empty.
    * other columns don't come along, so names can't clash.

    Whole texts travel to their neighbours, since all their anchors are compared; they
    take less room than the anchors.  The order is settled on keys.  Rows without a
    key are dealt by their texts, so that they don't meet in one task.
    """
    none = F.col(key).isNull()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.when(none, F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    salt = F.when(none, F.pmod(F.xxhash64(whole), F.lit(SALTS)).cast("string")).otherwise(F.lit(""))
    # read twice below with the same columns, so that one exchange of the texts serves both
    keyed = docs.select(F.concat(named, salt).alias("_k"), F.col(key).alias("_key"), whole.alias("text")).repartition("_k")
    ids = docs.select(named.alias("_k"), F.col(key).alias("_key"), F.lit(1).alias("_one")).distinct()
    placed = running_sums(ids, [], [F.desc_nulls_last("_key")], {"_place": "_one"}, "edit-order")
    placed = materialize(placed.select("_k", "_place"), "edit-places")
    last = placed.agg(F.max("_place").alias("_last"))
    before = placed.join(F.broadcast(last)).select(  # one row
        F.col("_k").alias("_prev"), (F.col("_place") % F.col("_last") + 1).alias("_place"),
    )
    order = materialize(placed.join(before, "_place").select("_k", "_prev"), "edit-neighbours")
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(F.xxhash64("text"), "text"))
    heads = keyed.withColumn("_row", first("_k")).where("_row = 1 AND _key IS NOT NULL").select("_k", "text")
    # one row of each task is left of those without a key before they meet
    unnamed = docs.where(none).select(F.lit("n").alias("_k"), whole.alias("text"))
    unnamed = unnamed.withColumn("_row", first("_k")).where("_row = 1").select("_k", "text")
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    # joined before they are put together, as a union forgets that the texts lie by key already
    unnamed = unnamed.drop("_k").join(F.broadcast(order.where("_k = 'n'")))  # one row
    heads = heads.join(order, "_k").unionByName(unnamed).select(
        F.explode(F.when(F.col("_prev") == "n", salts).otherwise(F.array("_prev"))).alias("_k"), F.col("text").alias("next_text")
    )
    n = F.length("text")
    cut = F.floor(n / part).cast("int")
    return keyed.join(heads, "_k").select(
        F.col("_key").alias(key), "text",
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
        "next_text",
    )
