"""Exact n-gram Jaccard self-join of texts by an inverted index with set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components, fresh, slices, trimmed
from tracewell.session import materialize

GRAM, SHARE = 4, 85  # words of a shingle; percent of the union that must be shared
BUCKET = 1_200_000  # shingles counted in one group
FLUSH = 1_000_000  # shingles gathered in a task before they are sent
AT_ONCE = 2 << 20  # bytes of text worked on together
BLOCK = 1024  # members of one list that are compared in one group
HISTOGRAM = 128  # counters in the signature of a set
REMEMBERED = 150_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """Hash of every word; remembers the first ones it meets."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def shingles(text: bytes | None, hashes: WordHashes, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``gram`` words; shorter texts are one run."""
    words = (text or b"").lower().split()  # bytes: A-Z, and blanks as \x20 \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(gram, len(words))
    run = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        run = (run ^ (run >> np.uint64(29))) * _MIX[0] + values[i : len(words) - size + 1 + i]
    run = (run ^ (run >> np.uint64(30))) * _MIX[1]
    run = (run ^ (run >> np.uint64(27))) * _MIX[2]
    return np.unique(run ^ (run >> np.uint64(31)))


def set_id(found: np.ndarray) -> int:
    """64-bit hash of a whole set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def prefix(n, share: int = SHARE):
    """How many of the rarest of ``n`` shingles two linked sets cannot both miss."""
    return n - (share * n + 99) // 100 + 1


def text_sets(docs: DataFrame, key: str, text: str, gram: int) -> DataFrame:
    """(key, text_hash, set, n_shingles) of every row; equal sets have equal ids, empty texts a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, AT_ONCE):
                found = [shingles(t, hashes, gram) for t in part.column(0).to_pylist()]
                ids = [set_id(s) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(ids, pa.int64()), pa.array([len(s) for s in found], pa.int64())],
                    names=["key", "text_hash", "set", "n_shingles"],
                )

    source = docs.select(
        F.col(text).cast("string").cast("binary").alias("text"), F.col(key).alias("key"), text_hash(text)
    )
    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(trimmed(run), f"key {kind}, text_hash bigint, set bigint, n_shingles bigint")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("text_hash")


def pack(sets: np.ndarray, sizes: np.ndarray, owner: np.ndarray, buckets: np.ndarray, *values: np.ndarray) -> Iterator[dict]:
    """One row per bucket from values that belong to sets: their ids and sizes once, then the values."""
    order = np.lexsort((owner, buckets))
    owner, buckets, values = owner[order], buckets[order], [v[order] for v in values]
    cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        own = owner[a:b]
        begins = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        runs = np.diff(np.append(begins, len(own))).astype("<u4")
        first = own[begins]
        yield {
            "bucket": int(buckets[a]),
            "sets": sets[first].astype("<i8").tobytes(),
            "sizes": sizes[first].astype("<u4").tobytes(),
            "runs": runs.tobytes(),
            "values": [v[a:b].tobytes() for v in values],
        }


PACKED = pa.schema([
    ("bucket", pa.int32()), ("sets", pa.binary()), ("sizes", pa.binary()), ("runs", pa.binary()),
    ("values", pa.list_(pa.binary())),
])
PACKED_SQL = "bucket int, sets binary, sizes binary, runs binary, values array<binary>"


def unpack(table: pa.Table, *kinds: str) -> list[np.ndarray]:
    """(set, size, values...) per value of all packed rows."""
    join = lambda parts, kind: np.frombuffer(b"".join(parts), dtype=kind)
    runs = join(table["runs"].to_pylist(), "<u4")
    values = table["values"].to_pylist()
    return [
        np.repeat(join(table["sets"].to_pylist(), "<i8"), runs),
        np.repeat(join(table["sizes"].to_pylist(), "<u4"), runs),
        *(join([v[i] for v in values], kind) for i, kind in enumerate(kinds)),
    ]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def common_shingles(docs: DataFrame, text: str, gram: int, share: int, buckets: int) -> DataFrame:
    """(set, n, unique, toks): sets whose prefix reaches shingles that another set has as well.

    ``toks`` are the shingles shared with other sets, rarest first.  Two shuffles: first
    by ranges of shingles, where each is counted over the distinct sets that have it;
    those of one set only, most of all, end there.  Then by ranges of sets.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        ids: dict[int, int] = {}

        def flush():
            sizes = np.array([len(h) for h in held])
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), sizes)
            rows = list(pack(np.array(list(ids)), sizes, owner, _bucket(tokens, buckets), tokens))
            held.clear(), ids.clear()
            return pa.RecordBatch.from_pylist(rows, schema=PACKED)

        gathered = 0
        for batch in batches:
            for part in slices(batch, AT_ONCE):
                for t in part.column(0).to_pylist():
                    found = shingles(t, hashes, gram)
                    if len(found) and (own := set_id(found)) not in ids:
                        ids[own] = len(held)
                        held.append(found)
                        gathered += len(found)
                    if gathered > FLUSH:
                        yield flush()
                        gathered = 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        sets, sizes, tokens = unpack(table, "<u8")
        order = np.lexsort((sets, tokens))
        sets, sizes, tokens = sets[order], sizes[order], tokens[order]
        new = np.ones(len(tokens), dtype=bool)  # a set may come from several tasks
        new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        sets, sizes, tokens = sets[new], sizes[new], tokens[new]
        begins = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1))
        many = np.diff(np.append(begins, len(tokens)))
        held = np.repeat(many, many)
        kept = held > 1
        if not kept.any():
            return pa.Table.from_pylist([], schema=PACKED)
        sets, sizes, tokens, held = sets[kept], sizes[kept], tokens[kept], held[kept]
        own, first, owner = np.unique(sets, return_index=True, return_inverse=True)
        where = _bucket(own.view(np.uint64), buckets)[owner]
        rows = pack(own, sizes[first], owner, where, tokens, np.minimum(held, 65535).astype("<u2"))
        return pa.Table.from_pylist(list(rows), schema=PACKED)

    sets_schema = pa.schema([
        ("set", pa.int64()), ("n", pa.int64()), ("unique", pa.int64()), ("toks", pa.list_(pa.int64())),
        ("histogram", pa.binary()),
    ])

    def gather(table: pa.Table) -> pa.Table:
        sets, sizes, tokens, held = unpack(table, "<u8", "<u2")
        order = np.lexsort((tokens, held, sets))
        sets, sizes, tokens = sets[order], sizes[order].astype(np.int64), tokens[order].view(np.int64)
        cuts = [0, *(np.flatnonzero(sets[1:] != sets[:-1]) + 1).tolist(), len(sets)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(sizes[a])
            if n - (b - a) < prefix(n, share):
                marks = np.bincount(tokens[a:b].view(np.uint64) % np.uint64(HISTOGRAM), minlength=HISTOGRAM)
                rows.append({
                    "set": int(sets[a]), "n": n, "unique": n - (b - a), "toks": tokens[a:b],
                    "histogram": marks.astype("<u4").tobytes(),
                })
        return pa.Table.from_pylist(rows, schema=sets_schema)

    source = docs.select(F.col(text).cast("string").cast("binary").alias("text"))
    counted = source.mapInArrow(trimmed(send), PACKED_SQL).groupBy("bucket").applyInArrow(count, PACKED_SQL)
    return counted.groupBy("bucket").applyInArrow(
        gather, "set bigint, n bigint, unique bigint, toks array<bigint>, histogram binary"
    )


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b, distance, linked) of pairs of sets, from their common shingles."""
    side = lambda x: sets.select(
        F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("toks").alias(f"toks_{x}")
    )
    both = F.size(F.array_intersect("toks_a", "toks_b")).cast("bigint")
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b") - both).alias("either"))
        .select("a", "b", (1 - F.col("both") / F.col("either")).alias("distance"),
                (100 * F.col("both") >= share * F.col("either")).alias("linked"))
    )


def cross_pairs(postings: DataFrame, share: int) -> DataFrame:
    """(a, b, sure): sets of different components that share a list and may be linked.

    ``sure`` tells those that are linked by their distances to a common pivot alone.

    Lists are cut by size class, since linked sets lie in the same or neighbouring
    classes; other blocks of a list are skipped.  A class with many members is cut
    into blocks of about BLOCK, and each two blocks meet in a group of their own.
    """
    step = -np.log(share / 100) * 1.001  # a little wider, so that rounding can't part linked sets further
    classed = postings.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    cells = classed.unionByName(classed.withColumn("class", F.col("class") + 1).withColumn("guest", F.lit(True)))
    cells = materialize(cells, "jaccard-cells")
    blocks = cells.groupBy("tok", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
                                               F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("home"))
    blocks = blocks.where("home > 0")
    dealt = (
        cells.join(blocks, ["tok", "class"])
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .drop("blocks", "home", "other")
    )
    group = ["tok", "class", "low", "high"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "n")
    columns = [*group, "block", "set", "n", "guest", "comp", "pivot", "distance", "histogram"]

    def compare(rows: list[pa.RecordBatch]) -> tuple[list[int], list[int], list[bool]]:
        t = pa.Table.from_batches(rows)
        get = lambda c: t[c].to_numpy()
        n, ids, comp, block, home = get("n"), get("set"), get("comp"), get("block"), ~get("guest").astype(bool)
        pivot, distance = get("pivot"), get("distance")
        marks = np.frombuffer(b"".join(t["histogram"].to_pylist()), dtype="<u4").reshape(len(n), -1)
        apart = t["low"][0].as_py() != t["high"][0].as_py()
        a, b, sure = [], [], []
        for i in range(len(n) - 1):
            stop = np.searchsorted(n, n[i] * 100 // share, side="right")  # longer sets can't be linked
            j = np.arange(i + 1, stop)
            j = j[(comp[j] != comp[i]) & (home[j] | home[i])]
            if apart:
                j = j[block[j] != block[i]]
            # known distances to a common pivot bound the distance of the two
            near = (pivot[j] != pivot[i]) | (np.abs(distance[j] - distance[i]) <= 1 - share / 100 + 1e-9)
            j = j[near]
            if not len(j):
                continue
            most = np.minimum(marks[i], marks[j]).sum(axis=1).astype(np.int64)
            j = j[100 * most >= share * (n[i] + n[j] - most)]
            a += np.minimum(ids[i], ids[j]).tolist()
            b += np.maximum(ids[i], ids[j]).tolist()
            sure += ((pivot[j] == pivot[i]) & (distance[j] + distance[i] <= 1 - share / 100 - 1e-9)).tolist()
        return a, b, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, told = None, set()
        keys: tuple = ()

        def out():
            found = set(zip(*compare(held), strict=True)) - told if sum(map(len, held)) > 1 else set()
            if len(told) > REMEMBERED:
                told.clear()
            told.update(found)
            pairs = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()),
                 pa.array([p[2] for p in pairs], pa.bool_())], names=["a", "b", "sure"]
            )

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(i).to_numpy() for i in range(4)]
            changed = np.zeros(len(batch), dtype=bool)
            for k in keys:
                changed[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(int(k[x]) for k in keys)
                if own != current and held:
                    yield out()
                    held = []
                current = own
                held.append(batch.slice(x, y - x))
        if held:
            yield out()

    return dealt.select(*columns).mapInArrow(trimmed(run), "a bigint, b bigint, sure boolean").distinct()


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, share: int = SHARE
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key reachable by links.

    Two texts link when their sets of word shingles share ``share`` percent of their
    union; equal sets are one set from the start.  The index lists the rarest shingles
    of each set.  First every list is tied to its member with the fewest shingles of its
    own, the likely original, and those pairs are verified.  A set linked to an original
    takes over its component, so only pairs across components are left: they are pruned
    by size, by their known distances to a common original and by an upper bound from
    their signatures, and all that remain are verified.  No link between sets is lost.

    * null or empty text, or blanks only: no shingles, linked with nothing.
    * ties and repeated rows: equal sets share a component; each row has its own result.
    * null keys: never the smallest; such a row alone in its component has a null one.
    * texts of any length count whole.  An empty table stays empty.
    Sets and shingles are told apart by 64-bit hashes.
    """
    found = _joined(docs, key, text, gram, share)
    return found.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def links(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, share: int = SHARE
) -> DataFrame:
    """(key, n_links) of every row: the number of other rows that it links to.

    Equal texts count as often as they occur.  Unlike ``join``, this needs every link
    inside a component, not only enough to hold it together: of two sets with a common
    original, the known distances to it accept or reject what they can, by the triangle
    inequality; signatures reject more, and the rest is verified exactly.  Time and pairs
    grow with the links between distinct sets, so with the square of a family that is
    linked throughout.  Rows without shingles have no links.
    """
    rows, sets, _, told = _known(docs, key, text, gram, share)
    alone = told.withColumn("comp", F.col("set")).withColumn("guest", F.lit(False))  # no component to skip
    pairs = materialize(cross_pairs(alone, share), "jaccard-pairs")
    exact = verified(pairs.where("not sure"), sets, share).where("linked").select("a", "b")
    linked = materialize(pairs.where("sure").select("a", "b").unionByName(exact), "jaccard-all-links")
    weights = rows.where("set is not null").groupBy("set").agg(F.count("*").alias("weight"))
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(weights, both["b"] == weights["set"]).groupBy("a").agg(F.sum("weight").alias("partners"))
    counted = weights.join(partners, weights["set"] == partners["a"], "left").select(
        F.col("set").alias("set_"), (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("n")
    )
    return rows.join(counted, rows["set"] == counted["set_"], "left").select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links")
    )


def _known(docs: DataFrame, key: str, text: str, gram: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, sets, the verified links with the lists' pivots, and postings with component, pivot and distance to it."""
    rows = materialize(text_sets(docs, key, text, gram), "jaccard-rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    sets = materialize(common_shingles(docs, text, gram, share, total // BUCKET + 1), "jaccard-sets")
    size = F.greatest(F.expr(f"n - ({share} * n + 99) div 100 + 1 - unique"), F.lit(0)).cast("int")
    postings = sets.select("set", "n", "unique", F.explode(F.slice("toks", F.lit(1), size)).alias("tok"))
    pivots = postings.groupBy("tok").agg(
        F.min(F.struct((F.col("unique") / F.col("n")).alias("r"), "set"))["set"].alias("pivot"), F.count("*").alias("members")
    ).where("members > 1")
    stars = (
        postings.join(pivots, "tok").where("set <> pivot").select(F.col("pivot").alias("a"), F.col("set").alias("b")).distinct()
    )
    first = materialize(verified(stars, sets, share), "jaccard-stars")
    linked = first.where("linked").select("a", "b")
    grouped = materialize(components(linked, "a", "b", "jaccard-components"), "jaccard-groups")
    answers = first.groupBy(F.col("b").alias("set")).agg(F.min(F.struct("distance", "a")).alias("best")).select(
        "set", F.col("best.a").alias("pivot"), F.col("best.distance").alias("distance")
    )
    known = (
        sets.select("set", "histogram")
        .join(grouped.select(F.col("node").alias("set"), F.col("root").alias("comp")), "set", "left")
        .join(answers, "set", "left")
        .select("set", "histogram", F.coalesce("comp", "set").alias("comp"), F.coalesce("pivot", "set").alias("pivot"),
                F.coalesce("distance", F.lit(0.0)).alias("distance"))
    )
    told = materialize(postings.select("set", "n", "tok").join(known, "set"), "jaccard-postings")
    return rows, sets, linked, told


def _joined(docs: DataFrame, key: str, text: str, gram: int, share: int) -> DataFrame:
    """(key, text_hash, n_shingles, component_id, root); component and root (a set of it) of a text without shingles are null."""
    rows, sets, linked, told = _known(docs, key, text, gram, share)
    mixed = told.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tok")
    left = cross_pairs(told.join(mixed, "tok").withColumn("guest", F.lit(False)), share)
    second = materialize(verified(left, sets, share).where("linked").select("a", "b"), "jaccard-links")
    whole = components(linked.unionByName(second), "a", "b", "jaccard-components")
    classes = rows.where("set is not null").groupBy("set").agg(F.min("key").alias("least"))
    roots = whole.join(classes, whole["node"] == classes["set"]).select("set", "root", "least")
    best = roots.groupBy("root").agg(F.min("least").alias("best"))
    roots = roots.join(best, "root").select("set", "root", "best")
    per_set = classes.join(roots, "set", "left").select(
        F.col("set").alias("set_"), F.coalesce("root", "set").alias("root"), F.coalesce("best", "least").alias("component_id")
    )
    return rows.join(per_set, rows["set"] == per_set["set_"], "left").select(
        "key", "text_hash", "n_shingles", "component_id", "root"
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, share: int = SHARE
) -> DataFrame:
    """One row of each component stays: one whose key names the component.

    Rows that go are looked up by key and text, so that rows which repeat a key with
    another text are told apart; of rows that repeat key and text one stays.  Texts
    without shingles stay.  A row with a null key goes if its component has a key, else
    it stays.
    """
    found = materialize(_joined(docs, key, text, gram, share), "jaccard-found")
    first = found.where("key = component_id").groupBy("root").agg(F.min("text_hash").alias("first"))
    named = found.join(first, "root")
    stays = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)) & (F.col("text_hash") == F.col("first"))
    k, h = fresh(docs, "_key", "_hash")
    pick = lambda df: df.select(F.col("key").alias(k), F.col("text_hash").alias(h))
    goes = materialize(pick(named.where(~stays).select("key", "text_hash").distinct()), "jaccard-goes")
    again = named.where(stays).groupBy("key", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(pick(again), "jaccard-again")
    same = F.col(key).eqNullSafe(F.col(k)) & (text_hash(text) == F.col(h))
    kept = docs.join(goes, same, "left_anti")
    if not again.take(1):
        return kept
    several = kept.join(again, same, "left_semi").withColumn(h, text_hash(text)).dropDuplicates([key, h]).drop(h)
    return kept.join(again, same, "left_anti").unionByName(several)
