"""Conversation structure repair: cheapest edits by an auction for shortest paths over a lattice of rows and roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm.common import running_sums
from tracewell.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # what edits and undeleted truncated rows cost
PART = 64  # rows of a conversation whose lattice is one auction
SPACES = " \t\n\v\f\r"
INK = r"[^\x20\x09-\x0D]"
ENDS = (".", "!", "?")
ROLES = {2: "user", 3: "assistant"}

# States of a repaired conversation: nothing yet, then after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
# Classes of rows by the initial of their role, in the order s, u, a, any other.
OTHER = 3
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # the role that may be made up there
NEVER = 1 << 40


class Lattice:
    """Rows times states of one part, with node prices that an auction raises to distances.

    ``rows`` has one byte per row: 4 * class + 2 if it must go + 1 if it is truncated.
    ``leave`` has what leaving the part in each state costs, None at a conversation's end,
    where only complete conversations may stop and rows may still be inserted.
    """

    def __init__(self, rows: bytes, leave: tuple[int, ...] | None):
        self.rows, self.leave = rows, leave
        self.goal = 4 * (len(rows) + 1)
        low = 0 if leave is None else min(leave)
        prices = [low] * 4
        for row in reversed(rows):  # a row that can't stay as it is costs a deletion at least
            low += DELETE if row & 3 else 0
            prices[:0] = [low] * 4
        self.price = [*prices, 0]
        self.exact = {self.goal}
        if leave is not None and max(leave) >= NEVER:
            self._close()

    def _close(self) -> None:
        """Nodes from which no way leaves the part have no finite price."""
        open_states = {q for q in STATES if self.leave[q] < NEVER}
        for i in range(len(self.rows), -1, -1):
            if i < len(self.rows) and not self.rows[i] & 2 and self.rows[i] >> 2 == 0 and SYSTEM in open_states:
                open_states.add(START)
            if open_states & {USER, ASSISTANT}:
                open_states = set(STATES)
            for q in set(STATES) - open_states:
                self.price[4 * i + q] = NEVER
                self.exact.add(4 * i + q)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next node), edits in ASCII order."""
        i, state = divmod(node, 4)
        if i == len(self.rows):
            if self.leave is not None:
                return [("", self.leave[state], self.goal)]
            stop = [("", 0, self.goal)] if state in (START, ASSISTANT) else []
            return [*stop, ("I", INSERT, 4 * i + NEXT[state])]
        row, ahead = self.rows[i], 4 * (i + 1)
        found = [("D", DELETE, ahead + state), ("I", INSERT, 4 * i + NEXT[state])]
        if not row & 2:
            more = TRUNCATED if row & 1 else 0
            if (kept := KEPT.get((state, row >> 2))) is not None:
                found.append(("K", KEEP + more, ahead + kept))
            found.append(("R", REROLE + more, ahead + NEXT[state]))
        return found

    def settle(self, origin: int) -> int:
        """Distance from a node to the goal.

        The path from the origin is extended along an arc whose price holds with equality.
        Where none does, the price of its last node rises to what the best arc asks and the
        path is contracted.  No price ever exceeds a distance, so all prices on a path that
        has reached the goal, or a node known to be exact, are distances.
        """
        price, exact, path = self.price, self.exact, [origin]
        while path[-1] not in exact:
            best, to = min((cost + price[j], j) for _, cost, j in self.arcs(path[-1]))
            if price[path[-1]] >= best:
                path.append(to)
            else:
                price[path[-1]] = best
                if len(path) > 1:
                    path.pop()
        exact.update(path)
        return price[origin]

    def trace(self, state: int) -> tuple[str, bytes, int]:
        """Edits, states after them and last state of the ASCII-least cheapest way from a state.

        Of the arcs that look tight, the least is taken whose end proves to have that price.
        """
        node, edits, states = state, [], bytearray()
        if self.settle(node) >= NEVER:
            return "", b"", state
        while node != self.goal:
            for edit, cost, to in self.arcs(node):
                if self.price[node] == cost + self.price[to] == cost + self.settle(to):
                    break
            if to != self.goal:
                edits.append(edit)
                states.append(to % 4)
                state = to % 4
            node = to
        return "".join(edits), bytes(states), state


@lru_cache(maxsize=20_000)
def solve(rows: bytes, leave: tuple[int, ...] | None, states: tuple[int, ...]) -> list[tuple[int, str, bytes, int]]:
    """(cost, edits, states, last state) from each of the states."""
    lattice = Lattice(rows, leave)
    return [(lattice.settle(q), *lattice.trace(q)) for q in states]


@lru_cache(maxsize=20_000)
def distances(rows: bytes, last: bool) -> list[int]:
    """Costs of a part from each state (row) to each state (column); at a conversation's end all columns are the cost to stop."""
    if last:
        lattice = Lattice(rows, None)
        return [lattice.settle(q) for q in STATES for _ in STATES]
    ways = [Lattice(rows, tuple(0 if e == q else NEVER for e in STATES)) for q in STATES]
    return [min(NEVER, ways[e].settle(q)) for q in STATES for e in STATES]


@dataclass(frozen=True)
class Repair:
    """What a repair found and did; every frame has one row per conversation, edit or remaining row.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    edits: conv_id, part, seq (their order), edit (one of D, I, K, R), turn, role (of
    inserted and changed rows), and text and old_role of rows that stay.
    """

    conversations: DataFrame
    edits: DataFrame

    def rows(self) -> DataFrame:
        """Repaired conversations: conv_id, part and seq (their order), turn, role, text."""
        left = self.edits.where("edit <> 'D'")
        return left.select(
            "conv_id", "part", "seq", "turn", F.coalesce("role", "old_role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )


def plain(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with a space for each null role and text; a turn that is no whole number counts as null."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).try_cast("bigint").alias("turn"), filled(role).alias("role"), filled(text).alias("text")
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``plain`` with a fault in a quarter of them, dealt by the checksum of conversation and turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    hurt = rows.withColumn("_fault", fault).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _digest() -> Column:
    """Tells rows of one role and text; 256 bits count as the whole."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _row(digest: Column) -> Column:
    """Tells rows of one conversation, turn, role and text."""
    key = F.to_json(F.struct("conv_id", "turn"), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(F.concat(key, F.hex(digest)), 256))


def _condensed(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what orders them, and one number for class and faults."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    blank = ~F.col("text").rlike(INK)
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    code = kind * 4 + F.when(blank, 2).when(~end.isin(*ENDS), 1).otherwise(0)
    return rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), code.alias("code"), F.lit(1).cast("bigint").alias("one"),
        F.monotonically_increasing_id().alias("same"),
    )


def _parts(placed: DataFrame) -> DataFrame:
    """One row per conversation and part: its rows in order, which of them are first of their kind, whether it is the last part."""
    part = F.floor(F.col("pos") / PART).cast("bigint").alias("part")
    item = "struct<pos:bigint,code:int,turn:bigint,digest:binary>"
    null = lambda kind: F.lit(None).cast(kind)
    rows = placed.select("conv_id", part, F.struct("pos", "code", "turn", "digest").cast(item).alias("item"), null("bigint").alias("first"), F.lit(False).alias("last"))
    first = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos"))
    last = placed.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    marks = first.select("conv_id", part, null(item).alias("item"), F.col("pos").alias("first"), F.lit(False).alias("last"))
    ends = last.select("conv_id", part, null(item).alias("item"), null("bigint").alias("first"), F.lit(True).alias("last"))
    return rows.unionByName(marks).unionByName(ends).groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list("item")).alias("items"), F.collect_list("first").alias("firsts"), F.max("last").alias("last")
    )


COUNTED = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
EDIT = "struct<seq:int,edit:string,turn:bigint,role:string,digest:binary>"


def _read(items: list[dict], firsts: list[int]) -> tuple[bytes, list[int]]:
    """A part's rows for the lattice, and its counts of blank, duplicate, truncated and illegally following rows."""
    first, rows, counts = set(firsts), bytearray(), [0, 0, 0, 0]
    for i, item in enumerate(items):
        code = item["code"]
        if not code & 2 and item["pos"] not in first:
            code, counts[1] = code & ~3 | 2, counts[1] + 1
        elif code & 3:
            counts[0 if code & 2 else 2] += 1
        rows.append(code)
        counts[3] += i > 0 and (rows[i - 1] >> 2, code >> 2) not in LEGAL
    return bytes(rows), counts


def _listed(items: list[dict], edits: str, states: bytes) -> list[dict]:
    found, at = [], 0
    for seq, (edit, state) in enumerate(zip(edits, states, strict=True)):
        item = {"turn": None, "digest": None} if edit == "I" else items[at]
        at += edit != "I"
        stays = edit in "KR"
        found.append({
            "seq": seq, "edit": edit, "turn": item["turn"], "role": ROLES[state] if edit in "IR" else None,
            "digest": item["digest"] if stays else None,
        })
    return found


def _per_part(parts: DataFrame, kept: str, made: str, work) -> DataFrame:
    """Add columns made from each part by ``work(row)``."""
    schema = StructType(parts.select(*kept.split()).schema.fields + StructType.fromDDL(made).fields)
    target = to_arrow_schema(schema)
    new = target.names[len(kept.split()) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                results = [work(row) for row in piece.to_pylist()]
                columns = [piece.column(c) for c in kept.split()]
                columns += [pa.array([r[k] for r in results], target.field(n).type) for k, n in enumerate(new)]
                yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return parts.mapInArrow(run, schema)


def _short(parts: DataFrame) -> DataFrame:
    """Counts, cost and edits of conversations of one part."""

    def work(row):
        rows, counts = _read(row["items"], row["firsts"])
        cost, edits, states, _ = solve(rows, None, (START,))[0]
        return [*counts, cost, _listed(row["items"], edits, states)]

    return _per_part(parts, "conv_id part", f"{COUNTED}, cost bigint, edits array<{EDIT}>", work)


def _product(a: Column, b: Column) -> Column:
    """Costs through two stretches of a conversation: the least over the state between them."""
    way = lambda i, k: F.get(a, F.floor(i / 4).cast("int") * 4 + k) + F.get(b, k * 4 + i % 4)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.least(F.lit(NEVER), *(way(i, F.lit(k)) for k in STATES)))


def _shifted(df: DataFrame, by: int, value: str, name: str) -> DataFrame:
    return df.select(F.col("conv_id").alias("_conv"), (F.col("part") + by).alias("_part"), F.col(value).alias(name))


def _beside(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")


def _long(parts: DataFrame, most: int, name: str) -> DataFrame:
    """The same as ``_short`` for conversations of several parts, at most ``most``.

    Costs of a part between its end states are small matrices; doubling joins multiply
    them up from every part to the end, which gives the prices at each part's end.  Then
    every part is traced from each state it may be entered in, and doubling joins chain
    the parts' states from the start.  No task sees more than a part of a conversation.
    """
    tables = _per_part(parts, "conv_id part", "way array<bigint>", lambda row: [distances(_read(row["items"], row["firsts"])[0], row["last"])])
    onward, step = materialize(tables, name), 1
    while step < most:
        pair = _beside(onward, _shifted(onward, -step, "way", "then"))
        both = F.when(F.col("then").isNull(), F.col("way")).otherwise(_product(F.col("way"), F.col("then")))
        onward, step = materialize(pair.select("conv_id", "part", both.alias("way")), name), step * 2
    leave = _shifted(onward, -1, "way", "leave")

    def work(row):
        rows, counts = _read(row["items"], row["firsts"])
        found = solve(rows, None if row["leave"] is None else tuple(row["leave"][::4]), STATES)
        listed = [_listed(row["items"], edits, states) for _, edits, states, _ in found]
        return [*counts, rows[0] >> 2, rows[-1] >> 2, found[START][0], [f[3] for f in found], listed]

    made = f"{COUNTED}, head int, tail int, cost bigint, ends array<int>, edits array<array<{EDIT}>>"
    traced = materialize(_per_part(_beside(parts, leave), "conv_id part", made, work), name)
    chain, step = traced.select("conv_id", "part", "ends"), 1
    while step < most:
        pair = _beside(chain, _shifted(chain, step, "ends", "before"))
        both = F.when(F.col("before").isNull(), F.col("ends")).otherwise(F.transform("before", lambda q: F.get("ends", q)))
        chain, step = materialize(pair.select("conv_id", "part", both.alias("ends")), name), step * 2
    found = _beside(_beside(traced, _shifted(chain, 1, "ends", "entered")), _shifted(traced, 1, "tail", "before"))
    legal = F.col("before").isNull()
    for a, b in sorted(LEGAL):
        legal = legal | ((F.col("before") == a) & (F.col("head") == b))
    return found.select(
        "conv_id", "part", "blank", "duplicate", "truncated", (F.col("illegal") + F.when(legal, 0).otherwise(1)).alias("illegal"),
        F.when(F.col("part") == 0, F.col("cost")).otherwise(0).alias("cost"),
        F.get("edits", F.coalesce(F.get("entered", F.lit(START)), F.lit(START))).alias("edits"),
    )


def repair(rows: DataFrame, name: str = "repair") -> Repair:
    """Cheapest edits that make the role initials of each conversation read ``(s?(ua)+)?``.

    ``rows`` are those of ``plain``.  A conversation's rows count in the order of their
    turns, null first, equal turns by role and digest.  A blank row and one whose role and
    text came earlier must be deleted (2); any row may be; a row may take the role user or
    assistant (1), an empty one be inserted (5); a truncated row that stays adds 5.  Of
    equally cheap lists of edits the ASCII-least is taken.

    * null keys are one conversation; an empty table gives empty frames; repeated rows
      are duplicates.  Further columns don't come along, so names can't clash.
    * conversations of any length: rows are placed by range partitions and cut into parts
      of ``PART`` rows, so no task holds a whole conversation.  Texts of any length are
      never gathered; they join the rows that stay.
    """
    placed = running_sums(_condensed(rows), ["conv_id"], ["turn", "role", "digest", "same"], {"pos": "one"}, name)
    placed = materialize(placed.select("conv_id", "turn", "digest", "code", (F.col("pos") - 1).alias("pos")), name)
    parts = materialize(_parts(placed), name)
    most = (parts.agg(F.max("part")).first()[0] or 0) + 1
    done = _short(parts.where("part = 0 AND last"))
    if most > 1:
        done = done.unionByName(_long(parts.where("part > 0 OR NOT last"), most, name))
    done = materialize(done, name)
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn")
    turns = placed.groupBy("conv_id").agg(F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("bigint").alias("gaps"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    sums = done.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts))
    zero = lambda *names: [F.lit(0).cast("bigint").alias(c) for c in names]
    both = turns.select("*", *zero(*counts)).unionByName(sums.select("*", *zero("gaps")))
    conversations = both.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("gaps", *counts)))
    edits = done.select("conv_id", "part", F.explode("edits").alias("e")).select("conv_id", "part", "e.*")
    stay = edits.where("digest IS NOT NULL").withColumn("_row", _row(F.col("digest")))
    texts = rows.select(_row(_digest()).alias("_row"), F.col("role").alias("old_role"), "text")
    # rows that are equal in all have one edit that keeps one of them
    one = texts.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("old_role"))).where("_nth = 1")
    told = stay.join(one, "_row").select(*edits.columns, "old_role", "text")
    told = told.unionByName(edits.where("digest IS NULL").select("*", *(F.lit(None).cast("string").alias(c) for c in ("old_role", "text"))))
    return Repair(conversations, told.drop("digest"))


def fingerprints(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, sha256): edits in order as one string, and the digest of the repaired ``role:text`` lines.

    A digest is sequential by its definition: the rows of a conversation are sorted into one
    task, but pass through it as a stream, so that only the edits' initials are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, begun, at, audit, lines, digest = None, False, None, [], 0, None
        done: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], kind), *(pa.array([d[k] for d in done], pa.string()) for k in (1, 2))],
                names=["conv_id", "audit", "sha256"],
            )

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for piece in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                for conv, edit, line in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "edit", "line")), strict=True):
                    if not begun or conv != at[0]:
                        if begun:
                            done.append((at[0], "".join(audit), digest.hexdigest()))
                        begun, audit, lines, digest = True, [], 0, hashlib.sha256()
                    at = (conv,)
                    audit.append(edit)
                    if line is not None:
                        digest.update(b"\n" * (lines > 0) + line)
                        lines += 1
                if done:
                    yield flush()
                    done.clear()
        if begun:
            done.append((at[0], "".join(audit), digest.hexdigest()))
            yield flush()

    role = F.coalesce("role", "old_role")
    line = F.when(F.col("edit") != "D", F.concat(role, F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    ordered = edits.select("conv_id", "part", "seq", "edit", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = StructType([edits.schema["conv_id"], *StructType.fromDDL("audit string, sha256 string").fields])
    return ordered.mapInArrow(run, schema)
