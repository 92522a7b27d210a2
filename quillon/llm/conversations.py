"""Conversation structure repair by lazy weighted determinisation.

Keeping, changing, deleting and inserting turns is a small nondeterministic weighted automaton whose states are
where a legal conversation may stand (nothing yet, after a system, a user, an assistant turn). It is determinised
lazily, from the end of a conversation backwards: a deterministic state is the vector of costs to the end from
every such place, less the smallest; a transition table caches where a kind of row leads from a vector and what it
weighs, so a scan of rows is a chain of table lookups, and the weights add up to the cost. Then the rows are met in order: an edit whose
cost is exactly the difference of two costs to the end is a tight arc, and the least letter of the tight arcs at every step spells the audit.

A conversation is one sorted stream through one task, in both directions, since its digest is of a sequence. A batch
of rows is in memory at a time; what a row is (faults, role, digest of its text) is found out before, where it was read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import pick

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Places: nothing yet, after system, after user, after assistant. Where a role leads from each (None: nowhere), and the role that comes next.
START, SYSTEM, USER, ASSISTANT = range(4)
_LEADS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Adjacent role initials that are legal.
LEGAL = ("su", "ua", "au")
Vector = tuple[int, int, int, int]
#: A kind of row: its role's initial if that is s, u or a, else "-"; "t" if truncated, "x" if it must go, else "".
Kind = str


class Repairs:
    """The determinised automaton, built as far as it was walked."""

    def __init__(self) -> None:
        self.table: dict[tuple[Vector, Kind], tuple[Vector, int]] = {}
        self.end = self._closed([0, None, None, 0])

    @staticmethod
    def _closed(costs: list[int | None]) -> Vector:
        """Costs once turns may be inserted first."""
        far = 1 << 30
        out = [far if c is None else c for c in costs]
        for _ in out:
            out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
        return tuple(out)

    @staticmethod
    def arcs(place: int, kind: Kind) -> list[tuple[str, int, int]]:
        """(letter, place it leads to, cost) of the edits that use up a row, in the order of their letters."""
        found = [("D", place, DELETE)]
        if kind != "x":
            extra = TRUNCATED if kind[1:] else 0
            to = _LEADS[place].get(kind[0])
            found += [("K", to, KEEP + extra)] if to is not None else []
            found.append(("R", NEXT[place], REROLE + extra))
        return found

    def step(self, after: Vector, kind: Kind) -> tuple[Vector, int]:
        """The vector before a row, from the one after it, and the weight of the transition."""
        known = self.table.get((after, kind))
        if known is None:
            before = self._closed([min(cost + after[to] for _, to, cost in self.arcs(q, kind)) for q in range(4)])
            least = min(before)
            known = self.table[after, kind] = tuple(c - least for c in before), least
        return known

    def trace(self, place: int, kind: Kind | None, after: Vector) -> tuple[str, int, int]:
        """(letters, place after them, cost): the least tight arcs from ``place`` over one row, or (kind None) to the end."""
        before, weight = (self.end, 0) if kind is None else self.step(after, kind)
        letters, spent = "", 0
        while True:
            cost = before[place]
            arcs = [] if kind is None else self.arcs(place, kind)
            tight = [(letter, to, c) for letter, to, c in arcs if c + after[to] == cost + weight]
            if cost == INSERT + before[NEXT[place]]:
                tight.append(("I", NEXT[place], INSERT))
            if kind is None and cost == 0:
                return letters, place, spent
            letter, place, c = min(tight)
            letters, spent = letters + letter, spent + c
            if letter != "I":
                return letters, place, spent


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) after damage: crc32 of conv:turn mod 20 says which; null roles and texts become one space.

    0 marks a row as gone (``gone``: it stays, so that no conversation is lost), 1 empties its text, 2 takes
    its ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    told = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = turns.withColumn("rule", F.crc32(told.cast("binary")) % 20)
    rows = rows.select(
        "conv", "turn", (F.col("rule") == 0).alias("gone"), F.when(F.col("rule") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("rule") <= 1, "").when(F.col("rule") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _kind() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.concat(role, F.lit("t"))).otherwise(role)


def marked(rows: DataFrame) -> DataFrame:
    """Damaged ``rows`` with fault (blank, duplicate, truncated or null: the first that holds), dealt out by conversation."""
    # what a regular text ends in is found where the row was read
    bare = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("end", F.right(bare, F.lit(1))).withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    rows = rows.repartition("conv")
    # the same dealing serves the window: a conversation's rows are together, and every text's within it
    first = F.row_number().over(Window.partitionBy("conv", "gone", "same").orderBy(F.asc_nulls_first("turn"))) == 1
    fault = F.when(F.col("end") == "", "blank").when(~first, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", F.when(~F.col("gone"), fault)).drop("same", "end")


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damaged: bool = True) -> DataFrame:
    """One row per conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows are damaged first (``damage``), unless ``damaged`` is false. They count in the order of turn (nulls
    first), ties by role and then text; rows that are equal in all of them are duplicates of each other. A
    conversation id that is null is one more conversation. Null roles and texts count as one space. A conversation
    without a row left has zeros, an empty audit and the digest of the empty text. Texts and conversations may
    have any length; extra columns are ignored, whatever their names. Empty in, empty out.
    """
    turns = pick(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    turns = turns.withColumn("turn", F.col("turn").cast("long"))
    if damaged:
        rows = damage(turns)
    else:
        rows = turns.select("conv", "turn", F.lit(False).alias("gone"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = marked(rows)
    conv = rows.schema["conv"]
    rows = rows.withColumn("kind", F.when(~F.col("gone"), _kind()))
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal rows the first stands first
    backwards = rows.sortWithinPartitions("conv", F.desc_nulls_last("turn"), F.desc("gone"), F.desc("role"), F.desc("text"), again.desc())
    more = [StructField(f"after{q}", LongType()) for q in range(4)] + [StructField("rest", LongType()), StructField("back", LongType())]
    walked = backwards.mapInArrow(_scan, StructType([*rows.schema.fields, *more]))
    forwards = walked.sortWithinPartitions("conv", F.desc("back"))
    long = [StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = StructType([StructField("conv_id", conv.dataType), *long, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    return forwards.mapInArrow(_rebuild, schema)


_NONE = object()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last to the first of each conversation, with the vector after each, the cost from before it to the end (from nothing yet), and its place in this stream."""
    repairs, now, seen = Repairs(), _NONE, 0
    vector, total = repairs.end, 0
    step = repairs.step
    for batch in batches:
        after, rest = [], []
        for conv, kind in zip(batch.column("conv").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            if conv != now:
                now, vector, total = conv, repairs.end, 0
            after.append(vector)
            if kind is not None:
                vector, weight = step(vector, kind)
                total += weight
            rest.append(total + vector[START])
        columns = list(zip(*after, strict=True)) or [[]] * 4
        arrays = [*batch.columns, *(pa.array(c, pa.int64()) for c in columns), pa.array(rest, pa.int64()), pa.array(range(seen, seen + len(rest)), pa.int64())]
        seen += len(rest)
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "after0", "after1", "after2", "after3", "rest", "back"])


class _Conversation:
    """What the forward stream has learned of the conversation that it is in."""

    def __init__(self, conv: object, cost: int, repairs: Repairs) -> None:
        self.conv, self.cost, self.repairs = conv, cost, repairs
        self.place, self.spent, self.audit, self.lines = START, 0, [], 0
        self.digest = hashlib.sha256()
        self.turns: tuple[int, int] | None = None
        self.distinct, self.last = 0, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def edit(self, kind: Kind | None, after: Vector, role: str = "", text: str = "") -> None:
        letters, place, spent = self.repairs.trace(self.place, kind, after)
        at = self.place
        for letter in letters:
            if letter == "I":
                at = NEXT[at]
                self.line(_NAMES[at], "")
            elif letter == "K":
                self.line(role, text)
            elif letter == "R":
                self.line(_NAMES[NEXT[at]], text)
        self.place, self.spent = place, self.spent + spent
        self.audit.append(letters)

    def row(self, turn: int | None, role: str, text: str, fault: str | None, kind: Kind, after: Vector) -> None:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.turns = (self.turns[0] if self.turns else turn, turn)
            if turn != self.last:
                self.distinct, self.last = self.distinct + 1, turn
        self.edit(kind, after, role, text)

    def result(self) -> tuple:
        if self.initial is not None:
            self.edit(None, self.repairs.end)
        if self.spent != self.cost:
            raise ValueError(f"conversation {self.conv}: the trace costs {self.spent}, the scan {self.cost}")
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The conversations' results from their rows in order, with the vectors of ``_scan``."""
    repairs, now, kind_of = Repairs(), None, pa.int64()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def told(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[]] * 9
        kinds = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        kind_of, found = batch.schema.field("conv").type, []
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "kind", "after0", "after1", "after2", "after3", "rest")]
        for conv, turn, role, text, fault, kind, *after, rest in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                found += [now.result()] if now else []
                now = _Conversation(conv, rest, repairs)
            if kind is not None:
                now.row(turn, role, text, fault, kind, tuple(after))
        yield told(found)
    if now:
        yield told([now.result()])
