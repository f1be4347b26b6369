"""Repair of conversation structure at the least cost, by lazy weighted determinisation.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?`` and none of its turns is
blank, repeated or cut off. Edits have costs; a small automaton says which role may come next. Where
several edits are open, the determinised automaton has the vector of the least costs from each state
of the small one; less its minimum, such a vector is one of a handful, whatever the conversation.
These vectors become states when they are first met, and a table remembers where each kind of turn
leads and what it costs. So the scan over a conversation is one look-up a turn.

The scan reads each conversation from its last turn and notes the vector that lies ahead of every
turn. The trace goes back over the scan, hence from the first turn on; an edit is tight if its cost and
the cost ahead add up to the least. Of several tight edits the one with the least initial is taken, which
gives the least audit.

Rows are dealt by conversation and sorted there, first backward for the scan, then forward for the
trace; both read them as a stream and remember one turn, so a conversation of any length fits. Repeats
within a conversation are found by a window over the same partitioning: texts are shuffled once.

Defined cases: a null role or text counts as one blank; rows without a conv_id form a conversation;
equal turns (nulls first) are ordered by role and text; rows that repeat are duplicates of the first;
a conversation that is only named (``ids``) has zeros and an empty audit; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.shared import WORD, plain, table

#: The small automaton of ``(s?(ua)+)?``: where a role's initial leads from each state, and the states where it may end.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Roles that may be written by an edit.
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
OK, CUT_OFF, GONE = 0, 1, 2
FAULTS = ("blank", "duplicate", "truncated")
SOUND_PAIRS = ("su", "ua", "au")


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Automaton:
    """The determinised automaton: vectors as tuples of costs less their minimum, arcs as they are needed."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        far = sum(vars(costs).values()) * 8
        self.last = self.closed([0 if q in ENDS else far for q in range(len(MOVES))])
        self.arcs: dict[tuple, tuple] = {}
        self.edits: dict[tuple, tuple] = {}

    def closed(self, v: list[int]) -> tuple[int, ...]:
        """With inserted turns wherever they are cheaper."""
        changed = True
        while changed:
            changed = False
            for q, moves in enumerate(MOVES):
                for role in ROLES:
                    if role in moves and v[moves[role]] + self.costs.insert < v[q]:
                        v[q], changed = v[moves[role]] + self.costs.insert, True
        return tuple(v)

    def choices(self, q: int, kind: int) -> Iterator[tuple[str, int, int, str | None]]:
        """(initial, cost, next state, new role) of each edit that takes in a turn of this kind."""
        initial, fault, c = INITIALS[kind // 3], kind % 3, self.costs
        yield "D", c.delete, q, None
        if fault != GONE:
            more = c.truncated * (fault == CUT_OFF)
            if initial in MOVES[q]:
                yield "K", more, MOVES[q][initial], None
            for role in ROLES:
                if role in MOVES[q]:
                    yield "R", c.rerole + more, MOVES[q][role], role

    def arc(self, ahead: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
        """The vector before a turn, less its minimum, and that minimum."""
        if (ahead, kind) not in self.arcs:
            v = self.closed([min(cost + ahead[to] for _, cost, to, _ in self.choices(q, kind)) for q in range(len(MOVES))])
            self.arcs[ahead, kind] = tuple(x - min(v) for x in v), min(v)
        return self.arcs[ahead, kind]

    def inserts(self, q: int, v: tuple[int, ...]) -> Iterator[tuple[str, int, int, str]]:
        yield from (("I", self.costs.insert, MOVES[q][r], r) for r in ROLES if r in MOVES[q] and v[MOVES[q][r]] + self.costs.insert == v[q])

    def tight(self, q: int, ahead: tuple[int, ...], kind: int) -> tuple[tuple[tuple[str, str | None], ...], int]:
        """The least of the cheapest edits up to and with a turn, as (initial, new role), and the state behind it."""
        if (q, ahead, kind) not in self.edits:
            v, least = self.arc(ahead, kind)
            v, out, at, edit = tuple(x + least for x in v), [], q, "I"
            while edit == "I":
                tight = [(e, to, role) for e, cost, to, role in self.choices(at, kind) if cost + ahead[to] == v[at]]
                edit, to, role = min(tight + [(e, to, r) for e, _, to, r in self.inserts(at, v)], key=lambda x: x[0])
                out.append((edit, role))
                at = to
            self.edits[q, ahead, kind] = tuple(out), at
        return self.edits[q, ahead, kind]

    def ending(self, q: int) -> list[tuple[str, str]]:
        """The turns inserted after the last one."""
        out = []
        while q not in ENDS:
            edit, _, q, role = next(self.inserts(q, self.last))
            out.append((edit, role))
        return out


def marked(conversations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Each row with its fault and its kind, all rows of a conversation in one partition; a row without a kind only names one."""
    d = plain(conversations, ["conv_id", "turn", "role", "text"])
    d = d.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(True).alias("real"))
    if ids is not None:
        names = plain(ids, ["conv_id"]).distinct()
        d = d.unionAll(names.select("conv_id", F.lit(None).cast("long"), F.lit(""), F.lit(""), F.lit(False)))
    d = d.repartition("conv_id")
    nth = F.row_number().over(W.partitionBy("conv_id", "real", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    blank, whole = ~F.col("text").rlike(WORD), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("real"), None).when(blank, FAULTS[0]).when(F.col("nth") > 1, FAULTS[1]).when(~whole, FAULTS[2])
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    fate = F.when(F.col("fault").isin(*FAULTS[:2]), GONE).when(F.col("fault") == FAULTS[2], CUT_OFF).otherwise(OK)
    return d.withColumn("nth", nth).withColumn("fault", fault).withColumn("kind", F.when(F.col("real"), initial * 3 + fate).cast("int"))


ORDER = ("conv_id", "real", "turn", "role", "text", "nth")
SCANNED = "conv_id long, turn long, role string, text string, real boolean, nth int, fault string, kind int, ahead array<int>, cost long"


def scanned(rows: DataFrame, costs: Costs) -> DataFrame:
    """Adds to each row the vector ahead of it and the least cost from it on, rows being read from the last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conv, state, upto, fresh = Automaton(costs), None, None, 0, True
        for batch in batches:
            ahead, cost = [], []
            for c, kind in zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                if fresh or c != conv:
                    conv, state, upto, fresh = c, automaton.last, 0, False
                ahead.append(state)
                if kind is not None:
                    state, more = automaton.arc(state, kind)
                    upto += more
                cost.append(upto + state[0])
            names = [*batch.schema.names, "ahead", "cost"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ahead, pa.list_(pa.int32())), pa.array(cost, pa.int64())], names=names)

    backward = [F.col(c).desc_nulls_last() for c in ORDER]
    columns = [x.split()[0] for x in SCANNED.split(", ")][:-2]
    return rows.sortWithinPartitions(*backward).select(columns).mapInArrow(work, SCANNED)


def edited(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """(first row of its conversation?, row or None, its edits) in order; a conversation ends with row None and the last inserted turns."""
    automaton, conv, q, begun = Automaton(costs), None, 0, False
    for batch in batches:
        for row in batch.to_pylist():
            first = not begun or row["conv_id"] != conv
            if first:
                if begun:
                    yield False, None, automaton.ending(q)
                conv, q, begun = row["conv_id"], 0, True
            edits = ()
            if row["kind"] is not None:
                edits, q = automaton.tight(q, tuple(row["ahead"]), row["kind"])
            yield first, row, edits
    if begun:
        yield False, None, automaton.ending(q)


def turns(row: dict | None, edits) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that edits leave, deleted ones with the row's own."""
    for edit, role in edits:
        if edit == "I":
            yield edit, ROLES[role], ""
        else:
            yield edit, ROLES[role] if edit == "R" else row["role"], row["text"]


def traced(conversations: DataFrame, ids: DataFrame | None, costs: Costs) -> DataFrame:
    forward = [F.col(c).asc_nulls_first() for c in ORDER]
    return scanned(marked(conversations, ids), costs).sortWithinPartitions(*forward)


def repaired(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired turns: conv_id, place (from 1), turn (null if inserted), role, text, edit (K, R or I)."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "place", "turn", "role", "text", "edit"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, place = None, 0
        for first, row, edits in edited(batches, costs):
            if first:
                conv, place = row["conv_id"], 0
            for edit, role, text in turns(row, edits):
                if edit != "D":
                    place += 1
                    out.append((conv, place, row["turn"] if edit in "KR" else None, role, text, edit))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return traced(conversations, None, costs).mapInArrow(work, "conv_id long, place long, turn long, role string, text string, edit string")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(conversations: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: its faults, the cost of its repair, the edits' initials, the hash of the repaired turns."""

    names = [x.split()[0] for x in REPORT.split(", ")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[-2:] else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for first, row, edits in edited(batches, costs):
            if first:
                conv, cost, faults, illegal, before = row["conv_id"], None, dict.fromkeys(FAULTS, 0), 0, None
                lowest, highest, distinct, audit, digest, any_turn = None, None, 0, [], hashlib.sha256(), False
            if row and row["kind"] is not None:
                cost = row["cost"] if cost is None else cost
                turn, initial = row["turn"], row["role"][:1]
                if row["fault"]:
                    faults[row["fault"]] += 1
                if turn is not None and turn != highest:
                    lowest, highest, distinct = turn if lowest is None else lowest, turn, distinct + 1
                illegal += before is not None and before + initial not in SOUND_PAIRS
                before = initial
            for edit, role, text in turns(row, edits):
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) if any_turn else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    any_turn = True
            if row is None:
                gaps = highest - lowest + 1 - distinct if distinct else 0
                out.append((conv, gaps, *faults.values(), illegal, cost or 0, "".join(audit), digest.hexdigest()))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return traced(conversations, ids, costs).mapInArrow(work, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults that a hash of conversation and turn decides: dropped, emptied, without ends, repeated, or given to the user."""
    d = plain(conversations, ["conv_id", "turn", "role", "text"])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    d = d.withColumn("fate", F.crc32(key) % 20).where("fate <> 0")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("fate") == 4, "user").otherwise(role)
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times")).drop("times")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)
