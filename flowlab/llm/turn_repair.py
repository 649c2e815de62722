"""Cheapest repair of the turn structure of conversations, by Four-Russians block tables.

A row of a conversation is one of nine symbols: to be deleted (blank or duplicate), or the initial of
its role (s, u, a, other), cut off or not. The roles that remain must read `(s?(ua)+)?`, which a
machine of four states accepts. Read from the end, the costs of finishing from each state form a
vector, and one more row maps vectors to vectors. The entries of a vector differ by bounded
amounts (any state can be left for another by few edits), so, less their smallest entry, there are
only a few vectors. The tables hold for every block of up to BLOCK symbols and every vector the
vector before the block and the state in which each state leaves the block.

A conversation is taken block by block from its end, by lookup. Then each block is expanded backward
from the vector stored behind it, and its edits are read forward: at each place the ASCII-least
edit that is still cheapest, so ties are safe without comparing audits.

Rows are range-partitioned by conversation and turn. A conversation that spans slices is composed:
each slice gives its map of vectors and states, a few numbers per slice are folded, and each
slice is then traced on its own. Equal rows are merged first into one row with a count: all but
the first are duplicates, which change no vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import SPACE, bounded_batches
from flowlab.sources.staging import stage

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, S, U, A = range(4)
INITIALS = "sua"
# The state after a user or assistant turn that comes next.
NEXT = {START: U, S: U, U: A, A: U}
LETTER = {U: "u", A: "a"}
ROLE = {"u": "user", "a": "assistant"}
SYMBOLS = 9
FORCED = 0
ENDING = (0, 2 * INSERT, INSERT, 0)
FIRST_CHARS = 200
BLANKS = " \t\n\v\f\r"


def kept_state(state: int, symbol: int) -> int | None:
    """Where a kept row leads, if it may stand here."""
    initial = (symbol - 1) // 2
    if initial == 0:
        return S if state == START else None
    return NEXT[state] if initial == NEXT[state] - 1 else None


class Step(NamedTuple):
    """One row read from one state: roles inserted before it, its edit, the new role, the state after it."""

    before: str
    edit: str
    role: str
    state: int


def _costs(symbol: int, after: tuple) -> tuple:
    """Costs from each state before a row, given those after it."""
    cut = CUT if symbol and symbol % 2 == 0 else 0
    here = [DELETE + c for c in after]
    if symbol != FORCED:
        for state in range(4):
            kept = kept_state(state, symbol)
            if kept is not None:
                here[state] = min(here[state], KEEP + cut + after[kept])
            here[state] = min(here[state], REROLE + cut + after[NEXT[state]])
    out = list(here)
    out[U], out[A] = min(here[U], INSERT + here[A]), min(here[A], INSERT + here[U])
    out[START], out[S] = min(here[START], INSERT + out[U]), min(here[S], INSERT + out[U])
    return tuple(out)


def _step(symbol: int, state: int, here: tuple, after: tuple) -> Step:
    """The ASCII-least cheapest edits: D, I, K, R."""
    cut, before = (CUT if symbol and symbol % 2 == 0 else 0), ""
    while True:
        left = here[state]
        if DELETE + after[state] == left:
            return Step(before, "D", "", state)
        if INSERT + here[NEXT[state]] == left:
            state = NEXT[state]
            before += LETTER[state]
            continue
        kept = kept_state(state, symbol)
        if kept is not None and KEEP + cut + after[kept] == left:
            return Step(before, "K", "", kept)
        return Step(before, "R", ROLE[LETTER[NEXT[state]]], NEXT[state])


class Tables:
    """Vectors less their smallest entry, single steps, and per block length the vector before and the
    states after a block, for every vector behind it."""

    def __init__(self, block: int):
        self.vectors: list[tuple] = [ENDING]
        known = {ENDING: 0}
        rows: list[list[int]] = []
        self.steps: list[list[list[Step]]] = []
        for after in self.vectors:  # grows as new vectors turn up
            to, steps = [], []
            for symbol in range(SYMBOLS):
                here = _costs(symbol, after)
                least = tuple(c - min(here) for c in here)
                if least not in known:
                    known[least] = len(self.vectors)
                    self.vectors.append(least)
                to.append(known[least])
                steps.append([_step(symbol, state, here, after) for state in range(4)])
            rows.append(to)
            self.steps.append(steps)
        self.before = [np.arange(len(rows))[None, :], np.array(rows).T]
        one = np.array([[[s.state for s in states] for states in steps] for steps in self.steps]).transpose(1, 0, 2)
        self.after = [np.broadcast_to(np.arange(4), (1, len(rows), 4)), one]
        for _ in range(1, block):
            # A row in front of a block: first the row from each state, then the block.
            behind, left = self.before[-1], self.after[-1]
            self.before.append(self.before[1][:, behind].reshape(-1, len(rows)))
            first = one[:, behind]  # symbol, block, vector, state
            both = np.take_along_axis(np.broadcast_to(left, first.shape), first, axis=-1)
            self.after.append(both.reshape(-1, len(rows), 4))


@cache
def tables() -> Tables:
    return Tables(BLOCK)


def coded(symbols: list[int]) -> list[tuple[int, int]]:
    """(length, number) of each block."""
    out = []
    for i in range(0, len(symbols), BLOCK):
        number, part = 0, symbols[i : i + BLOCK]
        for s in part:
            number = number * SYMBOLS + s
        out.append((len(part), number))
    return out


def segment_map(symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every vector behind a run of rows: the vector before it, and the state after it from each state."""
    t = tables()
    vector, state = np.arange(len(t.vectors)), np.tile(np.arange(4), (len(t.vectors), 1))
    for length, number in reversed(coded(symbols)):
        state = np.take_along_axis(state, t.after[length][number, vector], axis=1)
        vector = t.before[length][number, vector]
    return vector, state


def trace(symbols: list[int], ending: int = 0, state: int = START) -> list[Step]:
    """The edits of a run of rows, given the vector behind it and the state before it."""
    t, behind, vector = tables(), [], ending
    blocks = coded(symbols)
    for length, number in reversed(blocks):
        behind.append(vector)
        vector = int(t.before[length][number, vector])
    out = []
    for i in range(len(blocks)):
        part, inner = symbols[i * BLOCK : (i + 1) * BLOCK], [behind[-1 - i]]
        for s in reversed(part[1:]):
            inner.append(int(t.before[1][s, inner[-1]]))
        for s, v in zip(part, reversed(inner)):
            out.append(t.steps[v][s][state])
            state = out[-1].state
    return out


def finish(state: int) -> str:
    """Roles inserted at the end."""
    return {START: "", S: "ua", U: "a", A: ""}[state]


def _named(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def faults(df: DataFrame) -> DataFrame:
    """(at, slice, conv, conv_id, turn, role, text, copies, fault, symbol), staged: rows in order of conversation, turn (null first),
    role and text (by its first FIRST_CHARS characters, then a digest); equal rows as one with their number.
    fault is that of the first copy: blank, duplicate (role and text seen earlier), truncated or none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", role, text).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    rows = stage(rows.withColumns({"conv": _named("conv_id"), "digest": digest}), "repair-rows")
    seen = rows.groupBy("conv", "digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(seen.drop("_n"), ["conv", "digest"], "left")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(~F.col("text").rlike(SPACE.replace("[", "[^", 1)), "blank")
        .when(F.col("_first").isNotNull() & (place > F.col("_first")), "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    )
    rows = rows.withColumn("fault", fault)
    kind = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        kind = F.when(F.col("role").startswith(letter), i).otherwise(kind)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).otherwise(1 + 2 * kind + (F.col("fault") == "truncated").cast("int"))
    order = ["conv", "turn", "role", "_start", "digest"]
    rows = rows.withColumns({"symbol": symbol.cast("int"), "_start": F.substring("text", 1, FIRST_CHARS)})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition number in the upper bits, row number in the lower ones: the order as a number.
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())
    return stage(numbered.select(
        "at", F.shiftright("at", 33).alias("slice"), "conv", "conv_id", "turn", "role", "text", "copies", "fault", "symbol"
    ), "repair-faults")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one conversation in one slice, whose symbols are held together."""
    now: dict[str, list] | None = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            one = dict(zip(columns, row))
            if now is None or one["conv"] != now["conv"][0] or one["slice"] != now["slice"][0]:
                if now:
                    yield now
                now = {c: [] for c in columns}
            for c in columns:
                now[c].append(one[c])
    if now:
        yield now


def _sliced(narrow: DataFrame) -> DataFrame:
    return narrow.repartition("slice").sortWithinPartitions("at")


def _edges(rows: DataFrame) -> DataFrame:
    """(conv, slice, vectors, states): the maps of the first and the last conversation of each slice, which alone may go on
    in another slice."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, None
        for run in _runs(batches, ["at", "slice", "conv", "symbol"]):
            if run["slice"][0] == here:
                last = run
                continue
            if last:
                yield _edge(last)
            yield _edge(run)
            here, last = run["slice"][0], None
        if last:
            yield _edge(last)

    schema = "conv string, slice bigint, vectors array<int>, states array<int>"
    out = _sliced(rows.select("at", "slice", "conv", "symbol")).mapInArrow(edges, schema)
    return stage(out, "repair-edges")


def _edge(run: dict) -> pa.RecordBatch:
    kinds = {"conv": pa.string(), "slice": pa.int64(), "vectors": pa.list_(pa.int32()), "states": pa.list_(pa.int32())}
    vectors, states = segment_map(run["symbol"])
    values = [run["conv"][0], run["slice"][0], vectors.tolist(), states.ravel().tolist()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values())], list(kinds))


def _joints(edges: DataFrame) -> DataFrame:
    """(conv, slice, ending, state, last) for conversations in several slices: one row per slice is folded."""
    several = edges.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slice").reset_index(drop=True)
        vector, endings = 0, []
        for vectors in frame["vectors"][::-1]:
            endings.append(vector)
            vector = int(vectors[vector])
        state, states = START, []
        for maps, ending in zip(frame["states"], reversed(endings)):
            states.append(state)
            state = int(maps[4 * ending + state])
        last = [False] * (len(frame) - 1) + [True]
        return pd.DataFrame({"conv": frame["conv"], "slice": frame["slice"], "ending": endings[::-1], "state": states, "last": last})

    schema = "conv string, slice bigint, ending int, state int, last boolean"
    return stage(edges.join(several, "conv").groupBy("conv").applyInPandas(fold, schema), "repair-joints")


def edits(df: DataFrame) -> DataFrame:
    """Every row of (conv_id, turn, role, text) with its edit in the cheapest repair of its conversation.

    Gives the columns of `faults`, and before (initials of the empty turns inserted before the row), edit (K, R or D; further
    copies are D), new_role (for R) and after (initials inserted at the end of the conversation).
    Costs: keep 0, rerole 1, delete 2, insert 5, and 5 for a cut-off row that stays; blank and
    duplicate rows must go. Null roles and texts are empty; a null conv_id is a conversation of
    its own; an empty table gives an empty one; further columns do not matter.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = faults(df)
    joints = _joints(_edges(rows))
    columns = ["at", "slice", "conv", "symbol", "ending", "state", "last"]
    narrow = rows.select("at", "slice", "conv", "symbol").join(joints, ["conv", "slice"], "left")
    narrow = narrow.fillna({"ending": 0, "state": START, "last": True})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, columns):
            steps = trace(run["symbol"], run["ending"][0], run["state"][0])
            after = [""] * len(steps)
            if run["last"][0]:
                after[-1] = finish(steps[-1].state)
            lists = [run["at"], [s.before for s in steps], [s.edit for s in steps], [s.role for s in steps], after]
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(lists, kinds)], ["at", "before", "edit", "new_role", "after"])

    schema = "at bigint, before string, edit string, new_role string, after string"
    found = _sliced(narrow.select(columns)).mapInArrow(traced, schema)
    return rows.join(stage(found, "repair-edits"), "at")


def repaired_turns(edited: DataFrame) -> DataFrame:
    """(conv_id, at, place, role, text): the turns that remain, in order of (at, place)."""
    def empty(letters: str) -> Column:
        letter = F.filter(F.split(letters, ""), lambda x: x != "")
        return F.transform(letter, lambda x: F.struct(F.when(x == "u", ROLE["u"]).otherwise(ROLE["a"]).alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role"))
    own = F.filter(F.array(F.struct(role.alias("role"), "text")), lambda x: F.col("edit") != "D")
    turns = F.concat(empty("before"), own, empty("after"))
    return edited.select("conv_id", "at", F.posexplode(turns).alias("place", "turn")).select("conv_id", "at", "place", "turn.role", "turn.text")


class Report:
    """One conversation, row by row; holds counts, its audit and a hash state."""

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.first = self.turn = self.initial = None
        self.audit, self.hash, self.joint = [], hashlib.sha256(), b""

    def _out(self, role: str, text: str) -> None:
        self.hash.update(self.joint + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.joint = b"\n"

    def _insert(self, letters: str) -> None:
        for x in letters:
            self._out(ROLE[x], "")
        self.audit.append("I" * len(letters))
        self.cost += INSERT * len(letters)

    def add(self, turn, role: str, text: str, copies: int, fault: str, before: str, edit: str, new_role: str, after: str) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial, self.illegal = role[:1], self.illegal + copies - 1
        if fault != "none":
            setattr(self, fault, getattr(self, fault) + 1)
        again = "blank" if fault == "blank" else "duplicate"
        setattr(self, again, getattr(self, again) + copies - 1)
        self._insert(before)
        self.audit.append(edit + "D" * (copies - 1))
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + DELETE * (copies - 1) + (CUT if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self._out(new_role if edit == "R" else role, text)
        self._insert(after)

    def values(self) -> list:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        counts = [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost]
        return [self.conv_id, *counts, "".join(self.audit), self.hash.hexdigest()]


def reports(edited: DataFrame) -> DataFrame:
    """One row per conversation with rows: gaps in its turns, faults, adjacent roles that may not follow each
    other, cost, audit and digest of its repair. A digest reads its conversation as a stream, in one task; only
    the audit, one letter per row, is held."""
    kind = edited.schema["conv_id"].dataType
    columns = ["turn", "role", "text", "copies", "fault", "before", "edit", "new_role", "after"]
    rows = edited.select("conv", "conv_id", "at", *columns).repartition("conv").sortWithinPartitions("conv", "at")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type = None, None
        for b in batches:
            done, id_type = [], b.schema.field("conv_id").type
            for conv, conv_id, *row in zip(*(b.column(c).to_pylist() for c in ("conv", "conv_id", *columns))):
                if now is None or now.conv != conv:
                    done += [now] if now else []
                    now = Report(conv, conv_id)
                now.add(*row)
            yield _reported(done, id_type)
        if now:
            yield _reported([now], id_type)

    schema = f"conv_id {kind.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return rows.mapInArrow(report, schema)


def _reported(done: list[Report], id_type: pa.DataType) -> pa.RecordBatch:
    rows = [d.values() for d in done]
    kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], Report.names)


def reports_of_all(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """`reports` of rows, with a row of zeros for every conv_id of `conversations` that has none there."""
    found = reports(edits(rows)).withColumn("conv", _named("conv_id")).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("conv", _named("conv_id"))
    out = every.join(found, "conv", "left").drop("conv")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.fillna(0, zero).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
