"""Repair of conversation structure by a dynamic program over rows that stream by, sorted within each conversation.

A repaired conversation's role initials are `(s?(ua)+)?`. Edits: keep a row (0), set its role to user or assistant (2),
delete it (3; a blank or duplicate row must go), insert a row of empty text (2); a truncated row that stays costs 1 more.
Of the cheapest sequences of edits the one whose initials (K, R, D, I) come first in ASCII order is taken. What is written
so far is one of four states (nothing, s, u, a), and from a state each edit leads to one state only, so the initials tell
the whole repair.

Rows are dealt by conversation and sorted within it, once as light rows from the last turn to the first and then with
their texts from the first to the last. Over the light rows the program runs backwards: it holds the cheapest rest from
each state and notes, as one byte a row, the first edit of the best rest from each of the four. These bytes carry over
from one Arrow batch to the next and go to the shared folder in blocks of SPILL rows when a conversation is longer; the
texts then stream by, the bytes are read from the first row on, and the edits fall out with the texts of what stays. So a
task holds one block of bytes, one batch of rows and the audit of one conversation, however long that is. A conversation
is one sequence and its digest one pass over its text, so a giant one is one task's stream, with everything else about its
rows (faults, texts of rows that must go) decided before. A task that is run again writes blocks of its own.

Rows are taken by turn (nulls first), rows of one turn by role, then by text. Null roles and texts are one space; an
initial is the first character of a role, that of an empty role a space. A null conv_id is a conversation of its own. Rows
that repeat are duplicates by their role and text. Empty tables give no rows. Conversation ids of any type are carried as
text and given back in their type; columns other than the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

KEEP, RESET, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NONE, S, U, A = range(4)
#: The state that a role's initial leads to, and that of the role which may be written next.
AFTER = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
EDITS = "DIKR"  # in ASCII order; a byte holds two bits for each state
FAR = 1 << 60
#: Backpointers of so many rows are held; those of longer conversations go to the shared folder in such blocks.
SPILL = 1 << 22
WHITE = " \t\n\v\f\r"


def _closed(base: list[int], choice: list[str]) -> tuple[tuple[int, ...], int]:
    """Costs with insertions before what `choice` does, and the byte of the first edits; ties to the ASCII-least."""
    inner = {U: min(base[U], INSERT + base[A]), A: min(base[A], INSERT + base[U])}
    best = [min(base[s], INSERT + inner[NEXT[s]]) for s in range(4)]
    byte = 0
    for s in range(4):
        tied = [choice[s]] if base[s] == best[s] else []
        tied += ["I"] if INSERT + inner[NEXT[s]] == best[s] else []
        byte |= EDITS.index(min(tied)) << 2 * s
    return tuple(best), byte


#: Behind the last row: a conversation may end after nothing or after an assistant.
END_COSTS, END_BYTE = _closed([0, FAR, FAR, 0], ["D", "I", "I", "D"])


@lru_cache(maxsize=1 << 16)
def _step(rest: tuple[int, ...], initial: str, goes: bool, cut: bool) -> tuple[tuple[int, ...], int, int]:
    """Costs before a row from those behind it (less their least), what their least grows by, and the row's byte."""
    base, choice = [], []
    for s in range(4):
        options = [(DELETE + rest[s], "D")]
        if not goes:
            options.append((RESET + TRUNCATED * cut + rest[NEXT[s]], "R"))
            if (s, initial) in AFTER:
                options.append((KEEP + TRUNCATED * cut + rest[AFTER[s, initial]], "K"))
        cost, edit = min(options)
        base.append(cost)
        choice.append(edit)
    best, byte = _closed(base, choice)
    least = min(best)
    return tuple(c - least for c in best), least, byte


class Backpointers:
    """The bytes of a conversation's rows, written from the last to the first and read from the first to the last."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block, self.held, self.files = folder, block, bytearray(), []

    def add(self, byte: int) -> None:
        self.held.append(byte)
        if len(self.held) >= self.block:
            fs, path = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/{uuid.uuid4().hex}")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(bytes(self.held))
            self.files.append((fs, path))
            self.held = bytearray()

    def read(self) -> Iterator[int]:
        yield from reversed(self.held)
        while self.files:
            fs, path = self.files.pop()
            with fs.open_input_stream(path) as f:
                block = f.read()
            fs.delete_file(path)
            yield from reversed(block)


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, folder: str, block: int):
        self.back = Backpointers(folder, block)
        self.rest, self.cost = END_COSTS, 0
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.later = 0, None, None, None
        self.bytes = self.state = None
        self.audit, self.digest, self.written = bytearray(), hashlib.sha256(), 0

    def light(self, turn: str | None, initial: str, fault: str | None) -> None:
        """A row, from the last to the first."""
        if fault:
            self.counts[fault] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.later = initial
        if turn is not None and turn != self.low:
            self.turns, self.low = self.turns + 1, turn
            self.high = turn if self.high is None else self.high
        self.rest, more, byte = _step(self.rest, initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.cost += more
        self.back.add(byte)

    def _edit(self) -> str:
        return EDITS[(self.byte >> 2 * self.state) & 3]

    def _start(self) -> None:
        if self.bytes is None:
            self.cost += self.rest[NONE]
            self.bytes, self.state = self.back.read(), NONE
            self.byte = next(self.bytes, END_BYTE)

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self._edit() == "I":
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def full(self, role: str, initial: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of a row, from the first to the last, with what is inserted before it."""
        self._start()
        yield from self._inserted()
        edit = self._edit()
        if edit == "K":
            self.state = AFTER[self.state, initial]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, ROLE[self.state], text
        else:
            yield edit, None, None
        self.byte = next(self.bytes, END_BYTE)

    def end(self) -> Iterator[tuple[str, str, str]]:
        self._start()
        while self.state in (S, U):
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def note(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit += edit.encode()
        if role is not None:
            self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            self.written += 1

    def report(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = int(self.high) - int(self.low) + 1 - self.turns
        return (*self.counts.values(), self.cost, self.audit.decode(), self.digest.hexdigest())


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = {"report": "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", "turns": "key string, place long, edit string, turn long, role string, text string"}


def _streamed(folder: str, what: str, block: int):
    """mapInPandas over rows (key, phase, place, turn, initial, fault, role, text), sorted by key, phase and order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, one, out, nth = None, None, [], 0

        def take(edits, turn) -> None:
            nonlocal nth
            for edit, role, text in edits:
                if what == "report":
                    one.note(edit, role, text)
                else:
                    out.append((key, nth, edit, None if edit == "I" else turn, role, text))
                nth += 1

        def close() -> None:
            nonlocal nth
            if one is not None:
                take(one.end(), None)
                if what == "report":
                    out.append((key, *one.report()))
            nth = 0

        names = [c.split()[0] for c in SCHEMA[what].split(", ")]
        for frame in frames:
            columns = (frame[c] for c in ("key", "phase", "turn", "initial", "fault", "role", "text"))
            for k, phase, turn, initial, fault, role, text in zip(*columns):
                if one is None or k != key:
                    close()
                    key, one = k, _Conversation(folder, block)
                if phase == 1:
                    one.light(turn, initial, fault)
                elif phase == 2:
                    take(one.full(role, initial, text), None if turn is None else int(turn))
            if out:
                yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("turn",) if c in names})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("turn",) if c in names})

    return run


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """(key, turn, role, text, there, place, fault): each row's place in its conversation and its first fault. Rows that are
    not `there` only stand for their conversation."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    shown = rows.select(
        F.col(conv).cast("string").alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if there is None else F.coalesce(F.col(there), F.lit(False))).alias("there"),
    ).repartition("key")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = shown.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("there"), *order)))
    nth = F.row_number().over(Window.partitionBy("key", "there", "role", "text").orderBy("place"))
    fault = F.when(last == "", "blank").when(nth > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", F.when(F.col("there"), fault))


def _initial(role: Column) -> Column:
    return F.when(role == "", " ").otherwise(F.substring(role, 1, 1))


def _run(rows: DataFrame, what: str, block: int, names: dict) -> DataFrame:
    spark, conv = rows.sparkSession, names.get("conv", "conv_id")
    found = faults(rows, **names)
    goes = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    # phase 0: the conversation is there; 1: light, last first; 2: with texts, first first
    phases = F.when(F.col("there"), F.array(F.struct(F.lit(1).alias("phase"), (-F.col("place")).alias("at")), F.struct(F.lit(2).alias("phase"), F.col("place").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("phase"), F.lit(0).alias("at"))))
    # turns as text: a null would make floating-point numbers of them
    light = found.select("key", F.col("turn").cast("string").alias("turn"), _initial(F.col("role")).alias("initial"), "fault", "role", "text", goes.alias("goes"), F.explode(phases).alias("p"))
    light = light.select("key", "p.phase", "p.at", "turn", "initial", "fault", "role", "text", "goes")
    whole = (F.col("phase") == 2) & ~F.col("goes")
    light = light.select("key", "phase", "at", "turn", "initial", "fault", *(F.when(whole, F.col(c)).alias(c) for c in ("role", "text")))
    made = light.sortWithinPartitions("key", "phase", "at").mapInPandas(_streamed(Store(spark, "backpointers").root, what, block), SCHEMA[what])
    kind = rows.schema[conv].dataType
    return made.select(F.col("key").cast(kind).alias(conv), *(c for c in made.columns if c != "key"))


def repair(rows: DataFrame, block: int = SPILL, **names: str) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edits of every conversation in order, deleted rows with null role and
    text, inserted ones without a turn. `names` gives the columns conv, turn, role, text and there, where they differ."""
    return _run(rows, "turns", block, names)


def report(rows: DataFrame, block: int = SPILL, **names: str) -> DataFrame:
    """One row a conversation: counts of gaps, faults and illegal neighbours, the cost, the edits' initials and the SHA-256 of
    the repaired `role:text` lines. Conversations none of whose rows is `there` have zeros and empty texts."""
    return _run(rows, "report", block, names)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there): rows damaged by the checksum of `conv_id:turn` mod 20, nulls as one space: 0 drops
    a row (it is not there), 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), space)
    harm = (F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20).cast("int")
    kept = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), harm.alias("harm"))
    text_ = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = kept.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), (F.col("harm") != 0).alias("there"), "harm")
    return once.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "harm")
