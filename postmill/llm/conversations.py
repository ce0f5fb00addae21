"""Cheapest repair of conversations whose turns were lost, repeated or damaged.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Edits: Keep costs nothing, Rerole to user or assistant
3, Delete 4 (and is required for blank and repeated rows), Insert a user or assistant turn without text 3, anywhere; a
truncated row that stays adds 3. Of the cheapest repairs the one whose edits' initials come first in ASCII is taken.

Rows are dealt by conversation and sorted within each task by conversation and turn, the last turn first, so one pass works
backwards: it carries the cost to the end from each of four states (nothing yet, after system, after user, after assistant)
across Arrow batches, and leaves one byte for each row: the best edit there from each state. The edit's letter decides the
state that follows, so the first letter in the alphabet among the cheapest edits is always right, whatever follows. At the
first turn the bytes are read in turn order, which gives the edits, the repaired turns and their digest. Bytes and texts of a
conversation of more than HELD characters go to an unnamed temporary file of the task in blocks, and are read back block by
block, so memory holds a block and the letters of the edits. Costs between states differ by a few points at most, so
a row's step is looked up in a table that fills as it is used.

Nulls and edges: a null role or text counts as one space; rows of null conv_id are one conversation; null turns come first; rows
of one turn are in order of role, then text, in bytes; repeated rows are duplicates from the second on; a text of white space only is
blank; very long texts are read whole; roles of other or no initial can only be reroled or deleted; a
conversation whose rows are all absent gives zeros, an empty audit and the digest of nothing; an empty table gives
no rows; other columns are ignored. Duplicates are told by two 64-bit hashes of the text.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a conversation that a task keeps in memory before it writes them to its temporary file.
HELD = 4_000_000
WHITE = " \t\n\x0b\x0c\r"
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. NEXT[state] is where an inserted or reroled turn leads.
NEXT = (2, 2, 3, 2)
#: Where a kept turn of this initial leads.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 2 * INSERT, INSERT, 0)
LETTERS = "DIKR"
ROLES = {2: "user", 3: "assistant"}


@lru_cache(maxsize=None)
def step(initial: str, deleted: bool, truncated: bool, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, int]:
    """Costs to the end from each state before a row, less their least, that least, and the byte of best edits (two bits a
    state), from the costs after it."""
    extra = TRUNCATED if truncated else 0
    options: list[dict[str, int]] = []
    for state in range(4):
        own = {"D": DELETE + after[state]}
        if not deleted:
            own["R"] = REROLE + extra + after[NEXT[state]]
            if initial in KEPT[state]:
                own["K"] = extra + after[KEPT[state][initial]]
        options.append(own)
    cost = [min(own.values()) for own in options]
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(cost)]
    best = 0
    for state, own in enumerate(options):
        own["I"] = INSERT + cost[NEXT[state]]
        best |= LETTERS.index(min(x for x, c in own.items() if c == cost[state])) << 2 * state
    least = min(cost)
    return tuple(c - least for c in cost), least, best


class Tape:
    """Records that are read back last first; beyond HELD characters in a temporary file, in blocks."""

    def __init__(self) -> None:
        self.block: list[tuple] = []
        self.size, self.file, self.blocks = 0, None, []

    def add(self, record: tuple, size: int) -> None:
        self.block.append(record)
        self.size += size
        if self.size >= HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            data = marshal.dumps(self.block)
            self.blocks.append((self.file.tell(), len(data)))
            self.file.write(data)
            self.block, self.size = [], 0

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self.block)
        for at, length in reversed(self.blocks):
            self.file.seek(at)
            yield from reversed(marshal.loads(self.file.read(length)))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """One conversation, fed from its last turn to its first."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.tape = Tape()
        self.costs, self.base = END, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.later = 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if fault:
            self.faults[fault] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.first_turn:
            self.turns += 1
            self.first_turn = turn
            if self.last_turn is None:
                self.last_turn = turn
        self.costs, least, best = step(initial if initial in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated", self.costs)
        self.base += least
        self.tape.add((best, role, text), 16 + len(role) + len(text))

    def repaired(self) -> Iterator[tuple[str, str | None, str | None]]:
        """Edits in turn order: letter, role and text (of a deleted row none)."""
        state = 0
        for best, role, text in self.tape.backwards():
            while True:
                letter = LETTERS[best >> 2 * state & 3]
                if letter == "D":
                    yield letter, None, None
                    break
                if letter == "K":
                    state = KEPT[state][role[0]]
                    yield letter, role, text
                    break
                state = NEXT[state]
                yield letter, ROLES[state], "" if letter == "I" else text
                if letter == "R":
                    break
        while END[state]:
            state = NEXT[state]
            yield "I", ROLES[state], ""

    def report(self) -> dict:
        audit, digest, before = [], hashlib.sha256(), b""
        for letter, role, text in self.repaired():
            audit.append(letter)
            if role is not None:
                digest.update(before + f"{role}:{text}".encode("utf-8", "replace"))
                before = b"\n"
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost = self.base + self.costs[0]
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """The conversations of a task, each complete; one is held at a time."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "fault"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                    now.tape.close()
                now = Conversation(conv_id)
            if fault != "absent":
                now.add(None if turn is None else int(turn), role, text, fault)
    if now is not None:
        yield now
        now.tape.close()


def _sorted(conversations: DataFrame, present: Column) -> DataFrame:
    """Rows of each conversation side by side, last turn first, with their first fault; one shuffle."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), present.alias("present"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))}).repartition("conv_id")
    # The window's keys begin with the one that rows are dealt by, so it needs no shuffle of its own.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "present", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())))
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(~F.col("present"), "absent").when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "nth")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("nth"))
    # As text, because pandas turns whole numbers among nulls into floats.
    return rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "fault")


def repair_report(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conv_id: gaps, faults, illegal neighbours, cost and edits of the repair, and the digest of its turns.
    Rows that are not `present` count for nothing but their conv_id."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def rows(conversation: Conversation) -> Iterator[tuple]:
        yield tuple(conversation.report().values())

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    present = F.lit(True) if present is None else present
    found = _sorted(conversations, present).mapInPandas(_told(rows), f"conv_id string, {counts}, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (from 1), edit, role and text of every turn of the repaired conversations."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def rows(conversation: Conversation) -> Iterator[tuple]:
        kept = (edit for edit in conversation.repaired() if edit[1] is not None)
        for turn, (letter, role, text) in enumerate(kept, 1):
            yield conversation.conv_id, turn, letter, role, text

    found = _sorted(conversations, F.lit(True)).mapInPandas(_told(rows), "conv_id string, turn long, edit string, role string, text string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def _told(rows, characters: int = 1_000_000):
    """A function for mapInPandas that returns `rows` of each conversation, so many characters (or ten thousand rows) at a time."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for conversation in _streamed(batches):
            for row in rows(conversation):
                held.append(row)
                size += 100 + len(row[-1]) + len(row[-2])
                if size >= characters:
                    yield pd.DataFrame(held)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held)

    return told


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as a lossy source delivers them, by crc32 of `conv_id:turn` modulo 20: 0 is lost (present is false), 1 has no
    text, 2 no sentence ends, 3 comes twice, 4 says user; the others stay. Nulls are one space there."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), F.explode(copies).alias("copy"))
