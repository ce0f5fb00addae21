"""Conversation repair against all edit strings of small conversations, and against a recursion over whole ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from postmill.llm import conversations

NOTHING = hashlib.sha256(b"").hexdigest()
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, fault) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        stripped = text.rstrip(WHITE)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def apply(edits, rows):
    """Cost and repaired turns of an edit string, or None if it is not one."""
    cost, out, left = 0, [], list(rows)
    for e in edits:
        if e != "I" and not left:
            return None
        turn = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            cost += 3
            out.append((turn, ""))
            continue
        role, text, fault = left.pop(0)
        if e == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (fault == "truncated") + 3 * (e == "R")
        out.append((turn if e == "R" else role, text))
    initials = "".join(r[:1] or "_" for r, _ in out)
    return None if left or not re.fullmatch("(s?(ua)+)?", initials) else (cost, out)


def exhaustive(rows):
    tried = ("".join(e) for n in range(len(rows) + 4) for e in itertools.product("DIKR", repeat=n))
    return min((found[0], e, found[1]) for e in tried if (found := apply(e, rows)))


def recursive(rows):
    """The cheapest edits of longer conversations: least (cost, letters) from each row and state."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in "0a" else []
        turn = "a" if state == "u" else "u"
        if inserted < 2:
            options.append((3, "I", i, turn, inserted + 1))
        if i < len(rows):
            role, _, fault = rows[i]
            options.append((4, "D", i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                options.append((3 + extra, "R", i + 1, turn, 0))
                if role[:1] == turn or (state == "0" and role[:1] == "s"):
                    options.append((extra, "K", i + 1, role[0], 0))
        found = []
        for o in options:
            if len(o) == 2:
                found.append(o)
            elif (rest := best(*o[2:])) is not None:
                found.append((o[0] + rest[0], o[1] + rest[1]))
        return min(found, default=None)

    cost, edits = best(0, "0", 0)
    again = apply(edits, rows)
    assert again[0] == cost
    return cost, edits, again[1]


def brute(rows):
    """The contract's columns for rows of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by[conv]
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            own += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        marked = faults([r[1:] for r in own])
        turns = {r[0] for r in own if r[0] is not None}
        count = {f: sum(x[2] == f for x in marked) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, turns_out = recursive(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_out).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, cost, edits, digest))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, fault string, present int, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, 9) for r in rows], SCHEMA).repartition(3)


def made(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(["Yes.", "No!", "So what", " \n", "", None, "日本。", "Why?\t", "a.b"]) if r.random() < 0.5 else f"Text {r.random()}."
            rows.append((conv, turn if r.random() < 0.9 else None, role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, "assistant", "Hi.")]
    rows += [(700, t, ("user", "assistant")[t % 2], f"Turn {t}." * (1 + t % 3)) for t in range(300)]
    rows += [(2**60 + i, 2**60 + 3 * i + j, "user", "Big.") for i in range(3) for j in range(2)]
    rows += [(701, 5, "assistant", "b " * 50_000 + "."), (701, 5, "user", "Ask."), (701, 5, "user", "Ask.")]
    # A conversation that loses all it has.
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "Gone.")], lost


def test_edits_against_all_edit_strings():
    r = random.Random(1)
    for _ in range(150):
        rows = faults([(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["A.", "B", " ", f"{r.random()}."])) for _ in range(r.randint(0, 4))])
        now = conversations.Conversation(1)
        for role, text, fault in reversed(rows):
            now.add(None, role, text, fault)
        cost, edits, out = exhaustive(rows)
        assert (now.base + now.costs[0], "".join(e for e, _, _ in now.repaired())) == (cost, edits)
        assert [(a, b) for _, a, b in now.repaired() if a is not None] == out
        assert recursive(tuple(rows)) == (cost, edits, out)


@pytest.mark.parametrize("held", [conversations.HELD, 200])
def test_report_against_recursion(spark, monkeypatch, held):
    rows, lost = made()
    if held == 200:  # the stream itself, with blocks in the temporary file
        monkeypatch.setattr(conversations, "HELD", held)
        frames = conversations._sorted(conversations.damage(frame(spark, rows)), F.col("present")).toPandas()
        found = [(c.conv_id and int(c.conv_id), *list(c.report().values())[1:]) for c in conversations._streamed(frames.iloc[i : i + 7] for i in range(0, len(frames), 7))]
    else:
        found = [tuple(r) for r in conversations.repair_report(conversations.damage(frame(spark, rows)), F.col("present")).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert (lost, 0, 0, 0, 0, 0, 0, "", NOTHING) in found


def test_turns_are_those_of_the_report(spark):
    rows, _ = made(5, 12)
    clean = frame(spark, rows)
    turns = conversations.repaired_turns(clean).collect()
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (str(t.conv_id), t.turn)):
        by[t.conv_id].append(f"{t.role}:{t.text}")
    for r in conversations.repair_report(clean).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(by[r.conv_id]).encode()).hexdigest()


def test_empty_and_one_shuffle(spark):
    df = frame(spark, made()[0])
    assert conversations.repair_report(df.limit(0)).count() == 0
    plan = conversations.repair_report(conversations.damage(df), F.col("present"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
