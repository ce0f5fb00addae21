"""Places of regular-expression matches in a text, by built-in functions only.

A text is marked around its matches and split at the marks, so pieces alternate between plain text and match;
summed lengths give the places in code points. Patterns are written so that the regular-expression engine
neither backtracks nor recurses over long runs: possessive repeats, and starts tied to the start of a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

MARK, OTHER = "\u0001", "\u0002"
#: Lengths are summed by blocks, so many matches in a text cost far less than the square of their number.
BLOCK = 64

SPAN = "struct<start:bigint,kind:int,end:bigint,score:double>"


@dataclass(frozen=True)
class Kind:
    """What one kind of span is.

    valid(match) keeps a match; score(match, before, after) rates it by the plain text on its two sides;
    gate(text) is a cheap test without which no match is possible.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    score: Callable[[Column, Column, Column], Column] = lambda m, before, after: F.lit(1.0)


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start,kind,end,score>> of the valid matches of one kind; never null."""

    def places(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p).cast("long"))
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

        def by_blocks(n: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.size(n).cast("int").__sub__(1)), lambda b: F.when(b % BLOCK == 0, total(F.slice(n, b + 1, F.lit(BLOCK)))))
            return let(F.filter(blocks, lambda b: b.isNotNull()), lambda sums: found(n, sums))

        def found(n: Column, sums: Column) -> Column:
            def one(i: Column) -> Column:
                at = i * 2 + 1
                start = total(F.slice(sums, F.lit(1), F.floor(at / BLOCK).cast("int"))) + total(F.slice(n, F.floor(at / BLOCK).cast("int") * BLOCK + 1, at % BLOCK))
                match = F.get(pieces, at)
                keep = kind.valid(match)
                score = kind.score(match, F.substring(F.get(pieces, at - 1), -40, 40), F.substring(F.get(pieces, at + 1), 1, 24))
                return F.when(keep, F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.get(n, at)).alias("end"), score.alias("score")))

            many = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / 2).cast("int") - 1)
            return F.filter(F.transform(many, one), lambda s: s.isNotNull())

        return F.when(F.size(pieces) > 1, let(lengths, by_blocks))

    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    marked = F.regexp_replace(clean, kind.pattern, f"{MARK}$0{MARK}")
    return F.coalesce(F.when(kind.gate(text), let(F.split(marked, MARK, -1), places)), F.array().cast(f"array<{SPAN}>"))


def digest(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span in the array's order, joined by commas."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_kind(spans: Column) -> Column:
    """The spans by kind, then place."""
    turned = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return F.array_sort(turned)


def count_of(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == order)).cast("long")
