"""Hierarchical multi-length packing of tokenised documents into context windows.

Documents are routed by length to tiers of 256, 512, 1024 and 2048 tokens; what is longer gives full windows of the
longest tier first and its remainder is routed. Each tier is then packed into windows of its own length, from the
longest to the shortest: a window starts with the tier's longest piece left, which fills more than half of it (the
shortest tier holds all smaller lengths), and the gap is filled from the shorter tiers, longest fitting piece first. A
piece is cut only where none fits, to end a window exactly; its rest is routed again. What is left at the end of a batch
is less than one window of some tiers: it becomes full windows of smaller powers of two, so nothing is padded.

Windows of one tier are dealt to step groups of about GROUP * WINDOW tokens and near-equal attention cost, so a training step
has windows of one length only.

Each task packs the rows of its own input split, a bounded number of tokens at a time, so nothing is shuffled and
no step sees the whole table. Ids of sequences
carry the number of the split; a task that runs again makes the same ones.

Nulls and edges: a null or empty text is the end token alone; a null doc_id is kept; repeated rows are packed each;
a very long text is many full windows and one remainder; of pieces of one length the last put is taken first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec

WINDOW = 2048
TIERS = (256, 512, 1024, WINDOW)
#: Tokens that a task holds while it packs them (4 bytes each).
HELD = 2_000_000
#: Windows of WINDOW tokens of a step group; of a shorter tier it has as many more.
GROUP = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: (document's place in the batch, start, length)
Piece = tuple[int, int, int]


class _Shelf:
    """Pieces by length."""

    def __init__(self):
        self.lengths: list[int] = []
        self.pieces: dict[int, list[Piece]] = {}

    def put(self, piece: Piece) -> None:
        n = piece[2]
        if n not in self.pieces:
            insort(self.lengths, n)
            self.pieces[n] = []
        self.pieces[n].append(piece)

    def take(self, room: int, over: int = 0) -> Piece | None:
        """The longest piece of at most `room` and more than `over`, if there is one."""
        at = bisect_right(self.lengths, room) - 1
        if at < 0 or self.lengths[at] <= over:
            return None
        n = self.lengths[at]
        stack = self.pieces[n]
        piece = stack.pop()
        if not stack:
            del self.pieces[n]
            self.lengths.pop(at)
        return piece

    def cut(self, room: int) -> Piece | None:
        """The first `room` tokens of the shortest piece; its rest stays."""
        if not self.lengths:
            return None
        doc, start, length = self.take(self.lengths[0])
        if length > room:
            self.put((doc, start + room, length - room))
        return doc, start, min(room, length)


def pack(lengths: list[int]) -> list[tuple[int, list[Piece]]]:
    """Windows (tier, pieces) of documents of these lengths. A piece is cut only to end a window exactly."""
    windows: list[tuple[int, list[Piece]]] = []
    left: list[Piece] = []
    shelf = _Shelf()
    for doc, n in enumerate(lengths):
        full = n - n % WINDOW
        windows += [(WINDOW, [(doc, s, WINDOW)]) for s in range(0, full, WINDOW)]
        if n > full:
            shelf.put((doc, full, n - full))
    for tier, below in zip(reversed(TIERS), (*reversed(TIERS[:-1]), 0)):
        while piece := shelf.take(tier, below):
            window, room = [piece], tier - piece[2]
            while room and (piece := shelf.take(room) or shelf.cut(room)):
                window.append(piece)
                room -= piece[2]
            if room:
                left += window
            else:
                windows.append((tier, window))
    return windows + _by_powers(left)


def _by_powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a batch, too few for a window of their tier, as full windows of falling powers of two."""
    out: list[tuple[int, list[Piece]]] = []
    rest, used = list(pieces), sum(p[2] for p in pieces)
    for tier in (1 << k for k in range(WINDOW.bit_length() - 1, -1, -1)):
        while used >= tier:
            used -= tier
            window, room = [], tier
            while room:
                doc, start, n = rest.pop(0)
                window.append((doc, start, min(n, room)))
                if n > room:
                    rest.insert(0, (doc, start + room, n - room))
                room -= min(n, room)
            out.append((tier, window))
    return out


def step_groups(windows: list[tuple[int, list[Piece]]], first: int) -> list[int]:
    """Group of each window, numbered from `first`: the windows of a tier go, by falling attention cost, to and fro over its groups."""
    out = [0] * len(windows)
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        cost = {i: sum(p[2] ** 2 for p in windows[i][1]) for i in own}
        groups = -(-len(own) * tier // (GROUP * WINDOW))
        for k, i in enumerate(sorted(own, key=lambda i: (-cost[i], i))):
            lap, place = divmod(k, groups)
            out[i] = first + (place if lap % 2 == 0 else groups - 1 - place)
        first += groups
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """One row per piece; see SCHEMA. Ids are those of the tokenizer file at `path`, then end_id."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.load(path)
        task = TaskContext.get().partitionId() << 36
        state = {"sequence": 0, "group": 0}

        def emit(held: list[tuple[object, bytes]]) -> pd.DataFrame:
            lengths = [len(ids) // 4 for _, ids in held]
            windows = pack(lengths)
            groups = step_groups(windows, state["group"])
            rows = []
            for (tier, pieces), group in zip(windows, groups):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), lengths[doc], task + state["sequence"], offset, tier, task + group))
                    offset += n
                state["sequence"] += 1
            state["group"] += max(groups, default=state["group"] - 1) - state["group"] + 1
            columns = list(zip(*rows))
            out = pd.DataFrame({name.split()[0]: np.array(c, dtype="int32" if "int" == name.split()[1] else "int64") for name, c in zip(SCHEMA.split(", ")[1:], columns[1:])})
            out.insert(0, "doc_id", pd.array(columns[0], dtype="Int64"))
            return out

        held, tokens = [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                ids = codec.encode(text) + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= HELD:
                    yield emit(held)
                    held, tokens = [], 0
        if held:
            yield emit(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, SCHEMA)
