"""Language-model scores by context-tree weighting over bytes, beside a word-count score.

Every byte is eight binary decisions. Each decision has a context tree over the last DEPTH bytes; each node of it a
Krichevsky-Trofimov estimate from its zeros and ones. A node's weighted probability is the mean of its own estimate
and the product of its children's (Willems, Shtarkov, Tjalkens, 1995), so all depths are mixed, with weights that the
training data determine. The trees are learned from all training texts and then frozen; a text's score is the sum of
log10 probabilities of its bytes and of its end. The end is one more byte, MARK, which UTF-8 never uses; it also stands
DEPTH times before each text as the context of its first bytes. So the scores of all texts are one distribution.

The trees are tables that grow with the corpus; no task and no driver holds them. Each task counts its own cells
(context and byte), which are summed by key; every depth is then a grouped sum over the depth below it, and the mixing
weights come back from the root by joins. Cells that only scored texts have are in the tables with count zero, so an
unseen context is the estimate 1/2 at its own depth, without special cases.

Most bytes of a text are looked up in memory: cells that make at least 1 / HOT_CELLS of all bytes are sent to the
executors (at most HOT_CELLS of them, 12 bytes each: 96 MB whatever the corpus), words of at least 1 / HOT of all tokens
likewise. Every other cell and word of a text is joined with its figure; none of those is a hot key.

Nulls and edges: a null or empty text is its end alone; a very long text is read in slices; a null id has remainder 0
(training); repeated rows each return and each count; without training rows all counts are 0 and every bit costs one bit;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remainder, steps

#: Bytes of context; context and byte leave two bytes of a long free up to 5.
DEPTH = 5
#: The end of a text, and what stands before it.
MARK = b"\xff"
#: Input splits that one counting task reads at most.
SPLITS = 4
#: Words of at least 1/HOT of all tokens are looked up in memory; there are at most HOT of them.
HOT = 1_000_000
#: Cells of at least 1/HOT_CELLS of all bytes are looked up in memory; there are at most HOT_CELLS of them.
HOT_CELLS = 8_000_000
#: Distinct words, and distinct cells, that a task holds before it hands their counts on.
HELD, HELD_CELLS = 400_000, 2_000_000
#: Bytes that are turned into cells at a time.
SLICE = 1 << 22


def _cells(data: np.ndarray) -> np.ndarray:
    """Context * 256 + byte of each byte after the first DEPTH ones, which serve as context only."""
    n = len(data) - DEPTH
    out = np.zeros(n, dtype=np.int64)
    for k in range(DEPTH + 1):
        out <<= 8
        out |= data[k : k + n]
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after DEPTH marks and before one, in one array; the index of each text's first byte."""
    lead = MARK * DEPTH
    sizes = np.array([len(t) + DEPTH + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(lead + (MARK + lead).join(texts) + MARK, dtype=np.uint8), np.cumsum(sizes) - sizes + DEPTH


def _batches(texts: Iterator[str]) -> Iterator[list[bytes]]:
    """Texts as bytes, in groups of about SLICE bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _is_text(starts: np.ndarray, n: int) -> np.ndarray:
    """False for the marks before each text."""
    keep = np.ones(n, dtype=bool)
    for k in range(1, DEPTH + 1):
        keep[starts - k] = False
    return keep


class _CellCounts:
    """Counts of cells in training texts (n) and in all texts (seen), merged now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, texts: list[bytes], trains: bool) -> None:
        data, starts = _joined(texts)
        keep = _is_text(starts, len(data))
        for at in range(0, len(data) - DEPTH, SLICE):
            part = data[at : at + SLICE + DEPTH]
            found, seen = np.unique(_cells(part)[keep[at + DEPTH : at + len(part)]], return_counts=True)
            self.parts.append((found, seen if trains else np.zeros_like(seen), seen))
            self.size += len(found)
        if self.size > 2 * HELD_CELLS:
            self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        cells, n, seen = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, dtype=np.int64)
        sums = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, seen))
        self.parts = [(cells[first], *sums)]
        self.size = len(first)

    def take(self) -> Iterator[pd.DataFrame]:
        self.merge()
        for cells, n, seen in self.parts:
            for at in range(0, len(cells), 1 << 19):
                to = slice(at, at + (1 << 19))
                yield pd.DataFrame({"word": pd.Series([None] * len(cells[to]), dtype=object), "cell": pd.array(cells[to], dtype="Int64"), "n": n[to], "seen": seen[to]})
        self.parts, self.size = [], 0


def corpus_counts(rows: DataFrame) -> DataFrame:
    """word, cell, n, seen from held_out and text: of each training word (empty: text ends) its count n; of each cell
    its count n in training texts and its count seen in all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        cells = _CellCounts()

        def counted() -> pd.DataFrame:
            n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            out = pd.DataFrame({"word": pd.Series(list(words), dtype=object), "cell": pd.array([None] * len(words), dtype="Int64"), "n": n, "seen": n})
            words.clear()
            return out

        for b in batches:
            held = b["held_out"].to_numpy(dtype=bool)
            for texts in _batches(b["text"][~held]):
                for t in texts:
                    words.update(t.lower().split())
                words[b""] += len(texts)
                cells.add(texts, True)
                if len(words) >= HELD:
                    yield counted()
            for texts in _batches(b["text"][held]):
                cells.add(texts, False)
            if cells.size > HELD_CELLS:
                cells.merge()
                if cells.size > HELD_CELLS:
                    yield from cells.take()
        yield counted()
        yield from cells.take()

    # Fewer, longer tasks: counts that one task has summed need not be moved. Nothing is shuffled for it. A task reads at
    # most SPLITS splits, so a lost one costs as little on a large corpus.
    splits = rows.rdd.getNumPartitions()
    few = rows.select("held_out", "text").coalesce(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS)))
    found = few.mapInPandas(run, "word binary, cell long, n long, seen long")
    return found.groupBy("word", "cell").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight places up, for x > 0."""
    product = x
    for k in range(1, 8):
        product = product * (x + F.lit(float(k)))
    z = x + F.lit(8.0)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + F.lit(1 / 12) / z - F.lit(1 / 360) / (z * z * z) - F.log(product)


def _log_kt(a: Column, b: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - F.lit(math.log(math.pi))


def _decisions(cells: DataFrame) -> DataFrame:
    """The eight decisions of each cell: node (context * 256 + the bits so far after a leading one) and the bit."""
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).withColumn("head", F.expr("cast(shiftright(cell & 255, 7 - i) as int)"))
    return rows.withColumns({"node": F.expr("(cell - (cell & 255)) + shiftleft(1, i) + shiftright(head, 1)"), "bit": F.expr("head & 1")}).drop("head", "i")


def _cut_context(node: str, depth: int) -> Column:
    """The node of the same decision whose context is the last `depth` bytes."""
    return F.col(node).bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))


def cell_logs(cells: DataFrame, cut=cut) -> DataFrame:
    """cell, seen and log (log10 probability of its byte in its context) from cell, n and seen.

    Cells are dealt out once, by the last DEPTH - 1 bytes of their context (`up`; at most 65,536 cells each): the two
    deepest levels are grouped there, on the way up and on the way down, without moving their eight rows a cell."""
    half, one = F.lit(math.log(0.5)), (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    last = DEPTH - 1
    dealt = cells.select("cell", "n", "seen", F.expr(f"shiftright(cell, 8) & {(1 << 8 * last) - 1}L").alias("up")).repartition("up")
    split = _decisions(dealt)
    zeros, ones = F.when(F.col("bit") == 0, F.col("n")).otherwise(0), F.when(F.col("bit") == 1, F.col("n")).otherwise(0)

    def weigh(sums: DataFrame) -> DataFrame:
        """node, a, b, own, deep and total from node, a, b and below."""
        known = sums.select("node", "a", "b", (half + _log_kt(F.col("a"), F.col("b"))).alias("own"), (half + F.col("below")).alias("deep"))
        return cut(known.withColumn("total", F.greatest("own", "deep") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("deep"))))), "tree")

    leaves = split.groupBy("up", "node").agg(F.sum(zeros).alias("a"), F.sum(ones).alias("b"))
    leaves = leaves.select("up", _cut_context("node", last).alias("node"), "a", "b", _log_kt(F.col("a"), F.col("b")).alias("total"))
    levels = {last: weigh(leaves.groupBy("up", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("total").alias("below")))}
    for d in range(last - 1, -1, -1):
        levels[d] = weigh(levels[d + 1].groupBy(_cut_context("node", d).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("total").alias("below")))
    above = None
    for d in range(DEPTH):
        now = levels[d].select("node", one.alias("one"), F.exp(F.col("own") - F.col("total")).alias("stop"), F.exp(F.col("deep") - F.col("total")).alias("go"))
        if above is None:
            now = now.withColumns({"part": F.lit(0.0), "weight": F.lit(1.0)})
        else:
            now = now.withColumn("parent", _cut_context("node", d - 1)).join(above, "parent")
        above = now.select(F.col("node").alias("parent"), (F.col("part") + F.col("weight") * F.col("stop") * F.col("one")).alias("part"), (F.col("weight") * F.col("go")).alias("weight"))
    # One row for each `up`, of at most 255 decisions.
    entries = F.collect_list(F.struct(F.expr("cast(parent & 255 as int)").alias("at"), F.struct("part", "weight").alias("mix")))
    above = above.groupBy(F.shiftright("parent", 8).alias("up")).agg(F.map_from_entries(entries).alias("mixes"))
    own = Window.partitionBy("up", "node")
    sums = split.withColumns({"a": F.sum(zeros).over(own), "b": F.sum(ones).over(own)}).join(above, "up")
    mixed = sums.select("up", "cell", "seen", "bit", one.alias("one"), F.col("mixes")[F.expr("cast(node & 255 as int)")].alias("mix"))
    p = F.col("mix.part") + F.col("mix.weight") * F.col("one")
    logs = mixed.withColumn("p", F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    logs = logs.groupBy("up", "cell").agg(F.first("seen").alias("seen"), F.sum(F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("log"))
    return logs.drop("up")


def _gathered(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and logarithms of a bounded table. They come as packed arrays, 12 bytes a cell, so the driver never
    holds rows or frames of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, values = [], []
        for b in batches:
            cells.append(b["cell"].to_numpy(dtype=np.int64))
            values.append(b["log"].to_numpy(dtype=np.float32))
        if cells:
            yield pd.DataFrame({"cells": [np.concatenate(cells).tobytes()], "logs": [np.concatenate(values).tobytes()]})

    parts = logs.mapInPandas(run, "cells binary, logs binary").collect()
    return tuple(np.frombuffer(b"".join(p[name] for p in parts), dtype=kind) for name, kind in (("cells", np.int64), ("logs", np.float32)))


class Table:
    """Logarithms of the frequent cells, by cell."""

    def __init__(self, cells: np.ndarray, logs: np.ndarray):
        order = np.argsort(cells)
        # A last entry that no cell equals keeps every search inside.
        self.cells = np.append(cells[order], np.int64(np.iinfo(np.int64).max))
        self.logs = np.append(logs[order], np.float32(0))

    def spots(self, cells: np.ndarray) -> np.ndarray:
        """Where each cell is, or would be. Cells are looked up in sorted chunks: the search then walks the table in order."""
        n, chunk = len(cells), 1 << 16
        packed = np.zeros(-(-n // chunk) * chunk, dtype=np.uint64)
        packed[:n] = cells
        packed = (packed.reshape(-1, chunk) << np.uint64(16)) | np.arange(chunk, dtype=np.uint64)
        packed.sort(axis=1)
        at = (packed & np.uint64(chunk - 1)).astype(np.int64) + np.arange(len(packed))[:, None] * chunk
        out = np.empty(packed.size, dtype=np.int64)
        out[at.ravel()] = np.searchsorted(self.cells, (packed >> np.uint64(16)).astype(np.int64).ravel())
        return out[:n]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text the sum over the cells of the table, and its other cells."""
        if not texts:
            return np.zeros(0), []
        data, starts = _joined(texts)
        keep = _is_text(starts, len(data))
        log, places, rest = np.zeros(len(data), dtype=np.float32), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(data) - DEPTH, SLICE):
            part = data[at : at + SLICE + DEPTH]
            cells = _cells(part)
            spot = self.spots(cells)
            known, own = self.cells[spot] == cells, keep[at + DEPTH : at + len(part)]
            log[at + DEPTH : at + len(part)] = np.where(known & own, self.logs[spot], 0)
            other = np.flatnonzero(~known & own)
            places.append(other + at + DEPTH)
            rest.append(cells[other])
        cuts = np.searchsorted(np.concatenate(places), starts[1:])
        return np.add.reduceat(log, starts, dtype=np.float64), np.split(np.concatenate(rest), cuts)


def score_documents(docs: DataFrame, held: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    with steps(docs.sparkSession, "context-trees") as own:
        return cut(_scores(docs, held, own), "scores")


def _scores(docs: DataFrame, held: int, cut) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", (remainder("doc_id", held) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = cut(corpus_counts(rows), "counts")
    words = counts.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, below = int(total["n"]), total["n"] + 0.5 * (total["v"] + 1)
    hot = words.where((F.col("n") * HOT >= tokens) | (F.length("word") == 0)).toPandas()
    cells = counts.where("cell is not null").select("cell", "n", "seen")
    size = int(cells.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0])
    with steps(spark, "trees") as own:
        tree = cut(cell_logs(cells, own), "cell-logs")
    found = Table(*_gathered(tree.where(F.col("seen") * HOT_CELLS >= size).select("cell", "log")))
    logs = np.log10((hot["n"].to_numpy(dtype=np.float64) + 0.5) / below)
    ready = spark.sparkContext.broadcast(({bytes(w): x for w, x in zip(hot["word"], logs)}, found))
    del hot, logs, found  # the executors have them now
    unknown = math.log10(0.5 / below)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model = ready.value
        end = known.get(b"")
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            n_tokens, n_known, base, tails = [], [], [], []
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            for t in texts:
                own = t.lower().split()
                found = list(map(known.get, own, repeat(None)))
                tail = [w for w, x in zip(own, found) if x is None]
                sums = [x for x in found if x is not None]
                n_tokens.append(len(own) + 1)
                n_known.append(len(sums) + (end is not None))
                base.append(math.fsum(sums) + (unknown if end is None else end))
                tails.append(tail)
            score, rest = model.scores(texts)
            yield pd.DataFrame(
                {
                    "uid": np.arange(uid, uid + len(b)),
                    "doc_id": b["doc_id"].astype("Int64"),
                    "held_out": b["held_out"],
                    "n_tokens": n_tokens,
                    "n_known": n_known,
                    "base_score": base,
                    "score": score,
                    "bytes": [len(t) for t in texts],
                    "tail": tails,
                    "rest": rest,
                }
            )
            uid += len(b)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bytes long, tail array<binary>, rest array<long>"
    scored = cut(rows.mapInPandas(run, schema), "scored")
    rare = words.where((F.col("n") * HOT < tokens) & (F.length("word") > 0))
    c = F.coalesce("n", F.lit(0))
    by_word = scored.select("uid", F.explode("tail").alias("word")).join(rare, "word", "left")
    by_word = by_word.select("uid", F.log10((c + 0.5) / F.lit(below)).alias("base"), F.col("n").isNotNull().cast("int").alias("known"), F.lit(0.0).alias("log"))
    by_cell = scored.select("uid", F.explode("rest").alias("cell")).join(tree.where(F.col("seen") * HOT_CELLS < size), "cell")
    by_cell = by_cell.select("uid", F.lit(0.0).alias("base"), F.lit(0).alias("known"), "log")
    joined = by_word.unionByName(by_cell).groupBy("uid").agg(F.sum("base").alias("tail_base"), F.sum("known").alias("tail_known"), F.sum("log").alias("rest_score"))
    whole = scored.drop("tail", "rest").join(joined, "uid", "left").withColumn("score", F.col("score") + F.coalesce("rest_score", F.lit(0.0)))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
        (F.col("score") / F.lit(-math.log10(2)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
