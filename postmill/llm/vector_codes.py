"""Integer product codes of vectors, trained by Lloyd rounds that bounds keep short (Drake and Hamerly, 2012).

A vector x becomes whole numbers floor(SCALE * x), cut into PARTS consecutive parts; every part has a codebook of up to
ENTRIES entries. For each part of each vector a round keeps the b closest entries in order, an upper bound of the distance
to the first, lower bounds of the others, and one outer bound below every entry that is not listed. When the entries move,
bounds move with them; a part whose upper bound stays below the next lower bound keeps its entry unseen. Otherwise the
listed entries up to the first bound above it are measured, and only if the outer bound is reached all of them. Bounds are
floats rounded away from the value, so they decide only what is certain; what they leave open is decided by distances in
whole numbers, ties to the lower index. The result is that of plain Lloyd rounds, digit for digit.

b is adapted per part: a round counts how many entries its parts had to look at, and the next keeps just so many (2 to half of the
entries) that at most one part in RARE needs more.

Each round is one pass over a table in the shared folder that holds vectors and bounds; the pass writes the next table, with the
sums of each task as rows of their own, and the one before is deleted. Only codebooks (at most PARTS * ENTRIES entries) and
their summed parts meet the driver.

Nulls and edges: vectors that are null or empty, or hold null or non-finite components, or have another length than that of the
smallest kept vec_id, take no part; parts of a length that PARTS does not divide differ by one; null vec_ids are kept, and come
last where the first entries are chosen; repeated rows count each; with fewer than ENTRIES vectors the codebooks are as
short; components too large for 64-bit distances are reckoned in whole numbers of any size, without bounds, and an error beyond a
long is the largest long; null labels are one label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, steps

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: At most one part in so many may need more entries than are listed before the list is kept longer.
RARE = 64
LARGEST = 2**63 - 1
#: Sums of any size travel as limbs of so many bits.
LIMB_BITS, LIMBS = 60, 20


def whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python integers."""
    if not exact:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    flat = [SCALE * n // d for n, d in (float(v).as_integer_ratio() for v in x.ravel())]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _roots(squares: np.ndarray, upper: bool) -> np.ndarray:
    """Distances from squared ones, rounded to the safe side; integers of any size get bounds that decide nothing."""
    if squares.dtype == object:
        return np.full(squares.shape, np.inf if upper else 0.0, dtype=np.float32)
    return (_up if upper else _down)(np.sqrt(squares.astype(np.float64)))


class Bounds:
    """The b closest entries of n parts: `near` in order, `upper` of the first, `low` of the others and, last, of all not listed."""

    def __init__(self, near: np.ndarray, upper: np.ndarray, low: np.ndarray):
        self.near, self.upper, self.low = near, upper, low

    @staticmethod
    def fresh(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        square = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        order = np.argsort(square, axis=1, kind="stable")
        ranked = np.take_along_axis(square, order, axis=1)
        low = np.full((len(x), b), np.inf, dtype=np.float32)
        rest = _roots(ranked[:, 1 : b + 1], upper=False)
        low[:, : rest.shape[1]] = rest
        return Bounds(order[:, :b].astype(np.uint8), _roots(ranked[:, 0], upper=True), low)

    def moved(self, moves: np.ndarray, b: int) -> None:
        """Entries have moved by `moves`; from now on b of them are listed."""
        self.upper = _up(self.upper + moves[self.near[:, 0]])
        low = self.low.astype(np.float64)
        low[:, :-1] -= moves[self.near[:, 1:]]
        low[:, -1] -= moves.max()
        # From the outer bound inwards: a bound holds for its own entry and all after it.
        self.low = _down(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1])[:, :b]
        self.near = self.near[:, :b]

    def settle(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Make the first entry the nearest; returns how many entries each part had to look at (b + 1: all)."""
        b = self.near.shape[1]
        looked = np.ones(len(x), dtype=np.int64)
        open_ = np.flatnonzero(~(self.upper < self.low[:, 0]))
        if len(open_):
            self.upper[open_] = _roots(((x[open_] - book[self.near[open_, 0]]) ** 2).sum(axis=1), upper=True)
            looked[open_] += (self.upper[open_, None] >= self.low[open_]).sum(axis=1)
        for z in np.unique(looked[looked > 1]):
            rows = np.flatnonzero(looked == z)
            if z > b:
                new = Bounds.fresh(x[rows], book, b)
                self.near[rows], self.upper[rows], self.low[rows] = new.near, new.upper, new.low
                continue
            listed = self.near[rows, :z]
            square = ((x[rows, None, :] - book[listed]) ** 2).sum(axis=2)
            order = np.lexsort((listed, square))
            ranked = np.take_along_axis(square, order, axis=1)
            self.near[rows, :z] = np.take_along_axis(listed, order, axis=1)
            self.upper[rows] = _roots(ranked[:, 0], upper=True)
            self.low[rows, : z - 1] = _roots(ranked[:, 1:], upper=False)
        return looked


def _rows(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1).copy()


def _bytes(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x)]


class Training:
    """What the tasks of a round need to know; small."""

    def __init__(self, books: list[np.ndarray], edges: list[int], exact: bool, float_type: str):
        self.books, self.edges, self.exact, self.float_type = books, edges, exact, float_type
        size = len(books[0])
        self.listed = [max(min(2, size), size // 2)] * PARTS
        self.before: list[int] | None = None
        self.moves: list[np.ndarray] = []

    def part(self, x: np.ndarray, p: int) -> np.ndarray:
        return x[:, self.edges[p] : self.edges[p + 1]]

    def bounds(self, batch: pd.DataFrame, x: np.ndarray) -> tuple[list[Bounds], list[np.ndarray]]:
        """Bounds of every part that hold for the codebooks of now, and how many entries were looked at."""
        if self.before is None:
            found = [Bounds.fresh(self.part(x, p), self.books[p], self.listed[p]) for p in range(PARTS)]
            return found, [np.ones(len(x), dtype=np.int64)] * PARTS
        at = np.cumsum([0, *self.before])
        near, upper, low = _rows(batch["near"], "u1"), _rows(batch["upper"], "<f4"), _rows(batch["low"], "<f4")
        found, looked = [], []
        for p in range(PARTS):
            own = Bounds(near[:, at[p] : at[p + 1]], upper[:, p].copy(), low[:, at[p] : at[p + 1]])
            own.moved(self.moves[p], self.listed[p])
            looked.append(own.settle(self.part(x, p), self.books[p]))
            found.append(own)
        return found, looked

    def round(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The next table of a task's rows, then its sums and the counts of entries looked at."""
        limbs = LIMBS if self.exact else 1
        sums = [np.zeros(b.shape, dtype=object if self.exact else np.int64) for b in self.books]
        counts = np.zeros((PARTS, len(self.books[0])), dtype=np.int64)
        needs = np.zeros((PARTS, ENTRIES + 2), dtype=np.int64)
        for batch in batches:
            x = whole(_rows(batch["vec"], self.float_type), self.exact)
            found, looked = self.bounds(batch, x)
            for p, own in enumerate(found):
                code = own.near[:, 0]
                np.add.at(sums[p], code, self.part(x, p))
                counts[p] += np.bincount(code, minlength=counts.shape[1])
                needs[p] += np.bincount(looked[p], minlength=needs.shape[1])
            out = batch[["vec_id", "label", "vec"]].copy()
            out["near"] = _bytes(np.hstack([o.near for o in found]))
            out["upper"] = _bytes(np.column_stack([o.upper for o in found]))
            out["low"] = _bytes(np.hstack([o.low for o in found]))
            yield out.assign(kind="row", part=0, entry=0, place=0, limb=0, value=0)
        told = [("count", p, e, 0, 0, int(n)) for p, row in enumerate(counts) for e, n in enumerate(row) if n]
        told += [("need", p, 0, z, 0, int(n)) for p, row in enumerate(needs) for z, n in enumerate(row) if n]
        for p, own in enumerate(sums):
            for (e, i), v in np.ndenumerate(own):
                for limb in range(limbs):
                    last = limb == limbs - 1
                    told.append(("sum", p, e, i, limb, int(v) >> LIMB_BITS * limb if last else (int(v) >> LIMB_BITS * limb) % 2**LIMB_BITS))
        out = pd.DataFrame(told, columns=["kind", "part", "entry", "place", "limb", "value"])
        yield out.assign(vec_id=None, label=None, vec=None, near=None, upper=None, low=None)

    def finish(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Codes and errors by the last codebooks."""
        for batch in batches:
            x = whole(_rows(batch["vec"], self.float_type), self.exact)
            found, _ = self.bounds(batch, x)
            error = sum(((self.part(x, p) - self.books[p][own.near[:, 0]]) ** 2).sum(axis=1) for p, own in enumerate(found))
            code = [row.tobytes().hex() for row in np.column_stack([own.near[:, 0] for own in found])]
            yield batch[["vec_id", "label"]].assign(code=code, error=[min(int(e), LARGEST) for e in error])

    def learn(self, told: DataFrame) -> None:
        """Move the entries to their floored means and adapt the lists, from the summed rows of a round."""
        total = told.groupBy("kind", "part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v"))
        found = {tuple(r)[:5]: int(r.v) for r in total.collect()}
        self.moves, self.before = [], list(self.listed)
        for p, book in enumerate(self.books):
            new = book.copy()
            for e in range(len(book)):
                n = found.get(("count", p, e, 0, 0), 0)
                for i in range(book.shape[1] if n else 0):
                    new[e, i] = sum(found.get(("sum", p, e, i, limb), 0) << LIMB_BITS * limb for limb in range(LIMBS)) // n
            moved = ((new - book) ** 2).sum(axis=1)
            self.moves.append(np.zeros(len(book)) if self.exact else np.nextafter(np.sqrt(moved.astype(np.float64)), np.inf))
            self.books[p] = new
            needs = {z: n for (kind, part, _, z, _), n in found.items() if kind == "need" and part == p}
            total_needs = sum(needs.values())
            fit = next(z for z in range(1, ENTRIES + 2) if sum(n for y, n in needs.items() if y > z) * RARE <= total_needs)
            if sum(needs.get(z, 0) for z in needs if z > 1):
                self.listed[p] = max(min(2, len(book)), min(self.listed[p], fit))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for v in book.ravel()).encode()).hexdigest()


def kept_vectors(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))).select("vec_id", "label", "embedding")


def train(vectors: DataFrame, cut) -> tuple[DataFrame, Training] | None:
    """The table of the last round and the trained codebooks; None if no vector is kept."""
    spark = vectors.sparkSession
    rows = kept_vectors(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    if not first:
        return None
    length = len(first[0].embedding)
    rows = rows.where(F.size("embedding") == length)
    if any(len(r.embedding) != length for r in first):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    edges = [p * length // PARTS for p in range(PARTS + 1)]
    reach = 2 * (SCALE * int(largest) + SCALE)
    exact = max(b - a for a, b in zip(edges, edges[1:])) * reach**2 >= 2**62
    float_type = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    start = whole(np.array([r.embedding for r in first], dtype=float_type), exact)
    training = Training([start[:, a:b] for a, b in zip(edges, edges[1:])], edges, exact, float_type)

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, dtype=float_type).tobytes() for x in v])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    schema = f"{kinds}, vec binary, near binary, upper binary, low binary, kind string, part int, entry int, place int, limb int, value long"
    now = rows.select("vec_id", "label", packed("embedding").alias("vec"))
    for _ in range(ROUNDS):
        # The next table is made from the last one, which `cut` then replaces.
        told = cut(now.mapInPandas(training.round, schema), "round")
        training.learn(told.where("kind <> 'row'"))
        now = told.where("kind = 'row'").select("vec_id", "label", "vec", "near", "upper", "low")
    return now, training


def encode_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    with steps(spark, "vector-codes", generations=2) as own:
        trained = train(vectors, own)
        if trained is None:
            return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
        last, training = trained
        coded = cut(last.mapInPandas(training.finish, f"{kinds}, code string, error long"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(LARGEST)).cast("long").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(training.digest()).alias("codebooks_sha256"))
