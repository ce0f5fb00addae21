"""Approximate nearest neighbours: an inverted file of coarse cells with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (SAMPLE rows of smallest hash). Every
row is indexed: its nearest of about 4 * sqrt(rows) cells (at most CELLS), and one code per sub-vector of its residual. How
many cells a query visits is measured, not guessed, and on the queries themselves, which need not be like the other rows: the true
neighbours of ASKED of them among all rows are found in one pass, and as many of the nearest cells are visited as hold the
share `recall` of them. A query's rows there are ranked by asymmetric distances (its own residual, table-looked-up against the
codes), and the best CANDIDATES of each block get exact distances on the original vectors, in double precision. Each row's code
carries its error, the distance between its vector and what the code stands for; so a code bounds the distance from below, and every
row whose bound is not above the distances found is ranked exactly too. Codes thus never lose a neighbour in the cells visited, whatever
the dimension, the scales and the clusters of the rows. All but exact distances are of vectors less the sample's median, so that
rows far from the origin keep their digits.

Neighbouring cells are dealt together in blocks of at most about BLOCK rows and QUERIES queries, and a query is sent once to a
block with the numbers of its cells there. A cell that holds a third of all rows is many blocks, and no group of rows is
larger than its block. Inside a block copies of one vector count once for the candidates
and come back, smallest ids first, in the result: copies never crowd out other vectors.

Nulls and edges: a null id, and vectors that are null, empty, zero, of another dimension than most of the sample, or
hold null or non-finite components, take no part; an id that occurs again counts once per query, at its
smallest distance, and asks with the vector of smallest bytes; ties go to the smaller id; with fewer than k other rows all are returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, steps

SAMPLE = 20_000
#: Bound on the coarse cells.
CELLS = 4096
#: Queries whose true neighbours are looked up.
ASKED = 400
#: Rows whose distances to all centroids are held at a time.
ROWS = 2_048
PARTS, CODES = 16, 256
CANDIDATES = 64
BLOCK, QUERIES = 2_048, 1_024


def usable(vector: Column) -> Column:
    """True for a vector that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centre."""
    own, gap = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for at in range(0, len(x), ROWS):
        d = _squared(x[at : at + ROWS], centres)
        own[at : at + ROWS] = d.argmin(1)
        gap[at : at + ROWS] = d.min(1)
    return own, gap


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cell takes the row farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, gap = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centres


class Index:
    """Coarse centroids and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.middle = np.median(sample, axis=0)
        self.centres = k_means(sample - self.middle, cells)
        rest = sample - self.middle - self.centres[self.cells(sample)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [k_means(rest[:, c], CODES, rounds=8) for c in self.cuts]

    def probes(self, asking: np.ndarray, of: np.ndarray, cells: np.ndarray, recall: float) -> int:
        """Cells to visit so that this share of known neighbours is found: neighbour i, of row of[i] of `asking`, lies in cells[i]."""
        place = np.argsort(np.argsort(_squared(asking - self.middle, self.centres), axis=1, kind="stable"), axis=1)
        needed = np.sort(place[of, cells])
        return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1 if len(needed) else 1

    def visits(self, queries: np.ndarray, probes: int, ids_in: np.ndarray, least: int) -> list[np.ndarray]:
        """The nearest cells of each query, and more of them until they hold `least` ids."""
        order = np.argsort(_squared(queries - self.middle, self.centres), axis=1, kind="stable")
        enough = np.minimum((np.cumsum(ids_in[order], axis=1) < least).sum(axis=1) + 1, order.shape[1])
        return [o[:m] for o, m in zip(order, np.maximum(min(probes, order.shape[1]), enough))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x - self.middle, self.centres)[0]

    def codes(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows, and their errors: the distances between the rows and what their codes stand for."""
        rest = x - self.middle - self.centres[cells]
        codes = np.stack([_squared(rest[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            rest[:, c] -= b[codes[:, i]]
        return codes, np.sqrt((rest * rest).sum(axis=1))

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances (queries x parts x codes) of the queries' residuals in a cell to the codebooks."""
        rest = queries - self.middle - self.centres[cell]
        out = np.full((len(queries), len(self.books), CODES), np.inf)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, i, : len(b)] = _squared(rest[:, c], b)
        return out


def search_block(index: Index, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, visited: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, among those of the cells it visits: query_id, vec_id, score."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    # Ids of each vector, every one once; an id of several vectors takes up several of the nearest.
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    group, ids = group[fresh], ids[fresh]
    begins = np.searchsorted(group, np.arange(len(first) + 1))
    wanted = (k + 1) * int(np.unique(ids, return_counts=True)[1].max())
    cells, codes, errors, exact = cells[first], codes[first].astype(np.int64), errors[first], vectors[first].astype(np.float64)
    queries = queries.astype(np.float64)
    # Asymmetric distances of all queries to the rows of the cells they visit, cell by cell, and bounds from below.
    rough, least = np.full((2, len(queries), len(first)), np.inf)
    by_cell = np.argsort(cells, kind="stable")
    names, at = np.unique(cells[by_cell], return_index=True)
    ends = np.append(at[1:], len(cells))
    asking = np.repeat(np.arange(len(queries)), [len(v) for v in visited])
    visits = np.concatenate(visited) if len(visited) else np.zeros(0, dtype=np.int64)
    seen = np.zeros(rough.shape, dtype=bool)
    parts = np.arange(codes.shape[1])
    for cell, a, z in zip(names, at, ends):
        own, rows = asking[visits == cell], by_cell[a:z]
        step = max(1, (1 << 21) // (len(rows) * len(parts)))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            table = index.tables(queries[some], int(cell))
            gaps = np.sqrt(np.maximum(table[:, parts[None, :], codes[rows]].sum(axis=2), 0))
            length = np.sqrt(((queries[some] - index.middle - index.centres[cell]) ** 2).sum(axis=1))
            # What rounding can add up to is taken off; a bound that overflows says nothing.
            bound = gaps - errors[rows] - 1e-6 * (length[:, None] + gaps + errors[rows])
            places = np.ix_(some, rows)
            rough[places], least[places], seen[places] = gaps, np.where(np.isfinite(bound), bound, -np.inf), True
    distances = lambda q, rows: np.sqrt(((exact[rows] - queries[q]) ** 2).sum(axis=1))
    out_query, out_id, out_score = [], [], []
    for q, query_id in enumerate(query_ids):
        chosen = np.flatnonzero(seen[q])
        best = max(CANDIDATES, wanted)
        if len(chosen) > best:
            nearest = chosen[np.argpartition(rough[q, chosen], best - 1)[:best]]
            limit = np.partition(distances(q, nearest), wanted - 1)[wanted - 1]
            chosen = chosen[least[q, chosen] <= limit]
        distance = distances(q, chosen)
        limit = np.inf if len(chosen) <= wanted else np.partition(distance, wanted - 1)[wanted - 1]
        found: list[tuple[float, int]] = []
        for c, d in zip(chosen[distance <= limit], distance[distance <= limit]):
            near = ids[begins[c] : min(begins[c + 1], begins[c] + k + 1)]
            found += [(d, i) for i in near.tolist() if i != query_id]
        closest: dict[int, float] = {}
        for d, i in sorted(found):
            if len(closest) == k:
                break
            closest.setdefault(i, d)
        out_query += [query_id] * len(closest)
        out_id += closest.keys()
        out_score += closest.values()
    return pd.DataFrame({"query_id": np.array(out_query, dtype=np.int64), "vec_id": np.array(out_id, dtype=np.int64), "score": np.array(out_score, dtype=np.float64)})


def block_plan(centres: np.ndarray, rows_in: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Block of each cell and parts of each block: neighbouring cells together up to BLOCK rows, a larger cell alone in parts."""
    near = k_means(centres, max(1, min(64, int(rows_in.sum() // BLOCK) + 1)), rounds=6)
    order = np.lexsort((np.arange(len(centres)), _nearest(centres, near)[0]))
    block_of, parts, held = np.zeros(len(centres), dtype=np.int64), [], BLOCK
    for c in order:
        n = int(rows_in[c])
        if n > BLOCK or held + n > BLOCK:
            parts.append(max(1, -(-n // BLOCK)))
            held = 0
        block_of[c] = len(parts) - 1
        held += n
    return block_of, parts


def known_neighbours(indexed: DataFrame, ids: np.ndarray, asking: np.ndarray, middle: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Row of `asking` and cell of each of its k true neighbours, each id once, in `indexed`. Each task keeps its own k best."""

    asking = asking - middle

    def best(batches):
        held = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ids)
        for b in batches:
            if len(b):
                gap = _squared(asking, np.stack([np.frombuffer(v, dtype=kind) for v in b["vector"]]).astype(np.float64) - middle)
                own_ids, cells = b["vec_id"].to_numpy(), b["cell"].to_numpy(dtype=np.int64)
                gap[ids[:, None] == own_ids[None, :]] = np.inf
                for q in range(len(ids)):
                    better = np.flatnonzero(gap[q] < held[q][0][-1]) if len(held[q][0]) == k else np.arange(len(own_ids))
                    if len(better):
                        d, i, c = (np.concatenate([h, new[better]]) for h, new in zip(held[q], (gap[q], own_ids, cells)))
                        o = np.argsort(d, kind="stable")
                        o = o[np.sort(np.unique(i[o], return_index=True)[1])[:k]]
                        held[q] = d[o], i[o], c[o]
        n = [len(h[0]) for h in held]
        yield pd.DataFrame({"q": np.repeat(np.arange(len(ids)), n), **{name: np.concatenate([h[at] for h in held]) for at, name in enumerate(("gap", "vec_id", "cell"))}})

    own = indexed.mapInPandas(best, "q long, gap double, vec_id long, cell int").where(F.col("gap") < float("inf"))
    once = own.groupBy("q", "vec_id").agg(F.min(F.struct("gap", "cell")).alias("n")).select("q", "vec_id", "n.gap", "n.cell")
    near = once.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("gap", "vec_id"))).where(F.col("rank") <= k)
    found = near.select("q", "cell").toPandas()  # at most ASKED * k rows
    return found["q"].to_numpy(), found["cell"].to_numpy()


def nearest(rows: DataFrame, every: int = 100, k: int = 10, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found rows of each row whose vec_id is divisible by `every`."""
    with steps(rows.sparkSession, "neighbours") as own:
        return cut(_nearest_rows(rows, every, k, recall, own), "nearest")


def _nearest_rows(rows: DataFrame, every: int, k: int, recall: float, cut) -> DataFrame:
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    # Components keep their own precision: four bytes for floats, eight for all other numbers.
    single = isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    kind, own_type = ("<f4", T.FloatType()) if single else ("<f8", T.DoubleType())
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(own_type)).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], result)
    sizes = sample["embedding"].map(len)
    dimension = int(sizes.mode().iloc[0])
    sample = sample[sizes == dimension]
    fitted = np.stack(sample["embedding"].to_list()).astype(np.float64)
    del sample
    index = Index(fitted, int(min(CELLS, max(4, 4 * math.sqrt(good.count())))))
    del fitted
    shared = spark.sparkContext.broadcast(index)  # cells and codebooks: at most CELLS + CODES vectors

    def assign(batches):
        own = shared.value
        for b in batches:
            x = np.stack(b["embedding"].to_list()).astype(kind) if len(b) else np.zeros((0, dimension), dtype=kind)
            at = own.cells(x.astype(np.float64))
            codes, errors = own.codes(x.astype(np.float64), at)
            yield pd.DataFrame({"vec_id": b["vec_id"], "cell": at, "codes": [c.tobytes() for c in codes], "error": errors, "vector": [v.tobytes() for v in x]})

    schema = "vec_id long, cell int, codes binary, error double, vector binary"
    indexed = cut(good.where(F.size("embedding") == dimension).mapInPandas(assign, schema), "index")
    queries = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).toPandas()
    if not len(asked):
        return spark.createDataFrame([], result)
    asking = np.stack([np.frombuffer(v, dtype=kind) for v in asked["vector"]]).astype(np.float64)
    probes = index.probes(asking, *known_neighbours(indexed, asked["vec_id"].to_numpy(), asking, index.middle, k, kind), recall)
    counts = indexed.groupBy("cell").agg(F.count("*").alias("rows"), F.countDistinct("vec_id").alias("ids")).toPandas().set_index("cell")  # two numbers per cell
    rows_in, ids_in = (np.array([int(counts[n].get(c, 0)) for c in range(len(index.centres))]) for n in ("rows", "ids"))

    block_of, row_parts = block_plan(index.centres, rows_in)
    least = 4 * (k + 1)

    def probe(batches):
        own = shared.value
        for b in batches:
            out = []
            if len(b):
                x = np.stack([np.frombuffer(v, dtype=kind) for v in b["vector"]]).astype(np.float64)
                for query_id, vector, cells in zip(b["vec_id"], b["vector"], own.visits(x, probes, ids_in, least)):
                    blocks = block_of[cells]
                    out += [(query_id, vector, int(g), cells[blocks == g].astype("<i4").tobytes()) for g in np.unique(blocks)]
            yield pd.DataFrame(out, columns=["query_id", "query", "block", "cells"])

    visits = cut(queries.mapInPandas(probe, "query_id long, query binary, block int, cells binary"), "visits")
    asked = visits.groupBy("block").count().toPandas().set_index("block")["count"]  # one number per block
    plan = [(g, n, -(-int(asked[g]) // QUERIES)) for g, n in enumerate(row_parts) if g in asked.index]
    if not plan:
        return spark.createDataFrame([], result)
    # A row per block and one per cell, of which there are at most CELLS.
    blocks = F.broadcast(spark.createDataFrame(plan, "block int, row_parts int, query_parts int"))
    of_cell = F.broadcast(spark.createDataFrame([(c, int(g)) for c, g in enumerate(block_of)], "cell int, block int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(of_cell, "cell").join(blocks, "block").select("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("row_parts")).cast("int").alias("rp"), each("query_parts").alias("qp"), "vec_id", "cell", "codes", "error", "vector")
    right = visits.join(blocks, "block").select("block", each("row_parts").alias("rp"), F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int").alias("qp"), "query_id", "query", "cells")

    def search(stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(asking):
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        array = lambda s, t: np.stack([np.frombuffer(v, dtype=t) for v in s])
        visited = [np.frombuffer(c, dtype="<i4").astype(np.int64) for c in asking["cells"]]
        return search_block(shared.value, stored["vec_id"].to_numpy(), stored["cell"].to_numpy(dtype=np.int64), array(stored["codes"], np.uint8), stored["error"].to_numpy(), array(stored["vector"], kind), asking["query_id"].to_numpy(), array(asking["query"], kind), visited, k)

    keys = ["block", "rp", "qp"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
