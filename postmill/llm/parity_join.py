"""Jaccard links between the word n-grams of texts, by a join of parity sketches.

A text is the set of its distinct hashed WORDS-word shingles. Two sets A and B link when 100 * |A and B| >= LINK * |A or B|, which
is when their symmetric difference is at most `differ(|A| + |B|)`. A parity sketch flips one bit for each token, so two
sketches differ in no more bits than the sets differ in tokens.

Size bands. Sizes are cut into bands so wide that a set's partners lie in its band or a neighbouring one. A set takes part in the
join of its own band and of the band below, where both partners cut their sketches into the same blocks.

Pigeonhole. With t the largest difference of a band's linked pairs, t + 1 + e blocks leave at least 1 + e blocks that no
differing token falls into. The join key of a block is the exclusive or of its tokens' whole hashes, so it agrees wherever the
block's bits have to. The e spare blocks pay for blocks that say nothing: a set leaves its empty blocks out, and later
those in crowded buckets of unlike sets, if together they are at most e; otherwise it leaves out none. Of a linked pair
one partner or both keep a block that agrees, and a block's key is empty or crowded for both or neither, so none is lost.

Buckets. Keys are counted by a grouped aggregate, and members of buckets of three and more are fetched by a join; buckets of two
are their own pair. First every member is held against its bucket's most central member (the one whose other buckets are
fullest), which joins groups of near copies with one candidate per member and block. Where a bucket still holds several
components, members of different ones are compared, sketch against sketch, in tiles: the members of the largest
component are dealt over tiles, the rest goes to each of them, so a bucket costs rest x members, never members squared,
and no task holds more than two tiles. (Buckets of at most SMALL members give their few pairs without tiles.) Pairs within a component are never made. A tile returns the LIMIT nearest pairs of
each component; if there were more, the search of that bucket is repeated among the components that are still apart after verifying,
with a higher limit, until none is left out. (Buckets that gave all their pairs are done: a linked pair shares a block with one
of them, or all blocks that it shares and neither left out are searched again, so it is not lost by what happens to be crowded then.)

Verification counts the common shingles of both whole texts. Stored of every text are its size, sketch and keys (some two fifths of its
shingles); the shingle sets, which are larger than the texts, are made again from the texts of the pairs alone. Shingle sets and
keys that no pair needs are kept from the shuffle by a sieve: a bitmap of SIEVE_BITS bits, of fixed size, that lets all needed
ids pass and few others (at very many ids ever more others, which the join then drops).

Only distinct texts (by 64-bit hash) are joined, under numbers in their order: in the shuffle of the keys, which is the largest, the
rows of one task then differ in few bytes but those of the key, at any number of partitions. Copies get their component by a join at the end, which adaptive execution splits
where one text is hot.

Nulls and edges: null, empty and blank texts have no shingles and link with nothing (component_id is their doc_id); fewer than
WORDS words are one shingle; a null doc_id belongs to a component and is its id only if all ids there are null; repeated
rows return each; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, steps
from .components import components

WORDS, LINK = 4, 85
#: Buckets with more members than this outside their largest component are crowded.
CROWDED = 512
#: Buckets of so few members give all their pairs of unlike components.
SMALL = 16
#: Members of one side that a task compares with as many of the other.
TILE = 2048
#: Nearest pairs of a component that a tile returns at first.
LIMIT = 4
SIEVE_BITS = 1 << 26
#: Parts of the count of keys for each partition of other shuffles.
PARTS = 4
#: Bits of the sketches that candidates are held against, by size.
LEAST_BITS, MOST_BITS = 256, 8192
#: Words whose hashes a worker remembers.
REMEMBERED = 50_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def differ(total: int) -> int:
    """The largest symmetric difference of two linked sets of so many tokens in all."""
    return (100 - LINK) * total // (100 + LINK)


def partner(size: int) -> int:
    """The size of the largest set that can link with one of this size."""
    return size * 100 // LINK


@lru_cache(maxsize=None)
def band_starts(size: int) -> tuple[int, ...]:
    """Starts of the bands up to the one that holds `size`, and of the next."""
    starts = [1]
    while starts[-1] <= size:
        starts.append(partner(starts[-1]) + 1)
    return tuple(starts)


@lru_cache(maxsize=100_000)
def plan(size: int) -> tuple[tuple[int, int, int], ...]:
    """(band, blocks, spare blocks) of the joins that a set of this size takes part in."""
    starts = band_starts(size)
    own = len(starts) - 2
    out = []
    for band in (own - 1, own):
        top = starts[band + 1] - 1
        most = differ(top + partner(top)) if band >= 0 else 0
        # Where no difference is allowed, equal sets of unlike texts still link; they are of one band.
        if most or band == own:
            out.append((band, most + 1 + 1 + most // 8, 1 + most // 8))
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_HASHES = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 11)] if words else [], dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - WORDS + 1
    return np.unique(_mix(sum(h[i : i + n] * _ODD[i] for i in range(WORDS))))


def block_keys(tokens: np.ndarray, band: int, blocks: int, spare: int) -> tuple[np.ndarray, int]:
    """Keys of the blocks that a set enters into the join of a band, and how many more it may leave out."""
    block = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    value = np.zeros(blocks, dtype=np.uint64)
    np.bitwise_xor.at(value, block, tokens)
    held = np.bincount(block.astype(np.int64), minlength=blocks) > 0
    keys = _mix(value ^ _mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 32)))
    empty = blocks - int(held.sum())
    # Beyond the spare ones, empty blocks count like others, and nothing is left out.
    return (keys[held], spare - empty) if empty <= spare else (keys, 0)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch as 64-bit words; sixteen bits for each token that may differ, so that few tokens meet in a bit and the bound
    is near the difference itself."""
    bits = LEAST_BITS
    while bits < min(16 * differ(2 * len(tokens)), MOST_BITS):
        bits *= 2
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """A sketch of fewer words: its halves laid over each other, which adds no differing bit."""
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def sieve(ids: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test that every id of the column passes, and of others the fewer the more of SIEVE_BITS are free."""
    place = F.pmod(F.col(column), F.lit(SIEVE_BITS)) + 1
    found = ids.select(place.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    bits = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for b, part in found.collect():
        part = np.frombuffer(part, dtype=np.uint8)
        bits[(b - 1) * len(part) : b * len(part)] = part

    def passes(values: np.ndarray) -> np.ndarray:
        at = values.astype(np.int64) % (8 * len(bits))
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return passes


def _place(column: str) -> Column:
    """Place of an id in the bitmaps of `sieve_table`; numbers of texts agree in their last bits, so they are hashed."""
    return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)) + 1


def sieve_table(ids: DataFrame, column: str) -> DataFrame:
    """Such a test as a table of at most SIEVE_BITS / 32,768 bitmaps of 4 KB, for `where` and `where_not`."""
    found = ids.select(_place(column).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("sieve_bucket"))
    return found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("sieve_bits"))


def where(df: DataFrame, table: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose id passes. The test stays in the JVM: a Python one would be a second worker in each task of a stage that has one already."""
    place = _place(column)
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("sieve_bits", F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    passes = F.getbit(byte, position.bitwiseAND(7).cast("int")) == 1
    return df.join(F.broadcast(table), (F.bitmap_bucket_number(place) == F.col("sieve_bucket")) & passes, how)


def where_not(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return where(df, table, column, "left_anti")


def whole_texts(docs: DataFrame, cut) -> DataFrame:
    """hash and text of every distinct text. Only texts that occur twice are shuffled and written; the others are read
    from docs whenever they are used."""
    base = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("hash"), "text")
    often = cut(base.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1").select("hash"), "often")
    repeated = cut(sieve_table(often, "hash"), "repeated")
    return where_not(base, repeated, "hash").unionByName(cut(where(base, repeated, "hash").dropDuplicates(["hash"]), "copied"))


def text_facts(whole: DataFrame, cut) -> DataFrame:
    """sid (number), hash, n (shingles), sketch, keys of the joins one after the other, and joins (band, spare and number of keys of each) of every text."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingles(text)
                found = [(band, *block_keys(tokens, band, blocks, spare)) for band, blocks, spare in (plan(len(tokens)) if len(tokens) else ())]
                joins = [v for band, own, left in found for v in (band, left, len(own))]
                rows.append((len(tokens), sketch(tokens), np.concatenate([f[1] for f in found]).view(np.int64) if found else [], joins))
            yield pd.DataFrame({"hash": batch["hash"], **{c: [row[i] for row in rows] for i, c in enumerate(("n", "sketch", "keys", "joins"))}})

    found = whole.mapInPandas(facts, "hash long, n long, sketch array<long>, keys array<long>, joins array<int>")
    return cut(found.withColumn("sid", F.monotonically_increasing_id()), "texts")


def distinct_texts(docs: DataFrame, cut) -> DataFrame:
    """`text_facts` of the distinct texts of docs."""
    return text_facts(whole_texts(docs, cut), cut)


def keys(texts: DataFrame, passes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, sid, band and spare of the blocks of every text whose key passes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                every = np.concatenate(list(batch["keys"])).astype(np.int64)
                band, spare, held = np.concatenate(list(batch["joins"])).astype(np.int64).reshape(-1, 3).T
                frame = pd.DataFrame({"key": every, "sid": np.repeat(batch["sid"].to_numpy(), batch["keys"].map(len)), "band": np.repeat(band, held), "spare": np.repeat(spare, held)})
                yield frame[passes(every)]

    return texts.select("sid", "keys", "joins").mapInPandas(run, "key long, sid long, band int, spare int")


def key_counts(texts: DataFrame) -> DataFrame:
    """key, n (its rows) and the largest and smallest of its texts. Nearly all keys are of one text, so counting them before the shuffle
    would only fill the executors with tables: the rows go to their key first, and each of many small parts is counted there."""
    parts = PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.explode("keys").alias("key"), "sid").repartition(parts, "key")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("sid").alias("a"), F.min("sid").alias("b"))


def _bits(a: Column, b: Column) -> Column:
    """In how many bits two sketches (arrays of words) differ."""

    def halved(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    bits = F.zip_with(halved(a, b), halved(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


def near_pairs(pairs: DataFrame, facts: DataFrame, cut) -> DataFrame:
    """Those of the pairs (a, b) of texts whose sizes and sketches allow a link, with their hashes and the bits in which the sketches differ."""
    side = lambda c: facts.toDF(c, f"h_{c}", f"n_{c}", f"s_{c}")
    fits = 100 * F.least("n_a", "n_b") >= LINK * F.greatest("n_a", "n_b")
    allowed = F.floor((100 - LINK) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + LINK))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return cut(both.select("a", "b", "h_a", "h_b", allowed.alias("allowed"), _bits(F.col("s_a"), F.col("s_b")).alias("bits")).where("bits <= allowed").drop("allowed"), "near")


def verified(near: DataFrame, whole: DataFrame, cut) -> DataFrame:
    """Those of the pairs (a, b, and their hashes) of texts that link."""
    near = near.select("a", "b", "h_a", "h_b")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hash": batch["hash"], "tokens": [shingles(text).tobytes() for text in batch["text"]]})

    needed = where(whole, sieve_table(near.select(F.explode(F.array("h_a", "h_b")).alias("hash")), "hash"), "hash")
    needed = cut(needed.mapInPandas(sets, "hash long, tokens binary"), "needed")
    both = near.join(needed.toDF("h_a", "t_a"), "h_a").join(needed.toDF("h_b", "t_b"), "h_b")

    @F.pandas_udf("boolean")
    def link(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= LINK * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return cut(both.where(link("t_a", "t_b")).select("a", "b"), "links")


def linked_roots(pairs: DataFrame, facts: DataFrame, whole: DataFrame, cut) -> DataFrame:
    """node and root of the texts that the links among the pairs connect. Verified first is the nearest pair of each text; other pairs
    only where both texts are still apart."""
    near = near_pairs(pairs, facts, cut)
    least = near.select(F.explode(F.array("a", "b")).alias("sid"), "bits").groupBy("sid").agg(F.min("bits").alias("least"))
    ranked = near.join(least.toDF("a", "least_a"), "a").join(least.toDF("b", "least_b"), "b")
    ranked = cut(ranked.select("a", "b", "h_a", "h_b", ((F.col("bits") == F.col("least_a")) | (F.col("bits") == F.col("least_b"))).alias("nearest")), "ranked")
    links = verified(ranked.where("nearest"), whole, cut)
    roots = cut(components(links, cut=cut), "roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = ranked.where("not nearest").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = cut(apart.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).select("a", "b", "h_a", "h_b"), "apart")
    more = verified(apart, whole, cut)
    return joined_roots(roots, more, cut)


def joined_roots(roots: DataFrame, links: DataFrame, cut) -> DataFrame:
    """node and root after more links. Components, not texts, are joined."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    upper = cut(components(edges, cut=cut), "upper").select(F.col("node").alias("old"), F.col("root").alias("new"))
    nodes = roots.unionByName(upper.join(roots, upper.old == roots.node, "left_anti").select(F.col("old").alias("node"), F.col("old").alias("root")))
    return cut(nodes.join(upper, nodes.root == upper.old, "left").select("node", F.coalesce("new", "root").alias("root")), "roots")


def stars(members: DataFrame) -> DataFrame:
    """Pairs of every member with the most central member of its bucket."""
    weight = members.groupBy("sid").agg(F.sum(F.col("n").cast("double")).alias("weight"))
    centre = members.join(weight, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("c")).select("key", F.col("c.sid").alias("centre"))
    return members.join(centre, "key").where("sid <> centre").select(F.greatest("sid", "centre").alias("a"), F.least("sid", "centre").alias("b")).distinct()


def open_members(members: DataFrame, roots: DataFrame, cut) -> DataFrame:
    """Members of buckets that hold several components, with what is needed to tile them; crowded buckets lose the members that have
    blocks to spare."""
    known = members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    known = cut(known.select("key", "sid", "band", "spare", "root"), "known")
    sizes = known.groupBy("key", "root").agg(F.count("*").alias("c"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    buckets = buckets.select("key", F.col("most.root").alias("bulk"), F.col("most.c").alias("n_bulk"), (F.col("n") - F.col("most.c")).alias("n_rest"))
    opened = cut(known.join(buckets, "key"), "open")
    crowded = F.col("n_rest") > CROWDED
    over = opened.where(crowded).groupBy("sid", "band").agg(F.count("*").alias("n"), F.max("spare").alias("may")).where("n > may").select("sid", "band")
    return cut(opened.where(~crowded).unionByName(opened.where(crowded).join(over, ["sid", "band"], "left_semi").select(opened.columns)), "kept")


def tiles(opened: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of tile jobs (key, x, y): both sides of what is to be compared."""
    count = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    rows = opened.join(facts.drop("hash"), "sid")
    part = lambda n: F.pmod(F.xxhash64("sid", "key"), count(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    common = ["key", "sid", "root", "n", "sketch"]
    bulk = rows.where("root = bulk").select(*common, part("n_bulk").alias("x"), every("n_rest").alias("y"), F.lit(0).alias("side"))
    rest = rows.where("root <> bulk").withColumn("own", part("n_rest"))
    against = rest.select(*common, every("n_bulk").alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"))
    # Rest against rest: x is -1 - the smaller part; of one part, the rows are on both sides.
    inner = rest.select(*common, "own", every("n_rest").alias("other"))
    x, y = -1 - F.least("own", "other"), F.greatest("own", "other")
    sides = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("own") > F.col("other")).cast("int")))
    inner = inner.select(*common, x.alias("x"), y.alias("y"), F.explode(sides).alias("side"))
    return bulk.unionByName(against).unionByName(inner)


def tile_pairs(job: dict[str, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pairs of each component of one job whose sketches allow a link, and whether any were left out."""
    sides = [np.flatnonzero(job["side"] == s) for s in (0, 1)]
    if min(map(len, sides)) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    length = min(len(s) for s in job["sketch"])
    words = [np.array([folded(job["sketch"][i], length) for i in side]).view(np.uint64) for side in sides]
    sid, root, n = ([job[c][side] for side in sides] for c in ("sid", "root", "n"))
    allowed = (100 - LINK) * (n[0][:, None] + n[1][None]) // (100 + LINK)
    hits = []
    chunk = max(1, 2_000_000 // words[1].size)
    for at in range(0, len(sid[0]), chunk):
        to = at + chunk
        bits = np.bitwise_count(words[0][at:to, None] ^ words[1][None]).sum(axis=2, dtype=np.int64)
        ok = (bits <= allowed[at:to]) & (root[0][at:to, None] != root[1][None])
        i, j = np.nonzero(ok)
        hits.append(np.column_stack([i + at, j, bits[i, j]]))
    i, j, bits = np.concatenate(hits).T
    x, y, u, v = sid[0][i], sid[1][j], root[0][i], root[1][j]
    # Rows on both sides give a pair twice.
    swap = x < y
    x, y, u, v = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, v, u), np.where(swap, u, v)
    x, y, u, v, bits = np.unique(np.column_stack([x, y, u, v, bits]), axis=0).T
    # The pairs of each component, nearest first.
    pair, of = np.tile(np.arange(len(x)), 2), np.concatenate([u, v])
    order = np.lexsort((y[pair], x[pair], bits[pair], of))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = of[order][1:] != of[order][:-1]
    rank = np.arange(len(order)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    kept = np.unique(pair[order][rank < limit])
    return x[kept], y[kept], np.full(len(kept), len(kept) < len(x))


def tile_candidates(jobs: DataFrame, limit: int) -> DataFrame:
    """a and b of the pairs of all jobs, and rows with only the key of jobs that left pairs out; a task holds one job at a time."""
    marks, columns = ["key", "x", "y"], ["sid", "root", "n", "side", "sketch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, held = None, []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        again: set[int] = set()

        def done() -> None:
            a, b, more = tile_pairs({c: np.concatenate([h[c] for h in held]) for c in columns}, limit)
            found.append((a, b))
            if more.any():
                again.add(mark[0])

        def distinct() -> pd.DataFrame:
            # Two sets that share many blocks meet in many jobs.
            a, b = np.unique(np.column_stack([c.astype(np.int64) for c in map(np.concatenate, zip(*found))]), axis=0).T
            rows = {"a": [*a, *[None] * len(again)], "b": [*b, *[None] * len(again)], "again": [None] * len(a) + list(again)}
            return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in rows.items()})

        for batch in batches:
            if not len(batch):
                continue
            now = batch[marks].to_numpy()
            rows = {c: batch[c].to_numpy() for c in columns}
            starts = [0, *(np.flatnonzero((now[1:] != now[:-1]).any(axis=1)) + 1), len(batch)]
            for a, z in zip(starts, starts[1:]):
                if held and tuple(now[a]) != mark:
                    done()
                    held = []
                mark = tuple(now[a])
                held.append({c: v[a:z] for c, v in rows.items()})
            if len(found) > 10_000:
                yield distinct()
                found.clear()
                again.clear()
        if held:
            done()
        if found:
            yield distinct()

    return jobs.repartition(*marks).sortWithinPartitions(*marks).mapInPandas(run, "a long, b long, again long")


def small_pairs(opened: DataFrame) -> DataFrame:
    """a and b of buckets of at most SMALL members: all pairs of unlike components, at most SMALL a member."""
    members = F.array_sort(F.collect_list(F.struct("sid", "root")))
    both = F.transform("m", lambda p, i: F.transform(F.slice("m", F.lit(1), i), lambda q: F.struct(p["sid"].alias("a"), q["sid"].alias("b"), (p["root"] != q["root"]).alias("apart"))))
    pairs = opened.groupBy("key").agg(members.alias("m")).select(F.inline(F.flatten(both))).where("apart")
    return pairs.select("a", "b", F.lit(None).cast("long").alias("again")).distinct()


def text_roots(texts: DataFrame, whole: DataFrame, cut, limit: int = LIMIT) -> DataFrame:
    """node and root of every distinct text that links with another."""
    buckets = cut(key_counts(texts).where("n > 1 and a <> b"), "buckets")
    large = buckets.where("n > 2").select("key", "n")
    members = cut(keys(texts, sieve(large, "key")).join(large, "key"), "members")
    # What pairs and tiles need to know of the texts that share any block.
    playing = sieve_table(buckets.where("n = 2").select(F.explode(F.array("a", "b")).alias("sid")).unionByName(members.select("sid")), "sid")
    facts = cut(where(texts.select("sid", "hash", "n", "sketch"), playing, "sid"), "facts")
    pairs = buckets.where("n = 2").select("a", "b").unionByName(stars(members)).distinct()
    roots = linked_roots(pairs, facts, whole, cut)
    while True:
        opened = open_members(members, roots, cut)
        small = F.col("n_bulk") + F.col("n_rest") <= SMALL
        found = small_pairs(opened.where(small)).unionByName(tile_candidates(tiles(opened.where(~small), facts), limit))
        found = cut(found, "found")
        told = found.agg(F.count("a"), F.count("again")).first()
        if told[0]:
            more = verified(near_pairs(found.where("a is not null").select("a", "b").distinct(), facts, cut), whole, cut)
            roots = joined_roots(roots, more, cut)
        if not told[1]:
            return roots
        # Buckets that left no pair out have nothing more to give.
        members = cut(members.join(found.where("again is not null").select(F.col("again").alias("key")).distinct(), "key", "left_semi"), "members")
        limit *= 16


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").isNull().alias("none"))
    with steps(docs.sparkSession, "parity-join") as own:
        whole = whole_texts(docs.select("doc_id", "text"), own)
        texts = text_facts(whole, own)
        roots = text_roots(texts, whole, own)
        least = rows.where("not none").groupBy("hash").agg(F.min("doc_id").alias("least"))
        known = texts.select("sid", "hash", "n").join(least, "hash").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        known = own(known.withColumn("root", F.coalesce("root", "sid")), "classes")
        of = known.groupBy("root").agg(F.min("least").alias("component_id"))
        known = known.join(of, "root").select("hash", "n", "component_id")
        found = rows.join(known, "hash", "left").select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_shingles"), "component_id")
        return cut(found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))), "linked")
