"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has bit b set if more than half of the XXH64 hashes of its 4-word shingles have it set.
Fingerprints link at RADIUS or fewer differing bits. Each bit position i has a nonzero vector m(i) of RADIUS + 1
bits; the mask of a nonzero vector v keeps the positions with an odd inner product <m(i), v>. Up to RADIUS vectors
span at most RADIUS dimensions, so some v is orthogonal to the vectors of all differing positions, and under its
mask the two fingerprints are equal (Pagh, 2016): with all 31 masks every pair within the radius collides in some
table. No link is lost.

Only distinct fingerprints are compared. A bucket of two gives its pair; a larger one goes to a task that links
its members by exact distances and returns a star for each linked set, never all pairs. A bucket of more than
CROWDED fingerprints is first split by the same construction over the bits its mask left free (another 31
tables, so again no link is lost), after which about 16 free bits bound its size whatever the input.

Rows get their component by a join on the fingerprint; one that many rows share is dealt over several tasks.

Nulls and edges: a null, empty or blank text has fingerprint zero and links like any other; fewer than four words are
one shingle; a null doc_id belongs to a component and is its id only if all ids there are null; repeated rows return
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, steps
from .components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Buckets of more distinct fingerprints than this are split by masks over their free bits.
CROWDED = 128
#: Fingerprints of at least 1/HOT of all rows are dealt over several tasks when rows get their component; there are at most HOT.
HOT = 10_000


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions, one for each nonzero vector of radius + 1 bits."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())], dtype="<u8")
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and fp of every row."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), fp(text).alias("fp"))


def link_bucket(fps: np.ndarray) -> list[tuple[int, int]]:
    """Stars (member, smallest member) of the sets that links connect within one bucket."""
    values = np.unique(fps).view(np.uint64)
    free = np.ones(len(values), dtype=bool)
    out = []
    for i in range(len(values)):
        if not free[i]:
            continue
        free[i] = False
        frontier, found = [i], [i]
        while frontier:
            others = np.flatnonzero(free)
            near = np.zeros(len(others), dtype=bool)
            for f in frontier:
                near |= np.bitwise_count(values[others] ^ values[f]) <= RADIUS
            frontier = others[near].tolist()
            free[frontier] = False
            found += frontier
        own = np.sort(values[found].view(np.int64))
        out += [(int(x), int(own[0])) for x in own[1:]]
    return out


def _stars(members: DataFrame, keys: list[str]) -> DataFrame:
    """Edges within buckets. Rows of a bucket lie side by side in a task, which holds one bucket at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for b in batches:
            values = b["fp"].to_numpy(dtype=np.int64)
            marks = list(b[keys].itertuples(index=False, name=None))
            cuts = [i for i in range(len(marks)) if marks[i] != (marks[i - 1] if i else key)] + [len(marks)]
            held.append(values[: cuts[0]])
            for a, z in zip(cuts, cuts[1:]):
                out += link_bucket(np.concatenate(held))
                key, held = marks[a], [values[a:z]]
            if marks:
                key = marks[-1]
        if held:
            out += link_bucket(np.concatenate(held))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    together = members.repartition(*map(F.col, keys)).sortWithinPartitions(*keys)
    return together.mapInPandas(run, "a long, b long")


def links(fps: DataFrame, cut=cut) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as all links do."""
    spark = fps.sparkSession
    first = covering_masks(list(range(64)))
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in first])).alias("t", "key"))
    buckets = tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = cut(buckets, "buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    more = tables.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    small = _stars(more.where(F.col("n") <= CROWDED).select("t", "key", "fp"), ["t", "key"])
    # 31 x 31 masks: those of the bits that each first mask leaves free, beside it.
    second = [(t, u, _signed(m | s)) for t, m in enumerate(first) for u, s in enumerate(covering_masks([b for b in range(64) if not m >> b & 1]))]
    masks = F.broadcast(spark.createDataFrame(second, "t int, u int, mask long"))
    split = more.where(F.col("n") > CROWDED).join(masks, "t").select("t", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    # The new key holds the old one: its mask includes the bits of the first mask.
    crowded = _stars(split, ["t", "u", "key"])
    return pairs.unionByName(small).unionByName(crowded)


def near_duplicates(docs: DataFrame, cut=cut) -> DataFrame:
    """doc_id, h, fp, component_id (smallest doc_id reachable by links) and root of every row.

    root is a fingerprint of the component and tells components apart; it is never null, as component_id may be."""
    prints = cut(fingerprints(docs), "fingerprints")
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    total = fps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = cut(components(links(fps, cut), cut=cut), "roots")
    members = fps.join(roots, fps.fp == roots.node).select("fp", "least", "root")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "root").select("fp", "component_id", "root")
    of = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # A group of copies shares one fingerprint: its rows are dealt to parts of about 1/HOT of all rows, and every part
    # gets the component. At most HOT fingerprints are broadcast, with 2 * HOT parts in all.
    hot = F.broadcast(fps.where(F.col("n") * HOT >= total).select("fp", F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = prints.join(hot, "fp", "left").select("doc_id", "h", "fp", F.pmod(F.xxhash64("doc_id", "h"), parts).cast("int").alias("part"))
    every = of.join(hot, "fp", "left").select("fp", "component_id", "root", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(every, ["fp", "part"]).select("doc_id", "h", "fp", "component_id", "root")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    with steps(docs.sparkSession, "near-duplicates") as own:
        found = near_duplicates(docs, own).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return cut(found, "components")


def keep_one(docs: DataFrame) -> DataFrame:
    """The input's rows without near-duplicates: of each component the row of smallest (doc_id, hash of the text), null ids
    first. Of rows equal in both one stays, whichever; texts without words are one component; an empty table stays
    empty; other columns stay as they are, whatever their names."""
    with steps(docs.sparkSession, "near-duplicates") as own:
        found = near_duplicates(docs, own).groupBy("root", "doc_id", "h").agg(F.count("*").alias("copies"))
        chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "h", "copies")).alias("s")).select("s.*")
        chosen = cut(chosen.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"), "copies"), "chosen")
    # The input's row travels as one struct, so none of its names meets one of ours.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    content = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    kept = rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (content == F.col("kept_h")))
    once = kept.where("copies = 1").select("row.*")
    return once.unionByName(kept.where("copies > 1").dropDuplicates(["kept_id", "kept_h"]).select("row.*"))
