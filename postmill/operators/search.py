"""Search by word prefixes over a positional index: a table of the words of all postings, laid out by their first letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a term that count (F25).
MOST_WORDS = 8


def term_words(term: str) -> list[str]:
    """F25 of one term: its first words, lower case, each once."""
    plain = "".join(c if c.isalnum() or c == "_" else " " for c in term.lower())
    return list(dict.fromkeys(plain.split()[:MOST_WORDS]))


def _words(*columns: str) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}_]+", " "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def posting_words() -> Column:
    """array<struct<position,token,head>> of a posting: title and company (head), then the description."""
    head, body = _words("title", "company_name"), _words("description")

    def placed(words: Column) -> Column:
        named = lambda ws, is_head, start: F.transform(ws, lambda w, i: F.struct((i + start).alias("position"), w.alias("token"), F.lit(is_head).alias("head")))
        return F.concat(named(words["head"], True, F.lit(0)), named(words["body"], False, F.size(words["head"])))

    return F.transform(F.array(F.struct(head.alias("head"), body.alias("body"))), placed)[0]


def prefixes_of(token: Column, wanted: list[str]) -> Column:
    """Which of the wanted prefixes (a bit each) a token begins with."""
    return reduce(lambda a, b: a + b, [F.when(F.startswith(token, F.lit(w)), 1 << i).otherwise(0) for i, w in enumerate(wanted)], F.lit(0))


def cover_density(hits: Column, n: int, title_weight: float = 1.0, text_weight: float = 0.4) -> Column:
    """F28 from the hits of a posting (array of position, head and mask, in order of position) for n prefixes.

    Goes over the hits and keeps each prefix's last one; where all are there, a stretch ends at this hit and begins at the
    earliest of the last ones; it is minimal if it begins later than the one before."""
    if not n:
        return F.lit(0.0)
    never = F.array(*[F.lit(-1)] * n)
    start = F.struct(never.alias("last"), F.array(*[F.lit(0.0)] * n).alias("weights"), F.lit(0.0).alias("total"), F.lit(-1).alias("previous"))

    def step(state: Column, hit: Column) -> Column:
        weight = F.when(hit["head"], title_weight).otherwise(text_weight)
        has = lambda i: F.getbit(hit["mask"], i) == 1
        last = F.transform(state["last"], lambda x, i: F.when(has(i), hit["position"]).otherwise(x))
        weights = F.transform(state["weights"], lambda x, i: F.when(has(i), weight).otherwise(x))

        def add(new: Column) -> Column:
            first = F.array_min(new["last"])
            fresh = (first >= 0) & (first > state["previous"])
            mean = F.aggregate(new["weights"], F.lit(0.0), lambda a, x: a + x) / n
            total = state["total"] + F.when(fresh, mean / (hit["position"] - first + 1)).otherwise(0.0)
            return F.struct(new["last"].alias("last"), new["weights"].alias("weights"), total.alias("total"), F.when(fresh, first).otherwise(state["previous"]).alias("previous"))

        return F.transform(F.array(F.struct(last.alias("last"), weights.alias("weights"))), add)[0]

    return F.round(F.aggregate(hits, start, step, lambda s: s["total"]), 6)


def write_token_index(jobs: DataFrame, path: str) -> None:
    """F26's index: letters, token, id, position and head, one row per word of a posting.

    One folder for each pair of first letters; inside, rows are in order of the token, so a prefix is a range of a few row
    groups. Rows are dealt by ranges of (token, id): a frequent word is many files, not one task."""
    rows = jobs.select("id", F.inline(posting_words()))
    laid = rows.select(_letters(F.col("token")).alias("letters"), "token", "id", "position", "head")
    laid.repartitionByRange("letters", "token", "id").sortWithinPartitions("letters", "token", "id", "position").write.partitionBy("letters").parquet(path)


def _letters(token: Column) -> Column:
    """The first two letters, where folder names can hold them in order; all others share one folder."""
    two = F.substring(token, 1, 2)
    return F.when(two.rlike("^[a-z0-9]{2}$"), two).when(two.rlike("^[a-z0-9]"), F.concat(F.substring(two, 1, 1), F.lit("_"))).otherwise("_")


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id long, position int, head boolean, letters string").parquet(path)


def _range(prefix: str) -> Column:
    """Rows of the index whose token begins with the prefix, as a filter on folders and on the order of tokens."""
    plain = [c if c.isascii() else None for c in prefix[:2]]
    if plain[0] is None or plain[0] == "_":
        folder = F.col("letters") == "_"
    elif len(plain) == 2:
        folder = F.col("letters") == (prefix[:2] if plain[1] not in (None, "_") else prefix[0] + "_")
    else:
        folder = F.startswith("letters", F.lit(prefix))
    return folder & (F.col("token") >= prefix) & F.startswith("token", F.lit(prefix))


def indexed_search(index: DataFrame, term: str) -> DataFrame:
    """F26 over the index: id of every posting in which each word of the term is a prefix. The rarest prefix comes first and the
    others only narrow it down."""
    wanted = term_words(term)
    if not wanted:
        return index.select("id").distinct()
    counts = [index.where(_range(w)).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, w in enumerate(wanted)]
    order = [r["i"] for r in sorted(reduce(DataFrame.unionByName, counts).collect(), key=lambda r: (r["n"], r["i"]))]
    found = index.where(_range(wanted[order[0]])).select("id").distinct()
    for i in order[1:]:
        found = found.join(index.where(_range(wanted[i])).select("id"), "id", "left_semi")
    return found


def indexed_rank(index: DataFrame, term: str, title_weight: float = 1.0, text_weight: float = 0.4) -> DataFrame:
    """F28 over the index: id and rank of the postings found. Only positions of matching words are read."""
    wanted = term_words(term)
    if not wanted:
        return indexed_search(index, term).withColumn("rank", F.lit(0.0))
    hits = index.where(reduce(lambda a, b: a | b, map(_range, wanted))).join(indexed_search(index, term), "id", "left_semi")
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "head", prefixes_of(F.col("token"), wanted).alias("mask")))).alias("hits"))
    return listed.select("id", cover_density(F.col("hits"), len(wanted), title_weight, text_weight).alias("rank"))
