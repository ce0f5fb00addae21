"""Exact and fuzzy duplicates of postings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from .connected import connected


def first_per_external_id(df: DataFrame) -> DataFrame:
    """S12. First arrival of each (source, external_id)."""
    w = Window.partitionBy("source", "external_id").orderBy("arrival_seq")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_hash(df: DataFrame) -> DataFrame:
    """F02 as a column."""
    return df.withColumn("dedup_hash", X.dedup_hash(F.col("title"), F.col("company_name"), F.col("country"), F.col("location")))


def exact_dedup(df: DataFrame) -> DataFrame:
    """W01. First arrival of each dedup_hash."""
    w = Window.partitionBy("dedup_hash").orderBy("arrival_seq")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rehash_with_collisions(df: DataFrame, old: str = "old_hash") -> DataFrame:
    """W02. New hashes; the lowest id of each keeps it, the others get one made from the new and the old hash."""
    fresh = with_hash(df)
    n = F.row_number().over(Window.partitionBy("dedup_hash").orderBy("id"))
    other = F.sha2(F.concat(F.col("dedup_hash"), F.lit("|legacy|"), F.col(old)), 256)
    return fresh.withColumn("_n", n).withColumn("dedup_hash", F.when(F.col("_n") == 1, F.col("dedup_hash")).otherwise(other)).drop("_n")


def insert_if_absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """S14. Rows of `new` whose dedup_hash the store lacks, first arrival each, with a normal country."""
    fresh = exact_dedup(new).join(existing.select("dedup_hash"), "dedup_hash", "left_anti")
    return fresh.withColumn("country", X.normalize_country(F.col("country")))


def fuzzy_keys(df: DataFrame) -> DataFrame:
    """Columns that fuzzy comparison needs, each computed once per row. Empty names and places count as missing."""
    company = F.when(F.col("company_name") != "", F.col("company_name"))
    return (
        df.withColumn("title_key", X.normalize_text(F.col("title")))
        .withColumn("c_tokens", X.company_tokens(company))
        .withColumn("c_words", X.company_words(company))
        .withColumn("c_country", X.normalize_text(F.when(F.col("country") != "", F.col("country"))))
        .withColumn("root", X.location_root(F.col("location")))
    )


def _compatible(a: str, b: str) -> Column:
    company = X.same_company(F.col(f"{a}.c_tokens"), F.col(f"{a}.c_words"), F.col(f"{b}.c_tokens"), F.col(f"{b}.c_words"))
    country = F.coalesce(F.col(f"{a}.c_country") == F.col(f"{b}.c_country"), F.lit(True))
    return company & country & ~X.locations_conflict(F.col(f"{a}.root"), F.col(f"{b}.root"))


def duplicate_pair_counts(df: DataFrame) -> DataFrame:
    """J08 as a report: per title key, how many pairs of distinct (company, country, place) forms are duplicates, and
    how many pairs of postings these stand for. Equal forms are counted, not paired, so popular titles stay small."""
    keys = ["title_key", "c_tokens", "c_words", "c_country", "root"]
    forms = fuzzy_keys(df).groupBy(*keys).agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first"))
    own = forms.where(F.col("n") > 1).select("title_key", F.lit(0).cast("long").alias("form_pairs"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    a, b = forms.alias("a"), forms.alias("b")
    met = a.join(b, (F.col("a.title_key") == F.col("b.title_key")) & (F.col("a.first") < F.col("b.first")) & _compatible("a", "b"))
    across = met.select("a.title_key", F.lit(1).cast("long").alias("form_pairs"), (F.col("a.n") * F.col("b.n")).alias("pairs"))
    return own.unionByName(across).groupBy("title_key").agg(F.sum("form_pairs").alias("form_pairs"), F.sum("pairs").alias("pairs"))


#: What two rows of one title are compared by.
FORM = ("title_key", "c_tokens", "c_words", "c_country", "root")


def with_form(keys: DataFrame) -> DataFrame:
    """keys with `form`, which stands for title, company, country and place together."""
    return keys.withColumn("form", F.sha2(F.to_json(F.struct(*FORM)), 256))


def form_links(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of different forms of a title that a merge could join, enough of them to connect all that can meet.

    Names that go together share a word: one token set holds the other, so the rarest token (in the title) of the smaller is
    in the larger; and a name without tokens begins as the other does. So a form offers the words it could be found by, and
    looks for its own. Countries and places have to be equal but for open ones (no country, a place without a root), so forms
    meet within their country and place, and open forms meet all of the title."""
    forms = keys.groupBy("form").agg(*[F.first(c).alias(c) for c in FORM])
    named = forms.where(F.coalesce(F.size("c_words"), F.lit(1)) > 0)  # a name without words goes with nothing
    start = F.concat(F.lit("^"), F.get("c_words", 0))
    tokens = F.coalesce("c_tokens", F.array().cast("array<string>"))
    offered = F.when(F.col("c_words").isNull(), F.array(F.lit("-"))).otherwise(F.concat(tokens, F.array(start)))
    offers = named.select("*", F.explode(offered).alias("word"))
    rarity = offers.groupBy(F.col("title_key").alias("t"), F.col("word").alias("w")).agg(F.count("*").alias("n"))
    ranked = offers.join(rarity, F.col("title_key").eqNullSafe(F.col("t")) & (F.col("word") == F.col("w")))
    own = F.when(F.size(tokens) > 0, ~F.startswith("word", F.lit("^"))).otherwise(F.lit(True))
    sought = ranked.where(own).groupBy("form").agg(F.min(F.struct("n", "word"))["word"].alias("word")).join(named, "form")
    opened = F.col("c_country").isNull() | F.coalesce(F.col("root") == "", F.lit(False))
    columns = ["form", "word", *FORM]

    def met(left: DataFrame, right: DataFrame, same: tuple[str, ...]) -> DataFrame:
        a, b = left.select(columns).alias("a"), right.select(columns).alias("b")
        on = (F.col("a.word") == F.col("b.word")) & (F.col("a.form") != F.col("b.form"))
        for c in ("title_key", *same):
            on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, on & _compatible("a", "b")).select(F.col("a.form").alias("a"), F.col("b.form").alias("b"))

    near = met(sought, offers, ("c_country", "root"))
    return near.unionByName(met(sought.where(opened), offers, ())).unionByName(met(sought, offers.where(opened), ())).distinct()


def _same_names_alike() -> Column:
    """Whether rows of one form merge: not if the company's name has no words."""
    return F.coalesce(F.size("c_words"), F.lit(1)) > 0


def fuzzy_dedup(df: DataFrame) -> DataFrame:
    """D01 and U05. Greedy merge in arrival order among postings of equal title key.

    A posting joins the first accepted one with a compatible company and country and no conflicting place; the longer
    description survives (only if strictly longer) in the old place; sources add up in order. `comparisons` are those that the
    sequential scan of the title's accepted postings makes: each member costs the place of its slot, the first one less.

    Rows meet only if their forms are connected (form_links), so the connected forms of a title are split off each other. A
    form that is connected with no other one merges as a whole, in one aggregate, however many rows it has. Only the rows of
    several connected forms depend on their order: they are one sorted run of narrow rows in a task (no descriptions, only
    their lengths), which holds the accepted postings of those forms. Texts are joined afterwards."""
    keys = with_form(fuzzy_keys(df)).withColumn("size", F.length(F.coalesce("description", F.lit(""))))
    rows = stored(keys.select("arrival_seq", "source", "size", "form", *FORM), "fuzzy-rows")
    linked = connected(form_links(rows)).withColumnRenamed("node", "form")
    grouped = rows.join(linked, "form", "left")

    alone = grouped.where(F.col("root_form").isNull()).withColumn("slot_of", F.when(~_same_names_alike(), F.col("arrival_seq")))
    sources = alone.groupBy("form", "slot_of", "title_key", "source").agg(F.min("arrival_seq").alias("first"), F.count("*").alias("n"), F.max(F.struct("size", (-F.col("arrival_seq")).alias("early"))).alias("longest"))
    closed = sources.groupBy("form", "slot_of", "title_key").agg(F.min("first").alias("slot"), (-F.max("longest")["early"]).alias("kept_seq"), F.sum("n").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]).alias("merged_sources"))

    together = grouped.where(F.col("root_form").isNotNull()).select("root_form", *FORM, "arrival_seq", "source", "size")
    dealt = together.repartition("root_form").sortWithinPartitions("root_form", "arrival_seq")
    folded = dealt.mapInPandas(_fold, "title_key string, slot long, kept_seq long, members long, merged_sources array<string>")
    merged = stored(closed.select("title_key", "slot", "kept_seq", "members", "merged_sources").unionByName(folded), "fuzzy-merged")
    placed = merged.join(slot_places(merged), "slot").withColumn("comparisons", F.col("members") * F.col("place") - 1)
    return placed.drop("title_key", "place").join(df, F.col("kept_seq") == df.arrival_seq).drop("kept_seq")


def slot_places(merged: DataFrame, groups: int = 1000) -> DataFrame:
    """slot and its place (from 1) among the slots of its title. Slots are counted in `groups` ranges first, so that a title with very
    many of them is ranked by several tasks."""
    low, high = merged.agg(F.min("slot"), F.max("slot")).first()
    width = max(1, ((high or 0) - (low or 0)) // groups + 1)
    ranged = merged.select("slot", "title_key", F.floor((F.col("slot") - F.lit(low or 0)) / width).alias("g"))
    counts = ranged.groupBy("title_key", "g").agg(F.count("*").alias("n"))
    w = Window.partitionBy("title_key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("title_key").alias("t"), F.col("g").alias("h"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("title_key", "g").orderBy("slot"))
    numbered = ranged.withColumn("own", own)
    return numbered.join(before, F.col("title_key").eqNullSafe(F.col("t")) & (F.col("g") == F.col("h"))).select("slot", (F.col("own") + F.col("before")).alias("place"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The greedy merge over the sorted rows of connected forms; holds the accepted ones of one connected set."""
    current, accepted = None, []

    def done() -> pd.DataFrame:
        rows = [(s["row"]["title_key"], s["slot"], s["row"]["arrival_seq"], s["members"], s["sources"]) for s in accepted]
        return pd.DataFrame(rows, columns=["title_key", "slot", "kept_seq", "members", "merged_sources"])

    for b in batches:
        for row in b.astype(object).where(b.notna(), None).to_dict("records"):
            if row["root_form"] != current:
                if accepted:
                    yield done()
                current, accepted = row["root_form"], []
            for seen in accepted:
                if _alike(row, seen["row"]):
                    seen["members"] += 1
                    if row["source"] not in seen["sources"]:
                        seen["sources"].append(row["source"])
                    if row["size"] > seen["row"]["size"]:
                        seen["row"] = row
                    break
            else:
                accepted.append({"row": row, "slot": row["arrival_seq"], "members": 1, "sources": [row["source"]]})
    if accepted:
        yield done()


def _alike(a: dict, b: dict) -> bool:
    """Whether two rows of one title have compatible countries, places and companies."""
    if a["c_country"] is not None and b["c_country"] is not None and a["c_country"] != b["c_country"]:
        return False
    if (a["root"] is None) != (b["root"] is None) or a["root"] and b["root"] and a["root"] != b["root"]:
        return False
    if a["c_words"] is None or b["c_words"] is None:
        return a["c_words"] is None and b["c_words"] is None
    ta, tb = set(a["c_tokens"]), set(b["c_tokens"])
    if ta and tb:
        return ta <= tb or tb <= ta
    wa, wb = list(a["c_words"]), list(b["c_words"])
    n = min(len(wa), len(wb))
    return n > 0 and wa[:n] == wb[:n]
