"""Scores of postings per user: what is current, what is to do, in which order, and how results are stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import rules

MODELS = ("prefilter", "primary")


def upsert_scores(existing: DataFrame, new: DataFrame) -> DataFrame:
    """S15. Key (job_id, user_id): insert, or replace a row whose hash or model is null or different."""
    keys = ["job_id", "user_id"]
    rest = [c for c in existing.columns if c not in keys]
    o, n = existing.alias("o"), new.alias("n")
    same = (F.col("o.profile_hash") == F.col("n.profile_hash")) & (F.col("o.model_version") == F.col("n.model_version"))
    take_new = F.col("n.job_id").isNotNull() & (F.col("o.job_id").isNull() | ~F.coalesce(same, F.lit(False)))
    joined = o.join(n, (F.col("o.job_id") == F.col("n.job_id")) & (F.col("o.user_id") == F.col("n.user_id")), "full")
    return joined.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def valid_scores(scores: DataFrame, profiles: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """J05. Scores of the current profile by an accepted model."""
    return scores.where(F.col("model_version").isin(*models)).join(profiles.select("user_id", "profile_hash"), ["user_id", "profile_hash"], "left_semi")


def fresh_cache_hits(scores: DataFrame, profiles: DataFrame, as_of: str, hours: int = 168, model: str = "primary") -> DataFrame:
    """J06. Valid scores of one model within the time to live."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return valid_scores(scores, profiles, (model,)).where(F.col("scored_at") >= cutoff)


def unscored(jobs: DataFrame, users: DataFrame, scores: DataFrame) -> DataFrame:
    """J03 as counts: postings without any score row of a user, per user, without building the pairs."""
    n = jobs.agg(F.count("*").alias("n_jobs"))
    scored = scores.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").groupBy("user_id").agg(F.count_distinct("job_id").alias("n_scored"))
    return users.select("user_id").join(scored, "user_id", "left").join(F.broadcast(n)).select("user_id", (F.col("n_jobs") - F.coalesce("n_scored", F.lit(0))).alias("n_unscored"))


def unscored_jobs(jobs: DataFrame, scores: DataFrame, user_id: int, countries: list[str], as_of: str, days: int) -> DataFrame:
    """J03. Postings of the countries, scraped in the last days, without a score row of the user."""
    done = scores.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"))
    fresh = F.col("scraped_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return jobs.where(fresh & F.lower("country").isin([c.lower() for c in countries])).join(done, "id", "left_anti")


def to_score(passed: DataFrame, hits: DataFrame) -> DataFrame:
    """J06, the rest: pairs (id, user_id) that pass and have no fresh score, as (job_id, user_id)."""
    return passed.select(F.col("id").alias("job_id"), "user_id").join(hits.select("job_id", "user_id"), ["job_id", "user_id"], "left_anti")


def exclude_actioned(jobs: DataFrame, applications: DataFrame, user_id: int, known: DataFrame | None = None) -> DataFrame:
    """J04. Postings the user has not applied to or rejected, by id or by dedup_hash; `known` are all postings, if jobs are fewer."""
    acted = applications.where((F.col("user_id") == user_id) & F.col("status").isin("applied", "rejected")).select(F.col("job_id").alias("id"))
    hashes = (jobs if known is None else known).join(acted, "id", "left_semi").select("dedup_hash").distinct()
    return jobs.join(acted, "id", "left_anti").join(hashes, "dedup_hash", "left_anti")


def reuse_scores(scores: DataFrame, passed: DataFrame, old_hash: str, new_hash: str) -> DataFrame:
    """J11. AI scores of one profile hash, for postings that still pass, under another hash."""
    ai = scores.where((F.col("profile_hash") == old_hash) & F.col("model_version").rlike("^(gemini|nvidia|claude)"))
    return ai.join(passed, "job_id", "left_semi").withColumn("profile_hash", F.lit(new_hash))


def requeue_scores(scores: DataFrame, model: str) -> DataFrame:
    """D05. Without the rows of a retired model."""
    return scores.where(~F.col("model_version").eqNullSafe(F.lit(model)))


def prefilter_reject_rows(verdicts: DataFrame, as_of: str) -> DataFrame:
    """D06. Hard rejects as score rows."""
    return verdicts.where(~F.col("passed") & (F.col("bucket") == "low")).select(F.col("id").alias("job_id"), "user_id", F.lit(0).alias("score"), F.lit("rejected by rules").alias("ai_analysis"), F.lit("prefilter").alias("model_version"), F.lit(as_of).cast("timestamp_ntz").alias("scored_at"))


def zero_scores(scores: DataFrame) -> DataFrame:
    """D07. The pairs (id, user_id) to check again: score 0 without analysis."""
    return scores.where((F.col("score") == 0) & F.col("ai_analysis").isNull()).select(F.col("job_id").alias("id"), "user_id")


def recheck_zero_scores(verdicts: DataFrame) -> DataFrame:
    """D07. From the verdicts of those pairs: `filtered` if the rules still reject, else `to_score`."""
    return verdicts.select(F.col("id").alias("job_id"), "user_id", F.when(F.col("passed"), "to_score").otherwise("filtered").alias("action"))


def stale_score_queue(scores: DataFrame, jobs: DataFrame, as_of: str, country: str, days: int = 30, budget: int = 300) -> DataFrame:
    """T06. Per user, over the country's postings scraped in the last `days`: zero scores without analysis first, then scores
    over 7 days old, oldest first."""
    ago = lambda n: F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(n))
    scope = jobs.where((F.col("country") == country) & (F.col("scraped_at") >= ago(days))).select(F.col("id").alias("job_id"))
    priority = F.when((F.col("score") == 0) & F.col("ai_analysis").isNull(), 1).when((F.col("score") > 0) & (F.col("scored_at") < ago(7)), 2)
    queue = scores.withColumn("priority", priority).where(F.col("priority").isNotNull()).join(scope, "job_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy("priority", "scored_at", "job_id")
    return queue.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget).select("user_id", "job_id", "priority", "place")


def tiered_queue(verdicts: DataFrame, tier1: int = 1000, rejects: int = 2000, by: str = "user_id") -> DataFrame:
    """W06. Per user: tier 1 (passed) up to its cap; tier 2 only where tier 1 is empty; rejects up to theirs. Profiles of one
    signature have one queue: take signature_verdicts by `sig`, and rules.for_users of the result.

    The first cut is by one number, so each task keeps its own first rows before anything is shuffled; what is left is at
    most a few thousand rows a user. Every tier that a user has keeps a row, so the lowest one is read from them."""
    tier = F.when(F.col("passed"), 1).when(F.col("bucket") == "manager_tier2", 2).otherwise(3)
    w = Window.partitionBy(by, "tier").orderBy("id")
    ranked = verdicts.select(by, "id", tier.alias("tier")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(tier1, rejects))
    capped = ranked.where(F.col("place") <= F.when(F.col("tier") == 3, rejects).otherwise(tier1))
    lowest = capped.withColumn("lowest", F.min("tier").over(Window.partitionBy(by)))
    return lowest.where((F.col("tier") != 2) | (F.col("lowest") == 2)).select(by, "id", "tier", "place")


def assign_batches(queue: DataFrame, size: int = 15, order: str = "place", by: str = "user_id") -> DataFrame:
    """W07. Consecutive batches of a user's queue (or of a signature's, see tiered_queue), with the place in the batch."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("tier", order, "id")) - 1
    return queue.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size)).withColumn("in_batch", F.pmod(F.col("_n"), F.lit(size))).drop("_n")


def semantic_priority(queue: DataFrame, threshold: float = 0.25, by: str = "user_id") -> DataFrame:
    """W08. explicit, similar, without vector, low; then similarity, then input order. Removes nothing; n_low counts the user's low ones."""
    group = F.when(F.col("explicit"), 0).when(F.col("similarity") >= threshold, 1).when(F.col("similarity").isNull(), 2).otherwise(3)
    w = Window.partitionBy(by).orderBy("group", F.desc(F.coalesce("similarity", F.lit(0.0))), "seq")
    low = F.count_if(F.col("group") == 3).over(Window.partitionBy(by))
    return queue.withColumn("group", group).withColumn("place", F.row_number().over(w)).withColumn("n_low", low)


def signature_priority(found: DataFrame, terms: DataFrame, vectors: DataFrame, threshold: float = 0.25, spread: int = 16) -> DataFrame:
    """W08 from what passed per signature of profiles (id, sig, explicit, seq), the profiles' terms, and vectors (vec_id, embedding) of
    postings and users: user_id, id, group, place and n_low.

    Users without a vector have the order of their signature. For the others, products are made where both have a vector; postings
    meet users by signature, in `spread` parts, and vectors are not carried into the pairs."""
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    v = vectors.select("vec_id", "embedding", F.when(norm > 0, norm).alias("norm"))
    given = found.join(v.withColumnRenamed("vec_id", "id"), "id", "left")
    mine = terms.select("user_id", "sig").join(v.withColumnRenamed("vec_id", "user_id"), "user_id")
    none = F.lit(None).cast("double").alias("similarity")
    blank = given.select("id", "sig", "explicit", "seq", none)
    plain = terms.select("user_id", "sig").join(v.select(F.col("vec_id").alias("user_id")), "user_id", "left_anti")
    out = ["user_id", "id", "group", "place", "n_low"]
    alone = rules.for_users(semantic_priority(blank, threshold, by="sig"), plain).select(*out)

    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    n = max(4 * spread, 4 * found.sparkSession.sparkContext.defaultParallelism)
    a = given.where(F.col("norm").isNotNull()).select("id", "sig", "explicit", "seq", F.col("embedding").alias("_v"), F.col("norm").alias("_n"), F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int").alias("part"))
    b = mine.where(F.col("norm").isNotNull()).select("user_id", "sig", F.col("embedding").alias("_p"), F.col("norm").alias("_m"), parts.alias("part"))
    near = a.repartition(n, "sig", "part").join(b.repartition(n, "sig", "part"), ["sig", "part"])
    near = near.select("user_id", "id", "explicit", "seq", F.round(_dot(F.col("_v"), F.col("_p")) / (F.col("_n") * F.col("_m")), 6).alias("similarity"))
    pairs = ["user_id", "id", "explicit", "seq", "similarity"]
    lone = rules.for_users(given.where(F.col("norm").isNull()).select("id", "sig", "explicit", "seq", none), mine)
    odd = rules.for_users(given.where(F.col("norm").isNotNull()).select("id", "sig", "explicit", "seq", none), mine.where(F.col("norm").isNull()))
    own = near.unionByName(lone.select(*pairs)).unionByName(odd.select(*pairs))
    return alone.unionByName(semantic_priority(own, threshold).select(*out))


def score_prompt(batches: DataFrame, by: str = "user_id") -> DataFrame:
    """F30. One text per batch of a user (or a signature) from rows with in_batch, title, company_name, is_remote, description."""
    remote = F.when(F.col("is_remote"), "Yes").when(~F.col("is_remote"), "No").otherwise("Unknown")
    line = F.concat_ws("\n", F.concat(F.lit("["), F.col("in_batch").cast("string"), F.lit("] "), F.col("title")), F.concat(F.lit("Company: "), F.coalesce("company_name", F.lit("-"))), F.concat(F.lit("Remote: "), remote), F.substring(F.coalesce("description", F.lit("")), 1, 1200))
    parts = F.array_sort(F.collect_list(F.struct("in_batch", line.alias("text"))))
    return batches.groupBy(by, "batch").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("prompt"))


def profile_text(resume: str = "resume", longest: int = 2500) -> Column:
    """F21. A profile as one text: background (cut after `longest` characters), preferences, exclusions, language; parts
    without content are left out. Lists are arrays of strings."""
    own = F.nullif(F.trim(resume), F.lit(""))
    own = F.when(F.length(own) > longest, F.concat(F.substring(own, 1, longest), F.lit("\n[cut]"))).otherwise(own)
    line = lambda label, text: F.concat(F.lit(label), F.nullif(text, F.lit("")))
    listed = lambda c: F.array_join(c, ", ")
    wishes = F.concat_ws("\n", line("Roles: ", listed("target_titles")), line("Work mode: ", F.col("work_mode")), line("Countries: ", listed("preferred_countries")))
    parts = [line("Background\n", own), line("Preferences\n", wishes), line("Reject if required\n", listed("excluded_keywords")), line("Reject employers\n", listed("excluded_companies")), F.when(F.col("english_only"), "Language\nEnglish only")]
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit("No profile"))


def parse_score_response(response: Column, size: Column) -> Column:
    """F23. array<struct<index,score>>: fences off, a cut array closed at its last brace, places outside the batch
    dropped, a missing place 0, scores clamped to 0-100."""
    body = F.trim(F.regexp_replace(response, r"```[a-z]*", ""))
    body = F.when(F.endswith(body, F.lit("]")), body).otherwise(F.concat(F.regexp_extract(body, r"(?s)^(.*\})", 1), F.lit("]")))
    parsed = F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), "array<struct<index:int,score:double>>")
    items = F.transform(parsed, lambda x: F.struct(F.coalesce(x["index"], F.lit(0)).alias("index"), F.least(F.lit(100), F.greatest(F.lit(0), x["score"].cast("int"))).alias("score")))
    return F.filter(items, lambda x: (x["index"] >= 0) & (x["index"] < size))


def job_text(longest: int = 6000, total: int = 12_000) -> Column:
    """F20. A posting as one text: title, company and place with labels, then the start of the description."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    return F.substring(F.concat_ws("\n", label("Title", "title"), label("Company", "company_name"), label("Location", "location"), F.substring("description", 1, longest)), 1, total)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors by built-in functions, in double precision, to six digits; null where one is null or zero."""
    return F.round(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), 6)


def pair_similarity(pairs: DataFrame, vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs (id, user_id) with similarity, from vectors (id, embedding) and profile vectors (user_id, embedding); null where
    one has no vector. Two equi-joins."""
    v, p = vectors.select("id", F.col("embedding").alias("_v")), profiles.select("user_id", F.col("embedding").alias("_p"))
    return pairs.join(v, "id", "left").join(p, "user_id", "left").withColumn("similarity", cosine(F.col("_v"), F.col("_p"))).drop("_v", "_p")


#: Rows of a tile: of the query side (held as one matrix) and of the other (streamed).
QUERY_TILE, ROW_TILE = 2048, 65_536


def _tiled(rows: DataFrame, queries: DataFrame, product: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], k: int | None) -> DataFrame:
    """query_id, id and cosine of rows (id, embedding) and queries (query_id, embedding), tile by tile.

    Both sides are cut into tiles by a hash of their ids; every row goes to each tile of queries and every query to each tile
    of rows, and tiles meet by their numbers in one shuffle. A task holds a tile of queries and reads the rows that follow
    them in batches; nothing goes through the driver but the two counts. With k, a tile returns its k best per query."""
    usable = lambda df: df.where(F.exists("embedding", lambda x: x != 0))
    rows, queries = usable(rows), usable(queries)
    n_rows, n_queries = rows.count(), queries.count()
    across, down = max(1, -(-n_rows // ROW_TILE)), max(1, -(-n_queries // QUERY_TILE))
    # Few rows: spread them over the cores all the same.
    across = max(across, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // 256)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(part("query_id", down).alias("q"), every(across).alias("r"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "embedding")
    given = rows.select(every(down).alias("q"), part("id", across).alias("r"), F.lit(1).alias("side"), "id", "embedding")
    tiles = asked.unionByName(given).repartition("q", "r").sortWithinPartitions("q", "r", "side")

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack(vectors.to_list()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held, ids, best = None, [], np.zeros(0, dtype=np.int64), None
        for batch in batches:
            for mark, own in batch.groupby(["q", "r"], sort=True):
                if mark != tile:
                    if best is not None:
                        yield best
                    tile, held, ids, best = mark, [], np.zeros(0, dtype=np.int64), None
                new = own[own["side"] == 0]
                if len(new):
                    held.append(unit(new["embedding"]))
                    ids = np.concatenate([ids, new["id"].to_numpy(dtype=np.int64)])
                others = own[own["side"] == 1]
                for at in range(0, len(others) if len(ids) else 0, 512):
                    piece = others.iloc[at : at + 512]
                    held = [np.concatenate(held)]
                    cosine = np.round(held[0] @ unit(piece["embedding"]).T, 6)
                    found = product(ids, piece["id"].to_numpy(dtype=np.int64), cosine, best)
                    if k is None:
                        yield found
                    else:
                        best = found
        if best is not None:
            yield best

    return tiles.mapInPandas(run, "query_id long, id long, cosine double")


def _pairs(queries: np.ndarray, ids: np.ndarray, cosine: np.ndarray, _) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(queries, len(ids)), "id": np.tile(ids, len(queries)), "cosine": cosine.ravel()})


def profile_similarity(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """J07. (id, user_id, cosine) of every vector and profile (user_id, embedding, profile_hash, embedding_profile_hash) whose
    vector carries the current hash. Asked for are all pairs; null and zero vectors have none."""
    current = profiles.where(F.col("embedding_profile_hash") == F.col("profile_hash")).select(F.col("user_id").alias("query_id"), "embedding")
    found = _tiled(vectors.select("id", "embedding"), current, _pairs, None)
    return found.select("id", F.col("query_id").alias("user_id"), "cosine")


def similarity(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """J07 and T08. The k nearest rows by cosine for each query vector: (query_id, id, cosine, rank), ties to the smaller id."""

    def best(queries: np.ndarray, ids: np.ndarray, cosine: np.ndarray, before: pd.DataFrame | None) -> pd.DataFrame:
        every = _pairs(queries, ids, cosine, None)
        every = every if before is None else pd.concat([before, every], ignore_index=True)
        order = np.lexsort((every["id"], -every["cosine"], every["query_id"]))
        every = every.iloc[order]
        return every[every.groupby("query_id").cumcount() < k].reset_index(drop=True)

    local = _tiled(vectors.select("id", "embedding"), queries.select("query_id", "embedding"), best, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_search(vectors: DataFrame, jobs: DataFrame, queries: DataFrame, k: int = 500, include_closed: bool = False) -> DataFrame:
    """T08. The k postings nearest to each query vector; those whose page is closed only if asked for."""
    shown = jobs if include_closed else jobs.where(F.col("url_status").isNull() | (F.col("url_status") != "closed"))
    return similarity(vectors.join(shown.select("id"), "id", "left_semi"), queries, k)


def score_with(batches: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """X01. A user's scorer over prompts: one response text per prompt of an Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"user_id": f["user_id"], "batch": f["batch"], "response": fn(f["prompt"].tolist())})

    return batches.mapInPandas(run, "user_id long, batch long, response string")


def scored_rows(answers: DataFrame, batches: DataFrame, size: int) -> DataFrame:
    """X01. (job_id, user_id, score) of each answered place, from answers (user_id, batch, response) to batches of at most
    `size` rows (user_id, batch, in_batch, id); a place answered twice takes its last score, one without answer gives no row."""
    each = answers.select("user_id", "batch", F.posexplode(parse_score_response(F.col("response"), F.lit(size))).alias("_p", "s"))
    last = each.groupBy("user_id", "batch", F.col("s.index").cast("long").alias("in_batch")).agg(F.max_by(F.col("s.score"), "_p").alias("score"))
    return batches.select("user_id", "batch", F.col("in_batch").cast("long").alias("in_batch"), F.col("id").alias("job_id")).join(last, ["user_id", "batch", "in_batch"]).select("job_id", "user_id", "score")


def embed_with(texts: DataFrame, fn: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """X02. A user's embedder over (id, text); vectors are fitted to the dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "embedding": fn(f["text"].tolist())})

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return texts.mapInPandas(run, schema).withColumn("embedding", X.fit_dimension(F.col("embedding"), dimension))
