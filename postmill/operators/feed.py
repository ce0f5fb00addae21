"""The feed: joins, filters, orders, pages and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .search import cover_density, posting_words, prefixes_of, term_words


def feed_base(jobs: DataFrame, scores: DataFrame, applications: DataFrame, user_id: int) -> DataFrame:
    """J01. Every posting with the user's score and application, where there is one."""
    s = scores.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), "score", "scored_at")
    a = applications.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), F.col("status").alias("app_status"), "updated_at")
    return jobs.join(s, "id", "left").join(a, "id", "left")


def feed_filters(base: DataFrame, min_score: int | None = None, sources: list[str] | None = None, status: str | None = None, countries: list[str] | None = None, hidden: list[str] | None = None, closed: bool = False, region: str | None = None, search: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """P14 and P15, composed. Hidden countries count for the default and the `new` feed without an explicit country.
    `search` is F26's term; `among` has the ids (id) of a semantic selection (T08)."""
    df = base
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if sources:
        df = df.where(F.col("source").isin(sources))
    if status == "new":
        df = df.where(F.col("app_status").isNull())
    elif status is None:
        df = df.where(F.col("app_status").isNull() | (F.col("app_status") != "rejected"))
    else:
        df = df.where(F.col("app_status") == status)
    country = X.normalize_country(F.col("country"))
    valid = [c.lower() for c in hidden or [] if len(c) == 2 and c.isalpha()]
    if countries:
        df = df.where(F.lower("country").isin([c.lower() for c in countries]))
    elif valid and status in (None, "new"):
        df = df.where(country.isNull() | ~country.isin(valid))
    if not closed:
        df = df.where(F.coalesce(F.col("url_status"), F.lit("")) != "closed")
    if region:
        df = df.where(region_preset(region))
    if search and search.strip():
        df = prefix_search(df, search)
    return df if among is None else df.join(among.select("id").distinct(), "id", "left_semi")


# The regions of the feed, by country and by parts of the place.
REGIONS = {
    "germany": ("de",),
    "dach": ("de", "at", "ch"),
    "europe": ("de", "at", "ch", "nl", "be", "lu", "dk", "pl", "cz", "si", "sk", "ro", "hu"),
    "cee": ("si", "sk", "ro", "hu"),
}
PLACES = {"saxony": ("leipzig", "dresden", "halle", "chemnitz", "sachsen", "saxony")}


def region_preset(name: str) -> Column:
    """P16. A named country set, or a set of parts of the place."""
    if name in PLACES:
        return X.has_part(F.lower(F.coalesce("location", F.lit(""))), PLACES[name])
    return F.coalesce(F.lower("country").isin(*REGIONS[name]), F.lit(False))


def display(df: DataFrame) -> DataFrame:
    """P17. What a feed shows for missing values, and the quality of the text."""
    shown = {"company_name": "N/A", "location": "N/A", "country": "?", "salary_currency": "EUR"}
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) if c in df.columns else F.lit(v) for c, v in shown.items()}
    return df.withColumns({**filled, "data_quality": data_quality()})


def data_quality() -> Column:
    """P17."""
    return F.when(F.length(F.coalesce("description", F.lit(""))) >= 300, "full").otherwise("partial")


def feed_page(df: DataFrame, sort: str, descending: bool, page: int, per_page: int) -> DataFrame:
    """T02. One page. `date` orders by (posted_at, scraped_at, id) in one direction; other columns fall back to the newest
    posting. Nulls come last."""
    way = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_last(c))
    order = [way(c) for c in ("posted_at", "scraped_at", "id")] if sort == "date" else [way(sort), F.desc_nulls_last("posted_at"), F.desc("id")]
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def after_key(df: DataFrame, key: tuple[str | None, str | None, int], per_page: int, descending: bool = True) -> DataFrame:
    """T02 for deep pages by date: the rows after the last one seen (posted_at, scraped_at, id), without counting off the ones
    before. Nulls come last, in both directions, so what follows a null is null as well."""
    after, same = F.lit(False), F.lit(True)
    for column, kind, value in zip(("posted_at", "scraped_at", "id"), ("timestamp_ntz", "timestamp_ntz", "long"), key):
        own = F.col(column)
        if value is None:
            same = same & own.isNull()
            continue
        at = F.lit(value).cast(kind)
        after = after | (same & (own.isNull() | (own < at if descending else own > at)))
        same = same & (own == at)
    return feed_page(df.where(after), "date", descending, 1, per_page)


def unreviewed(scores: DataFrame, applications: DataFrame, min_score: int) -> DataFrame:
    """J02. Scored postings that the user has not applied to, rejected or withdrawn; `place` counts them per user, best first."""
    done = applications.where(F.col("status").isin("applied", "rejected", "withdrawn"))
    left = scores.where(F.col("score") >= min_score).join(done, ["user_id", "job_id"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id")))


def applications_with_jobs(applications: DataFrame, jobs: DataFrame, user_id: int | None = None, status: str | None = None) -> DataFrame:
    """J10. Applications (of one user, in one status) with their posting; `place` counts them per user, newest update first."""
    own = applications if user_id is None else applications.where(F.col("user_id") == user_id)
    own = own if status is None else own.where(F.col("status") == status)
    found = own.join(jobs.select(F.col("id").alias("job_id"), "title", "company_name"), "job_id").select("user_id", "job_id", "status", "title", "company_name", "updated_at")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "job_id")))


def embedding_queue(jobs: DataFrame, vectors: DataFrame, n: int = 70) -> DataFrame:
    """T04. Postings without a vector (id), newest scraped first."""
    return jobs.join(vectors.select("id"), "id", "left_anti").orderBy(F.desc("scraped_at"), "id").limit(n)


def stale_profiles(profiles: DataFrame, seen: int = 200, n: int = 20) -> DataFrame:
    """T05. Of the `seen` profiles updated last, the first n whose vector belongs to another hash."""
    newest = profiles.orderBy(F.desc("updated_at"), "user_id").limit(seen)
    return newest.where(~F.col("embedding_profile_hash").eqNullSafe(F.col("profile_hash"))).orderBy(F.desc("updated_at"), "user_id").limit(n)


def search_results(scores: DataFrame, least: int = 40, n: int = 100) -> DataFrame:
    """T11. Scored candidates, best first."""
    return scores.where(F.col("score") >= least).orderBy(F.desc("score"), "job_id", "user_id").limit(n)


def recent_events(events: DataFrame, n: int = 12) -> DataFrame:
    """T10. The newest events."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def recent_scans(events: DataFrame, n: int = 8) -> DataFrame:
    """T10. The newest scans; `latest_status` is that of the last one."""
    last = recent_events(events.where(F.col("event_type") == "scan"), n)
    return last.withColumn("latest_status", F.max_by("status", F.struct("created_at", "id")).over(Window.partitionBy(F.lit(1))))


def url_check_queue(jobs: DataFrame, as_of: str, hours: int = 20, n: int = 500) -> DataFrame:
    """T03. Never checked first, then the oldest checks beyond `hours`."""
    due = F.col("url_checked_at").isNull() | (F.col("url_checked_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return jobs.where((F.coalesce("url", F.lit("")) != "") & due).orderBy(F.asc_nulls_first("url_checked_at"), "id").limit(n)


def visible(jobs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What T07 holds scores against: each user's hidden countries, and each posting's country."""
    hidden = profiles.select("user_id", F.filter(F.transform(X.clean_list(F.col("hidden_countries")), F.lower), lambda c: c.rlike("^[a-z]{2}$")).alias("hidden"))
    return hidden, jobs.select(F.col("id").alias("job_id"), X.normalize_country(F.col("country")).alias("country"))


def best_per_user(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("user_id", "job_id", "score", "place")


def top_matches(scores: DataFrame, jobs: DataFrame, profiles: DataFrame, threshold: int = 80, n: int = 10) -> DataFrame:
    """T07. Best scores per user outside the user's hidden countries."""
    hidden, j = visible(jobs, profiles)
    ok = scores.where(F.col("score") >= threshold).join(j, "job_id").join(hidden, "user_id").where(F.col("country").isNull() | ~F.array_contains("hidden", F.col("country")))
    return best_per_user(ok, n)


def candidate_order(candidates: DataFrame, n: int = 80, by: str = "user_id") -> DataFrame:
    """W11. new-high, new-medium, seen-high, seen-medium, stable inside; the first n per user. Profiles of one signature that have seen
    the same have one order: take signature_verdicts by `sig`, and rules.for_users of the result."""
    group = F.when(F.col("seen"), 2).otherwise(0) + F.when(F.col("bucket") == "high", 0).otherwise(1)
    w = Window.partitionBy(by).orderBy("class", "seq")
    return candidates.withColumn("class", group).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def prefix_search(jobs: DataFrame, term: str) -> DataFrame:
    """F26 by a scan. Every word of the term is a prefix of some word of title, company or description. For many searches of one
    table see search.write_token_index."""
    wanted = term_words(term)
    text = F.concat(F.lit(" "), F.concat_ws(" ", *[F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " ") for c in ("title", "company_name", "description")]))
    return jobs.where(reduce(lambda a, b: a & b, [F.contains(text, F.lit(f" {w}")) for w in wanted], F.lit(True)))


def substring_search(jobs: DataFrame, term: str) -> DataFrame:
    """F27."""
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return jobs.where(hit("title") | hit("company_name"))


def search_rank(jobs: DataFrame, term: str, title_weight: float = 1.0, text_weight: float = 0.4) -> DataFrame:
    """F28 by a scan. Cover-density rank: the sum, over the minimal stretches of words that hold all words of the term, of the mean
    weight over the stretch's length. Title and company count `title_weight`, the description `text_weight`."""
    wanted = term_words(term)
    words = posting_words()
    hits = F.filter(F.transform(words, lambda w: F.struct(w["position"].alias("position"), w["head"].alias("head"), prefixes_of(w["token"], wanted).alias("mask"))), lambda w: w["mask"] > 0)
    return prefix_search(jobs, term).withColumn("rank", cover_density(hits, len(wanted), title_weight, text_weight))


def error_events(log: DataFrame) -> DataFrame:
    """P21. Failing API requests of an access log (method, path, status)."""
    bad = (F.col("status") >= 400) & F.startswith(F.col("path"), F.lit("/api")) & ~((F.col("method") == "GET") & (F.col("status") == 404))
    return log.where(bad).select("*", F.when(F.col("status") >= 500, "error").otherwise("warn").alias("level"), F.concat(F.col("method"), F.lit(" "), F.col("path"), F.lit(" -> "), F.col("status").cast("string")).alias("message"))
