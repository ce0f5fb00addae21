"""Applications, retention and profile upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .scoring import exclude_actioned
from .stats import rejections_by_company

STATUSES = ("saved", "applied", "interviewing", "offer", "rejected", "withdrawn")


def latest_application(events: DataFrame) -> DataFrame:
    """W10. Newest status of each (user, job); the first `applied` time is kept."""
    newest = F.max_by("status", F.struct("changed_at", "event_id"))
    return events.groupBy("user_id", "job_id").agg(newest.alias("status"), F.max("changed_at").alias("updated_at"), F.min(F.when(F.col("status") == "applied", F.col("changed_at"))).alias("applied_at"))


def status_transitions(events: DataFrame) -> DataFrame:
    """W09. Old and new status at each change."""
    w = Window.partitionBy("user_id", "job_id").orderBy("changed_at", "event_id")
    return events.select("user_id", "job_id", "event_id", F.lag("status").over(w).alias("old_status"), F.col("status").alias("new_status"))


def owned_actions(current: DataFrame, actions: DataFrame) -> DataFrame:
    """D09. The actions that count: valid ones by which a user acts on a posting (owner_id null), and status updates of an
    application (owner_id: whose it is) only by its owner and only where there is one."""
    valid = actions.where(F.col("action").isin(*STATUSES))
    own = valid.where(F.col("owner_id").isNull())
    updates = valid.where(F.col("owner_id") == F.col("user_id"))
    there = current.select("user_id", "job_id").unionByName(own.select("user_id", "job_id")).distinct()
    return own.unionByName(updates.join(there, ["user_id", "job_id"], "left_semi").select(own.columns))


def _effective(current: DataFrame, actions: DataFrame) -> DataFrame:
    """Current rows and the actions that change something, in order: save only creates."""
    a = owned_actions(current, actions).select("user_id", "job_id", F.col("action").alias("status"), F.col("at").alias("changed_at"), F.col("seq").alias("event_id"), F.col("owner_id").isNotNull().alias("update"), F.lit(1).alias("new"), F.lit(None).cast("timestamp_ntz").alias("was_applied"))
    first_applied = F.col("applied_at") if "applied_at" in current.columns else F.when(F.col("status") == "applied", F.col("updated_at"))
    c = current.select("user_id", "job_id", "status", F.col("updated_at").alias("changed_at"), F.lit(-1).cast("long").alias("event_id"), F.lit(False).alias("update"), F.lit(0).alias("new"), first_applied.alias("was_applied"))
    w = Window.partitionBy("user_id", "job_id").orderBy("new", "changed_at", "event_id")
    rows = c.unionByName(a).withColumn("_n", F.row_number().over(w))
    # A save of what is there does nothing; an update cannot create.
    rows = rows.where((F.col("new") == 0) | ((F.col("_n") == 1) & ~F.col("update")) | ((F.col("status") != "saved") | F.col("update")))
    return rows.withColumn("old_status", F.lag("status").over(w))


def apply_actions(current: DataFrame, actions: DataFrame) -> DataFrame:
    """D09. Applications after a log of actions (user_id, job_id, action, at, seq, owner_id): save only creates, others set
    the status. `applied` by the user sets applied_at each time; as a status update it sets it only where there is none."""
    order = F.struct("new", "changed_at", "event_id")
    by_user = F.max(F.when((F.col("status") == "applied") & (F.col("new") == 1) & ~F.col("update"), F.col("changed_at")))
    by_update = F.min(F.when((F.col("status") == "applied") & F.col("update"), F.col("changed_at")))
    rows = _effective(current, actions).groupBy("user_id", "job_id")
    return rows.agg(F.max_by("status", order).alias("status"), F.max(order)["changed_at"].alias("updated_at"), F.coalesce(by_user, F.max("was_applied"), by_update).alias("applied_at"))


def action_history(current: DataFrame, actions: DataFrame) -> DataFrame:
    """D09. One row per change that the actions make: old and new status; old is null where the action creates. A save that
    creates leaves no row."""
    rows = _effective(current, actions).where("new = 1 and not (old_status is null and status = 'saved')")
    return rows.select("user_id", "job_id", F.col("event_id").alias("seq"), "old_status", F.col("status").alias("new_status"), "changed_at")


def retention(jobs: DataFrame, applications: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    """D02. What stays: postings scraped since the cutoff or with a live application of any user, and those without the time."""
    live = applications.where(F.col("status").isin("applied", "interviewing", "offer")).select(F.col("job_id").alias("id")).distinct()
    fresh = F.coalesce(F.col("scraped_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), F.lit(True))
    return jobs.where(fresh).unionByName(jobs.where(~fresh).join(live, "id", "left_semi").select(jobs.columns))


def cascade_delete(child: DataFrame, kept: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """D03. Child rows whose parent is kept."""
    return child.join(kept.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def jobs_at_excluded_company(jobs: DataFrame, applications: DataFrame, company: str, user_id: int) -> DataFrame:
    """J09. Postings of a company without the user's applied or rejected ones."""
    acted = applications.where((F.col("user_id") == user_id) & F.col("status").isin("applied", "rejected")).select(F.col("job_id").alias("id"))
    return jobs.where(F.lower("company_name") == company.lower()).join(acted, "id", "left_anti")


def auto_exclude_companies(profiles: DataFrame, applications: DataFrame, jobs: DataFrame, threshold: int = 5) -> DataFrame:
    """D04. Profiles' exclusion lists with the companies that the user rejected often, each once (any case)."""
    more = rejections_by_company(applications, jobs, threshold).groupBy("user_id").agg(F.array_sort(F.collect_list("company")).alias("more"))
    listed = X.clean_list(F.col("excluded_companies"))
    return profiles.join(more, "user_id", "left").select("user_id", X.distinct_in_order(F.concat(listed, F.coalesce("more", F.array().cast("array<string>")))).alias("excluded_companies"))


def zero_excluded(scores: DataFrame, profiles: DataFrame, applications: DataFrame, jobs: DataFrame, threshold: int = 5, note: str = "company excluded") -> DataFrame:
    """D04. Scores after auto-exclusion: 0 with a note at a company that is newly excluded for the user (rejected at least
    `threshold` times and not yet in the profile's list), but for postings the user applied to or rejected (J09)."""
    listed = profiles.select("user_id", F.transform(X.clean_list(F.col("excluded_companies")), F.lower).alias("listed"))
    fresh = rejections_by_company(applications, jobs, threshold).join(listed, "user_id").where(~F.array_contains("listed", F.col("company"))).select("user_id", "company")
    at = jobs.select(F.col("id").alias("job_id"), F.lower("company_name").alias("company")).join(fresh, "company").select("user_id", "job_id")
    acted = applications.where(F.col("status").isin("applied", "rejected")).select("user_id", "job_id")
    hit = at.join(acted, ["user_id", "job_id"], "left_anti").distinct().withColumn("_hit", F.lit(True))
    joined = scores.join(hit, ["user_id", "job_id"], "left")
    return joined.withColumns({"score": F.when(F.col("_hit"), 0).otherwise(F.col("score")), "ai_analysis": F.when(F.col("_hit"), note).otherwise(F.col("ai_analysis"))}).select(scores.columns)


def eligible(jobs: DataFrame, valid: DataFrame, applications: DataFrame, user_id: int) -> DataFrame:
    """U04. Postings (with dedup_hash) without those that the user has a valid score of (J05), and without those that the user applied to
    or rejected, by id or by dedup_hash (J04)."""
    scored = valid.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"))
    return exclude_actioned(jobs.join(scored, "id", "left_anti"), applications, user_id, jobs)


def country_support(wanted: Column, supported: list[str]) -> Column:
    """U01. struct<supported,skipped> of an array of country codes, in order."""
    has = F.array(*map(F.lit, supported))
    low = F.transform(wanted, F.lower)
    return F.struct(F.array_intersect(low, has).alias("supported"), F.array_except(low, has).alias("skipped"))


def split_exclusions(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """U03. Keywords that name a known company move to the company list; the rest stay, in order."""
    known = jobs.select(F.lower(F.trim("company_name")).alias("k")).where("k is not null").distinct().withColumn("known", F.lit(True))
    items = profiles.select("user_id", F.posexplode_outer(X.clean_list(F.col("excluded_keywords"))).alias("pos", "item"))
    j = items.withColumn("k", F.lower("item")).join(known, "k", "left")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "item")))), lambda s: s["item"])
    return j.groupBy("user_id").agg(pick(F.col("known").isNotNull()).alias("companies"), pick(F.col("known").isNull() & F.col("item").isNotNull()).alias("keywords"))


def invalidate_embeddings(profiles: DataFrame, belonging: tuple[str, ...] = ("embedding", "embedding_model", "embedding_updated_at", "embedding_profile_hash")) -> DataFrame:
    """D08. Vector, model, time and hash are null where the profile's hash is another one."""
    same = F.col("profile_hash").eqNullSafe(F.col("embedding_profile_hash"))
    return profiles.withColumns({c: F.when(same, F.col(c)) for c in belonging if c in profiles.columns})


def profile_hash(columns: list[str], lists: list[str], version: str = "1") -> Column:
    """F18. Hash of the rules' version and the scoring fields: strings trimmed, lists sorted, without blanks."""
    plain = [F.trim(F.col(c).cast("string")).alias(c) for c in sorted(columns)]
    sets = [F.array_sort(F.filter(F.transform(F.col(c), lambda x: F.trim(x)), lambda x: x != "")).alias(c) for c in sorted(lists)]
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), *plain, *sets)), 256)
