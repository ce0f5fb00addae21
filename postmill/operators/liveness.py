"""Whether a posting's page is still there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Landing pages that a gone posting redirects to.
GENERIC = ("/jobs", "/careers", "/career", "/stellenangebote", "/search", "/vacancies")


def classify_redirect(target: Column) -> Column:
    """F16. closed for no target, the root, a landing page or a path without an id; else active."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(target, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    is_id = lambda s: s.rlike("^[0-9]+$") | ((F.length(s) >= 8) & s.rlike("[0-9]"))
    with_id = F.exists(F.split(path, "[/]"), is_id)
    return F.when((path == "") | F.lower(path).isin(*GENERIC) | ~with_id, "closed").otherwise("active")


def with_gone_marker(fetches: DataFrame, markers: dict[str, list[str]], longest: int = 50_000) -> DataFrame:
    """F17. fetches (url, body) with gone_marker: whether one of its domain's markers is in the first characters of the body.

    Markers belong to registered domains (F15): elsewhere the same words mean nothing."""
    domain = X.registered_domain(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    head = F.lower(F.substring("body", 1, longest))
    hit = F.lit(False)
    for name, wanted in markers.items():
        hit = hit | ((domain == name) & X.has_part(head, [w.lower() for w in wanted]))
    return fetches.withColumn("gone_marker", F.coalesce(hit, F.lit(False)))


def classify_fetch(gone_marker: Column | None = None, get_location: Column | None = None) -> Column:
    """F17. struct<status,transient,soft404> from status_code, location, error_kind and get_status_code. Where the first probe
    was not allowed (405), code and target of the second one (get_location) count."""
    gone = F.lit(False) if gone_marker is None else F.coalesce(gone_marker, F.lit(False))
    second = (F.col("status_code") == 405) & F.col("get_status_code").isNotNull()
    code = F.when(second, F.col("get_status_code")).otherwise(F.col("status_code"))
    target = F.col("location") if get_location is None else F.when(second, get_location).otherwise(F.col("location"))
    hard = F.coalesce(F.col("error_kind").isin("unsafe", "invalid"), F.lit(False))
    transient = ~hard & (F.col("error_kind").isNotNull() | F.coalesce(code >= 500, F.lit(False)))
    soft = ~hard & F.col("error_kind").isNull() & code.between(200, 299) & gone
    status = (
        F.when(hard, "closed")
        .when(transient, "unreachable")
        .when(code.between(200, 299), F.when(gone, "closed").otherwise("active"))
        .when(code.isin(404, 410), "closed")
        .when(code.between(300, 399), classify_redirect(target))
        .otherwise("active")
    )
    return F.struct(status.alias("status"), transient.alias("transient"), F.coalesce(soft, F.lit(False)).alias("soft404"))


def liveness_counts(checks: DataFrame) -> DataFrame:
    """A14. Checks by result; a row that was never probed (no code, no error) is skipped and counts for nothing else."""
    probed = F.col("status_code").isNotNull() | F.col("error_kind").isNotNull()
    count = lambda c: F.count_if(probed & c)
    return checks.agg(F.count_if(probed).alias("checked"), *[count(F.col("c.status") == s).alias(s) for s in ("active", "closed", "unreachable")], count(F.col("c.transient")).alias("transient"), F.count_if(~probed).alias("skipped"), count(F.col("c.soft404")).alias("soft_404"))


def liveness_state(checks: DataFrame, limit: int = 3) -> DataFrame:
    """ST04 over a batch. Per job: failures since the last definite result, and the status they lead to.

    A definite result starts a new group; three transients in a group make the posting unreachable, fewer leave the
    status of the group's definite result."""
    by_time = Window.partitionBy("job_id").orderBy("checked_at", "fetch_id")
    grouped = checks.select("job_id", "checked_at", "fetch_id", "c.status", "c.transient", F.sum(F.when(F.col("c.transient"), 0).otherwise(1)).over(by_time).alias("g"))
    last = grouped.groupBy("job_id", "g").agg(F.count_if("transient").alias("failures"), F.max(F.when(~F.col("transient"), F.col("status"))).alias("definite"), F.max("checked_at").alias("checked_at"))
    newest = last.groupBy("job_id").agg(F.max_by(F.struct("failures", "definite"), "g").alias("x"), F.max("checked_at").alias("checked_at"))
    return newest.select("job_id", F.when(F.col("x.failures") >= limit, "unreachable").otherwise(F.col("x.definite")).alias("status"), F.col("x.failures").alias("failures"), "checked_at")
