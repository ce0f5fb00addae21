"""A store of keyed rows that is updated in place: buckets by a hash of the key, and a new version of only those that change.

    <store>/data/batch=<b>/bucket=<k>/...   rows of bucket k as batch b left them
    <store>/commits/batch=<b>/...           one row for each bucket that batch b changed

A bucket's rows are those of its last committed batch. A batch reads only the buckets that its keys fall into, and writes only
those that it changes; the small table of commits is written last, so a batch that is cut short leaves no trace for readers, and
the same batch again (by its number) starts from the same state and replaces what it left. Old versions stay readable until
`outdated` names them for deletion. Buckets are at most a few thousand, so their list may pass through the driver; rows never do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .dedup import exact_dedup
from .scoring import upsert_scores


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """The last committed batch of each bucket (before a batch); empty if there is no store yet."""
    try:
        commits = spark.read.schema("bucket int, batch long").option("basePath", f"{store}/commits").parquet(f"{store}/commits")
    except Exception as missing:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    commits = commits if before is None else commits.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in commits.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def read_store(spark: SparkSession, store: str, schema: str, only: set[int] | None = None, before: int | None = None) -> DataFrame:
    """Rows of the store with their `bucket`; of `only` these buckets, as they were `before` a batch. No other file is read."""
    at = {k: b for k, b in versions(spark, store, before).items() if only is None or k in only}
    reader = spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", f"{store}/data")
    if not at:
        return spark.createDataFrame([], f"{schema}, bucket int")
    return reader.parquet(*[f"{store}/data/batch={b}/bucket={k}" for k, b in sorted(at.items())]).drop("batch")


def _apply(new: DataFrame, store: str, batch: int, keys: tuple[str, ...], buckets: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
    """Give the touched buckets the rows of change(old rows, new rows), which marks those it made or altered by `changed`."""
    spark = new.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    fresh = new.withColumn("bucket", bucket_of(keys, buckets)).persist()
    try:
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        old = read_store(spark, store, schema, touched, batch)
        after = change(old, fresh).persist()
        try:
            altered = sorted(r["bucket"] for r in after.where("changed").select("bucket").distinct().collect())
            rows = after.where(F.col("bucket").isin(altered)).drop("changed")
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/batch={batch}")
        finally:
            after.unpersist()
    finally:
        fresh.unpersist()
    spark.createDataFrame([(k,) for k in altered], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/batch={batch}")
    return set(altered)


def insert_batch(new: DataFrame, store: str, batch: int, buckets: int = 64) -> set[int]:
    """S14 into a store by dedup_hash: rows whose hash it lacks, first arrival each, with a normal country. Returns the buckets that
    changed."""

    def change(old: DataFrame, fresh: DataFrame) -> DataFrame:
        absent = exact_dedup(fresh).join(old.select("dedup_hash"), "dedup_hash", "left_anti").withColumn("country", X.normalize_country(F.col("country")))
        return old.withColumn("changed", F.lit(False)).unionByName(absent.withColumn("changed", F.lit(True)))

    return _apply(new, store, batch, ("dedup_hash",), buckets, change)


def upsert_batch(new: DataFrame, store: str, batch: int, buckets: int = 64) -> set[int]:
    """S15 into a store by (job_id, user_id); the keys of a batch are distinct. Returns the buckets that changed."""

    def change(old: DataFrame, fresh: DataFrame) -> DataFrame:
        columns = [c for c in fresh.columns if c != "bucket"]
        merged = upsert_scores(old.select(columns), fresh.select(columns)).withColumn("bucket", bucket_of(("job_id", "user_id"), buckets))
        same = old.select(*[F.col(c).alias(f"_{c}") for c in columns])
        equal = F.col("job_id") == F.col("_job_id")
        for c in columns[1:]:
            equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
        keyed = merged.join(same, (F.col("job_id") == F.col("_job_id")) & (F.col("user_id") == F.col("_user_id")), "left")
        return keyed.select(*columns, "bucket", (~F.coalesce(equal, F.lit(False))).alias("changed"))

    return _apply(new, store, batch, ("job_id", "user_id"), buckets, change)


def outdated(spark: SparkSession, store: str) -> list[str]:
    """Folders of the store that no reader of its present state needs."""
    now = versions(spark, store)
    commits = spark.read.schema("bucket int, batch long").option("basePath", f"{store}/commits").parquet(f"{store}/commits")
    return sorted(f"{store}/data/batch={r['batch']}/bucket={r['bucket']}" for r in commits.collect() if r["batch"] != now[r["bucket"]])
