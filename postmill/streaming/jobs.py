"""Structured Streaming forms of the incremental pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import insert_if_absent
from ..operators.feed import best_per_user, visible


def stream_dedup(postings: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST01. First posting of each dedup_hash; state is bounded by the watermark on event_time."""
    return postings.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["dedup_hash"])


def insert_batches(store: str) -> Callable[[DataFrame, int], None]:
    """ST02. For foreachBatch: each micro-batch adds only new hashes, as one folder per batch, so a replay writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.option("basePath", store).parquet(store).where(F.col("batch") < batch_id)
        except Exception as missing:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            before = batch.limit(0)
        insert_if_absent(batch, before).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return write


def event_rate_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """ST03. Counts by type and status in tumbling or sliding windows of `ts`; later events than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(window, "event_type", "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "status", "n")


#: Spark's own setting: folds with timers keep their state in RocksDB, on disk and not in the executors' memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Fold(StatefulProcessor):
    """One key's events in order of time, folded from micro-batch to micro-batch; what it keeps of a key has a lifetime.

    A fold names its state's columns, reads it with `load`, and returns it from `fold` with the event time (in milliseconds) from
    which on nobody needs it. An event-time timer then drops it, once the watermark has passed that time."""

    state_schema = ""
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        events = pd.concat(list(rows)).sort_values(["t", "event_id"])
        out, after, until = self.fold(key, before, events)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if after:
            self.kept.put(after)
            self.handle.registerTimer(int(until))
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def fold(self, key, before: list[tuple], events: pd.DataFrame) -> tuple[list[tuple], list[tuple], float]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _folded(events: DataFrame, keys: tuple[str, ...], time: str, columns: list[str], fold: _Fold, schema: str, mode: str, delay: str) -> DataFrame:
    events.sparkSession.conf.set(*STATE_STORE)
    at = F.col(time).cast("timestamp")
    narrow = events.withColumn("at", at).withWatermark("at", delay).select(*keys, *columns, "event_id", (F.unix_micros("at") / 1e6).alias("t"), "at")
    return narrow.groupBy(*keys).transformWithStateInPandas(fold, schema, mode, "eventTime")


class _Liveness(_Fold):
    state_schema = "status string, failures int"
    columns = ("job_id", "status", "failures")

    def __init__(self, limit: int, days: int) -> None:
        self.limit, self.days = limit, days

    def fold(self, key, before, events):
        status, failures = before[0] if before else (None, 0)
        for transient, new in zip(events["transient"], events["status"]):
            if not transient:
                status, failures = new, 0
                continue
            failures += 1
            status = "unreachable" if failures >= self.limit else status
        return [(key[0], status, failures)], [(status, failures)], (float(events["t"].iloc[-1]) + 86_400 * self.days) * 1000


def liveness_stream(checks: DataFrame, limit: int = 3, days: int = 45, delay: str = "1 day") -> DataFrame:
    """ST04 as a stream of (job_id, checked_at, fetch_id, status, transient): the state of a job after each micro-batch that has
    checks of it. A transient failure counts up to `unreachable`, a definite result sets the status. Checks of a micro-batch are
    taken by time, then fetch_id. A job without checks for `days` (by the watermark) is forgotten."""
    named = checks.withColumnRenamed("fetch_id", "event_id")
    return _folded(named, ("job_id",), "checked_at", ["status", "transient"], _Liveness(limit, days), "job_id long, status string, failures int", "update", delay)


def limit_audit(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """ST05 over a batch of (subject, key, ts, event_id): admitted unless `limit` admitted events lie in the last window, its far
    edge included; and the seconds to wait. A task streams over the sorted events of its keys and holds the
    admitted ones of the last window only, so a hot key costs time but no memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for f in frames:
            rows = []
            for subject, key, t, event in zip(f["subject"], f["key"], f["t"], f["event_id"]):
                if (subject, key) != current:
                    current, held = (subject, key), []
                held = [h for h in held if h >= t - seconds]
                ok = len(held) < limit
                rows.append((event, ok, 0.0 if ok else round(held[0] + seconds - t, 6)))
                if ok:
                    held.append(t)
            yield pd.DataFrame(rows, columns=["event_id", "admitted", "retry_after"])

    narrow = events.select("subject", "key", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    dealt = narrow.repartition("subject", "key").sortWithinPartitions("subject", "key", "t", "event_id")
    return dealt.mapInPandas(run, "event_id long, admitted boolean, retry_after double")


def breaker_intervals(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """ST06. Per backend: `threshold` failures in a row open the breaker until the next UTC midnight; calls in between do not
    count, and success resets. Rows (backend, opened_at, until), from (backend, ts, ok, event_id)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, failures, until = None, 0, None
        for f in frames:
            rows = []
            for backend, ts, ok in zip(f["backend"], f["ts"], f["ok"]):
                if backend != current:
                    current, failures, until = backend, 0, None
                if until is not None and ts < until:
                    continue
                until = None
                failures = 0 if ok else failures + 1
                if failures >= threshold:
                    until = ts.normalize() + pd.Timedelta(days=1)
                    rows.append((backend, ts, until))
                    failures = 0
            yield pd.DataFrame(rows, columns=["backend", "opened_at", "until"])

    dealt = calls.select("backend", "ts", "ok", "event_id").repartition("backend").sortWithinPartitions("backend", "ts", "event_id")
    return dealt.mapInPandas(run, "backend string, opened_at timestamp_ntz, until timestamp_ntz")


class _Limit(_Fold):
    state_schema = "t double"
    columns = ("event_id", "admitted", "retry_after")

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def fold(self, key, before, events):
        held, out = [t for (t,) in before], []
        for t, event in zip(events["t"], events["event_id"]):
            held = [h for h in held if h >= t - self.seconds]
            ok = len(held) < self.limit
            out.append((event, ok, 0.0 if ok else round(held[0] + self.seconds - t, 6)))
            if ok:
                held.append(t)
        return out, [(t,) for t in held], (held[-1] + self.seconds) * 1000 + 1 if held else 0


def limit_stream(events: DataFrame, limit: int, seconds: float, delay: str = "1 hour") -> DataFrame:
    """ST05 as a stream of (subject, key, ts, event_id): the state of a key is the admitted times of its last window, and nothing once
    the watermark has left that window. Events of a micro-batch are taken by time; a later micro-batch goes on from the state."""
    return _folded(events, ("subject", "key"), "ts", [], _Limit(limit, seconds), "event_id long, admitted boolean, retry_after double", "append", delay)


class _Breaker(_Fold):
    state_schema = "failures int, until double"
    columns = ("backend", "opened", "until")

    def __init__(self, threshold: int, days: int) -> None:
        self.threshold, self.days = threshold, days

    def fold(self, key, before, events):
        failures, until = before[0] if before else (0, 0.0)
        out = []
        for t, ok in zip(events["t"], events["ok"]):
            if t < until:
                continue
            failures = 0 if ok else failures + 1
            if failures >= self.threshold:
                until, failures = (t // 86_400 + 1) * 86_400, 0
                out.append((key[0], t, until))
        last = float(events["t"].iloc[-1])
        # Failures in a row are kept for `days`; a closed breaker without any is kept no longer than it is open.
        kept = [(failures, until)] if failures or until > last else []
        return out, kept, max(until, last + 86_400 * self.days if failures else 0.0) * 1000


def breaker_stream(calls: DataFrame, threshold: int = 3, days: int = 30, delay: str = "1 day") -> DataFrame:
    """ST06 as a stream of (backend, ts, ok, event_id), ts in UTC: the state of a backend is its failures in a row and until
    when it is open. Seconds since the epoch keep the midnight free of any session's zone. A backend without calls for `days` (by
    the watermark) is forgotten, one without failures at once."""
    found = _folded(calls, ("backend",), "ts", ["ok"], _Breaker(threshold, days), "backend string, opened double, until double", "append", delay)
    return found.select("backend", F.timestamp_micros((F.col("opened") * 1e6).cast("long")).alias("opened_at"), F.timestamp_micros((F.col("until") * 1e6).cast("long")).alias("until"))


def match_alerts(scores: DataFrame, jobs: DataFrame, profiles: DataFrame, threshold: int = 80) -> DataFrame:
    """ST07's stream: new scores (user_id, job_id, score) joined with the static postings and profiles. Left are scores from the
    threshold on of postings outside the user's hidden countries. The static sides are read in each micro-batch, from the files that
    they had when the stream was defined."""
    hidden, country = visible(jobs, profiles)
    joined = scores.where(F.col("score") >= threshold).join(country, "job_id").join(hidden, "user_id")
    return joined.where(F.col("country").isNull() | ~F.array_contains("hidden", F.col("country"))).select("user_id", "job_id", "score")


def alert_batches(sink: str, n: int = 10) -> Callable[[DataFrame, int], None]:
    """ST07's sink, for foreachBatch: at most n alerts per user and micro-batch, best first; one folder per batch, so a replay
    writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        best_per_user(batch, n).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return write
