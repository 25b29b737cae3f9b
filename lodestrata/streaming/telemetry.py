"""Streaming forms of the telemetry operators; they give the batch operator's result on the same rows.

Counts, digests, queue states and reports are kept as one part per micro-batch in a ``PartStore``: a batch that runs again
after a failure replaces its own part, so nothing counts twice, and rows count however late they come. Reading adds the
parts up; ``tidy`` drops old days and merges small parts, and readers see the parts before or after it.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.functions import scalars as S
from lodestrata.operators import folds, jobs, telemetry
from lodestrata.sources.parts import PartStore, add_up

LATE = "2 days"
#: Seconds after its last row that a visitor's decision or a job's progress is kept for.
KEEP = 400 * 86_400.0


def _timed(rows: DataFrame) -> DataFrame:
    """Rows with an event time from ``at`` (seconds), so that state ends when the watermark passes it."""
    return rows.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", LATE)


def _until(state: GroupState, seconds: float) -> None:
    state.setTimeoutTimestamp(max(int(seconds * 1000), state.getCurrentWatermarkMs() + 1))


def _folded(rows: DataFrame, key: str, step: folds.Step, start: str, out: str, kind: str, end: Callable[[tuple], float]) -> DataFrame:
    """rows (key, at, id) -> id and ``out``: a step of ``folds`` along each key's rows, its state kept from batch to batch until
    ``end`` of it. The rows of a key in one batch are put in order of time first."""

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        found = []
        for at, own in zip(rows["at"].tolist(), rows["id"].tolist(), strict=True):
            now, value = step(now, (at, own))
            found.append((own, value))
        state.update(now)
        _until(state, end(now))
        yield pd.DataFrame(found, columns=["id", out]).astype({out: "Int64" if kind == "long" else "boolean"})

    return _timed(rows).groupBy(key).applyInPandasWithState(fold, f"id long, {out} {kind}", start, "append", GroupStateTimeout.EventTimeTimeout)


def clean_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stateless: as in batch."""
    return telemetry.clean_events(raw)


def count_events(events: DataFrame) -> DataFrame:
    """Running totals by UTC day and event, in update mode, for those who watch; rows over two days late are in ``store_totals`` only."""
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "name", F.lit(None).cast("string").alias("value"), "n")


#: What is stored of each stream, and how its parts become one.
TOTALS = "day string, name string, value string, n long, first struct<ts:timestamp,event_id:long>"
DIGEST = "day string, repeat_of long, n long"
QUEUE = "day string, id long, status string, previous string, has_file boolean, seq long"
REPORTS = "day string, id long, at timestamp, suspect boolean, bytes long, report_id string, diag_state string"
_LAST = "max_by(struct(status, previous, has_file, seq), seq)"


def _last(changes: DataFrame) -> DataFrame:
    """The last change of each item. A state has no day: all parts are of the day 'now'."""
    return changes.groupBy("id").agg(F.expr(_LAST).alias("x")).select(F.lit("now").alias("day"), "id", "x.*")


FOLDS = {TOTALS: add_up(["day", "name", "value"], ["n"], first="min(first)"), DIGEST: add_up(["day", "repeat_of"], ["n"]), QUEUE: _last}


def _store(rows: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch adds ``part`` of its rows."""

    def add(batch: DataFrame, number: int) -> None:
        PartStore(batch.sparkSession, path, schema).add(part(batch), str(number))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """What a stream has stored so far (of days from ``since`` on); no rows before its first batch."""
    return PartStore(spark, path, schema).read(since)


def tidy(spark: SparkSession, path: str, schema: str, since: str | None = None) -> None:
    """Take days before ``since`` away and merge what several batches have stored of a day."""
    store = PartStore(spark, path, schema)
    if since is not None:
        store.prune(since)
    store.merge(FOLDS[schema])


def store_totals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Partial counts of events (name, value, ts, event_id)."""
    return _store(events, telemetry.partial_counts, path, TOTALS, checkpoint)


def stored_totals(spark: SparkSession, path: str, most: int = telemetry.MAX_VALUES) -> DataFrame:
    """Totals and counts by value of all stored batches, as ``telemetry.count_events`` of all rows: day, name, value, n."""
    return telemetry.folded_counts(stored(spark, path, TOTALS), most)


def store_digest(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Repeats by day and first report, of reports (at, repeat_of)."""
    counted = lambda r: r.where("repeat_of IS NOT NULL").groupBy(S.utc_day(F.col("at")).alias("day"), "repeat_of").agg(F.count(F.lit(1)).alias("n"))
    return _store(reports, counted, path, DIGEST, checkpoint)


def stored_digest(spark: SparkSession, path: str, k: int = 15) -> DataFrame:
    """The digest of all stored days, as ``telemetry.error_digest``."""
    return telemetry.digest(stored(spark, path, DIGEST), k)


def store_queue(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last change of each item in a batch, of changes (id, status, previous, has_file, seq)."""
    return _store(changes, _last, path, QUEUE, checkpoint)


def stored_queue(spark: SparkSession, path: str) -> DataFrame:
    """The state of every item as it is restored, as ``jobs.queue_state``."""
    return jobs.queue_state(stored(spark, path, QUEUE).drop("day"))


def dedup_errors(reports: DataFrame, seconds: float = 86_400.0) -> DataFrame:
    """reports (key, at, id) -> id, repeat_of; state per key is the open window's first report, dropped when it ends."""
    return _folded(reports, "key", folds.repeating(seconds), "at double, first long", "repeat_of", "long", lambda s: s[0] + seconds)


def rate_limit(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """hits (key, at, id) -> id, allowed; state per key is its window's start and two counts."""
    step = folds.limiting(limit, window)
    return _folded(hits, "key", lambda s, v: step(s, v[:1]), "begin double, count long, before long", "allowed", "boolean", lambda s: s[0] + 2 * window)


def consent_gate(events: DataFrame, keep: float = KEEP) -> DataFrame:
    """events (visitor, ts in seconds, event_id, decision) -> ids of rows that pass; state per visitor is the latest decision and
    time, and ends ``keep`` seconds after the visitor's last row."""

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest, seen = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        decided = rows["decision"].where(rows["decision"].notna()).ffill().fillna(latest if latest is not None else "")
        passed = rows["event_id"][(decided == "granted") & rows["decision"].isna()]
        seen = max(seen, float(rows["at"].max()))
        state.update((str(decided.iloc[-1]), seen))
        _until(state, seen + keep)
        yield pd.DataFrame({"event_id": passed.astype("int64")})

    rows = _timed(events.withColumnRenamed("ts", "at"))
    return rows.groupBy("visitor").applyInPandasWithState(fold, "event_id long", "decision string, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def progress_stream(log: DataFrame, keep: float = KEEP) -> DataFrame:
    """log (job, id, at, done, total, elapsed) -> id, progress, eta as ``jobs.progress_report``; state per job is its progress."""

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, seen = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        progress = jobs.progress_of(rows["done"], rows["total"]).cummax().clip(lower=best)
        seen = max(seen, float(rows["at"].max()))
        state.update((float(progress.iloc[-1]), seen))
        _until(state, seen + keep)
        yield pd.DataFrame({"id": rows["id"], "progress": progress, "eta": jobs.eta_of(progress, rows["done"], rows["total"], rows["elapsed"])})

    return _timed(log).groupBy("job").applyInPandasWithState(fold, "id long, progress double, eta double", "progress double, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def store_reports(accepted: DataFrame, path: str, checkpoint: str, cap: int | None = None) -> StreamingQuery:
    """Accepted reports (id, at, ...) get their id of the day, going on after those of earlier batches, and are stored as JSON
    lines by day. With ``cap`` reports have suspect and bytes too, and get diag_state under the day's cap.

    The last number and the bytes of each day go along with the list of parts, so a batch reads nothing of what is stored.
    """

    def add(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        store = PartStore(spark, path, REPORTS, kind="json")
        before = store.counters(str(number))
        last = [(f"R-{day.replace('-', '')}-{c['last']:04d}",) for day, c in before.items()]
        out = telemetry.assign_report_id(rows, spark.createDataFrame(last, "report_id string") if last else None)
        if cap is not None:
            held = [(day, c["bytes"]) for day, c in before.items()]
            out = telemetry.store_policy(out, cap, spark.createDataFrame(held, "day string, bytes long") if held else None)
        columns = ["day string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)]
        store.schema = ", ".join(columns)

        def count(written: DataFrame) -> dict:
            due = F.sum(F.when(F.col("diag_state").isin("kept", "skipped"), F.col("bytes"))) if cap is not None else F.lit(0)
            days = written.groupBy("day").agg(F.max(F.substring_index("report_id", "-", -1).cast("long")).alias("last"), F.coalesce(due, F.lit(0)).alias("bytes")).collect()  # the days of a micro-batch
            return {r["day"]: {"last": r["last"], "bytes": r["bytes"] + before.get(r["day"], {"bytes": 0})["bytes"]} for r in days}

        store.add(out.withColumn("day", S.utc_day(F.col("at"))), str(number), count)

    return accepted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_reports(spark: SparkSession, path: str, schema: str = REPORTS, since: str | None = None, days: list[str] | None = None) -> DataFrame:
    """Stored reports, of days from ``since`` on or of some days; only their files are opened."""
    return PartStore(spark, path, schema, kind="json").read(since, days)


def prune_reports(spark: SparkSession, path: str, today: str, keep: int = telemetry.KEEP_DIAGNOSTICS) -> int:
    """Take away the days that are more than ``keep`` days before ``today``, without reading them; how many parts that were."""
    since = (datetime.date.fromisoformat(today) - datetime.timedelta(days=keep)).isoformat()
    return PartStore(spark, path, REPORTS, kind="json").prune(since)
