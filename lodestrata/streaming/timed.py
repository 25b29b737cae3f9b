"""Streams that answer when the watermark has passed: the daily digest, and limits by client and of all clients together.

Both keep state with timers in event time. Rows later than the watermark's delay are left out. The state store must be
RocksDB, which ``timers`` sets for the session: timers need it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators import folds

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
LATE = "2 days"
#: Keys over which hits that their client's limit refuses are spread; they only pass through.
REFUSED = 64


def timers(spark: SparkSession) -> None:
    """Let streams of this session use timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class DayDigest(StatefulProcessor):
    """Of one day: counts by first report, and when the day is over its digest, once."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "repeat_of long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for f in rows:
            for repeat_of, n in zip(f["repeat_of"].tolist(), f["n"].tolist(), strict=True):
                before = self.counts.getValue((repeat_of,))
                self.counts.updateValue((repeat_of,), ((before[0] if before else 0) + n,))
        self.handle.registerTimer((int(pd.Timestamp(key[0], tz="UTC").timestamp()) * 1000) + DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        every, top = 0, []
        for (repeat_of,), (n,) in self.counts.iterator():
            every += 1
            entry = (n, -repeat_of)
            if len(top) < self.k:
                heapq.heappush(top, entry)
            else:
                heapq.heappushpop(top, entry)
        self.counts.clear()
        if every:
            rows = [(key[0], -minus, n, i + 1) for i, (n, minus) in enumerate(sorted(top, reverse=True))]
            if every > self.k:
                rows.append((key[0], None, every - self.k, self.k + 1))
            yield pd.DataFrame(rows, columns=["day", "repeat_of", "n", "rank"]).astype({"repeat_of": "Int64"})

    def close(self) -> None:
        pass


def daily_digest(reports: DataFrame, k: int = 15, late: str = LATE) -> DataFrame:
    """reports (at as timestamp, repeat_of) -> day, repeat_of, n, rank, as ``telemetry.error_digest``: each day once, when the
    watermark has passed its end, and none for a day without repeats. Survives a restart from its checkpoint.

    Rows are counted by day and first report before a day's key sees them, so that key gets a row per first report.
    """
    timers(reports.sparkSession)
    rows = reports.where("repeat_of IS NOT NULL").select("at", F.col("repeat_of").cast("long").alias("repeat_of")).withWatermark("at", late)
    counted = rows.groupBy(F.window("at", "1 day").alias("w"), "repeat_of").agg(F.count(F.lit(1)).alias("n"))
    by_day = counted.select(F.window_time("w").alias("at"), F.date_format("w.start", "yyyy-MM-dd").alias("day"), "repeat_of", "n").groupBy("day")
    return by_day.transformWithStateInPandas(DayDigest(k), "day string, repeat_of long, n long, rank int", "Append", "EventTime")


class ClientLimit(StatefulProcessor):
    """Of one client: hits wait until the watermark has passed them, then they are decided in order of time and id."""

    def __init__(self, limit: int, window: float):
        self.step = folds.limiting(limit, window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, id long")
        self.used = handle.getValueState("used", "begin double, count long, before long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for f in rows:
            self.waiting.appendList(list(zip(f["at"].tolist(), f["id"].tolist(), strict=True)))
            self.handle.registerTimer(int(f["at"].min() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if int(r[0] * 1000) < now]
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
        else:
            self.waiting.clear()
        state, found = (tuple(self.used.get()) if self.used.exists() else None), []
        for at, own in due:
            state, allowed = self.step(state, (at,))
            found.append((own, at, allowed))
        if found:
            self.used.update((float(state[0]), int(state[1]), int(state[2])))
            gate = [0 if r[2] else 1 + r[0] % REFUSED for r in found]
            yield pd.DataFrame(found, columns=["id", "at", "own"]).assign(gate=gate)

    def close(self) -> None:
        pass


class JointLimit(StatefulProcessor):
    """Of all clients (gate 0): hits that passed their client's limit, in order of time and id. What other gates get is refused.

    The first stage hands over all hits that a watermark has passed in one batch, and none of them later, so what comes in a
    batch is later than all that came before and needs sorting by itself only.
    """

    def __init__(self, everyone: int, window: float):
        self.step = folds.limiting(everyone, window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "begin double, count long, before long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        if key[0]:
            for f in rows:
                yield pd.DataFrame({"id": f["id"], "allowed": False})
            return
        hits = pd.concat(list(rows)).sort_values(["at", "id"])
        state, found = (tuple(self.used.get()) if self.used.exists() else None), []
        for at in hits["at"].tolist():
            state, allowed = self.step(state, (at,))
            found.append(allowed)
        self.used.update((float(state[0]), int(state[1]), int(state[2])))
        yield pd.DataFrame({"id": hits["id"], "allowed": found})

    def close(self) -> None:
        pass


def rate_limits(hits: DataFrame, client: str, limit: int, everyone: int, window: float, late: str = LATE) -> DataFrame:
    """hits (client, at in seconds, id) -> id, allowed, as ``folds.rate_limits`` of the same rows in order of time and id, in
    whatever order and batches they come within ``late``. Decisions come when the watermark has passed a hit."""
    timers(hits.sparkSession)
    rows = hits.where("at IS NOT NULL").select(client, F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"))
    rows = rows.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    own = rows.groupBy(client).transformWithStateInPandas(ClientLimit(limit, window), "id long, at double, own boolean, gate long", "Append", "EventTime")
    return own.groupBy("gate").transformWithStateInPandas(JointLimit(everyone, window), "id long, allowed boolean", "Append", "None")
