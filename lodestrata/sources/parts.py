"""Tables of parts: a list of parts that readers follow, swapped as a whole.

Every version of the list is a file of its own with the next number, created only if no one else has; a writer that comes
second reads the new list and tries again. Data lies in folders of their own, so a reader that has begun on an old list
finds its files until ``vacuum`` takes what no recent list names. Reading, adding, pruning and merging look at the list, never
at folders, so their cost does not grow with what has been stored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists that readers may still be at; older ones and what only they name is taken away.
RECENT = 3
#: What ends a list that is whole; seconds after which a list without it counts as given up.
END, LOST = "\n#", 60


class PartStore:
    """Parts by day under a folder, as Parquet or JSON lines. ``schema`` has all columns, with the day as text in ``day_column``.

    A part has a batch: what is added again under the same batch replaces it. Counters go along with the list: ``counters``
    gives them as they were before a batch, also where that batch runs again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, day_column: str = "day", kind: str = "parquet"):
        self.spark, self.path, self.schema, self.day, self.kind = spark, path.rstrip("/"), schema, day_column, kind

    # files

    def _fs(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._fs("_lists")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def _read(self, number: int) -> dict | None:
        fs, path = self._fs(f"_lists/{number:012d}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text.removesuffix(END)) if text.endswith(END) else None  # else it is being written

    def state(self) -> dict:
        """The newest whole list: number, parts (name, day, batch, rows), counters, the batch that set them and what they were before."""
        for number in reversed(self._numbers()):
            found = self._read(number)
            if found is not None:
                return found | {"number": number}
        return {"number": 0, "parts": [], "counters": {}, "batch": None, "before": {}}

    def _swap(self, change: Callable[[dict], dict]) -> dict:
        """Write the list that ``change`` makes of the newest one, as its successor."""
        while True:
            now = self.state()
            new = change({k: v for k, v in now.items() if k != "number"})
            number = now["number"] + 1
            while self._dead(number):
                number += 1
            fs, path = self._fs(f"_lists/{number:012d}")
            try:
                stream = fs.create(path, False)
            except Exception as e:  # noqa: BLE001  another writer has the number: begin again from its list
                if "exist" not in str(e).lower():
                    raise
                time.sleep(0.05)
                continue
            try:
                stream.write(bytearray((json.dumps(new) + END).encode()))
            finally:
                stream.close()
            return new

    def _dead(self, number: int) -> bool:
        """Whether a list is there that its writer has left unfinished for ``LOST`` seconds."""
        fs, path = self._fs(f"_lists/{number:012d}")
        return fs.exists(path) and self._read(number) is None and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > LOST

    # parts

    def _write(self, rows: DataFrame, batch: str | None) -> list[dict]:
        """Data of a part, by day; its entries. The days are few: those of a batch, or those kept."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("__day", F.col(self.day)).write.partitionBy("__day").format(self.kind).save(f"{self.path}/{name}")
        fs, path = self._fs(name)
        days = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        text = lambda d: self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(d.partition("=")[2])
        return [{"name": f"{name}/{d}", "day": text(d), "batch": batch} for d in days]

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.kind).load([f"{self.path}/{n}" for n in sorted(names)])

    def add(self, rows: DataFrame, batch: str, count: Callable[[DataFrame], dict] | None = None) -> None:
        """Rows as the part of ``batch``; ``count`` of the rows as written gives the counters that change."""
        found = self._write(rows, str(batch))
        changed = count(self._rows([p["name"] for p in found])) if count else {}

        def change(now: dict) -> dict:
            before = now["before"] if now["batch"] == str(batch) else now["counters"]
            kept = [p for p in now["parts"] if p["batch"] != str(batch)]
            return {"parts": kept + found, "counters": before | changed, "batch": str(batch), "before": before}

        self._swap(change)

    def counters(self, batch: str) -> dict:
        """The counters before a batch."""
        now = self.state()
        return now["before"] if now["batch"] == str(batch) else now["counters"]

    def read(self, since: str | None = None, days: list[str] | None = None) -> DataFrame:
        """All rows with their day; of days from ``since`` on or of some days, only their parts are opened."""
        return self._rows([p["name"] for p in self.state()["parts"] if (since is None or p["day"] >= since) and (days is None or p["day"] in days)])

    def prune(self, since: str) -> int:
        """Take days before ``since`` off the list without reading them; how many parts that were."""
        gone = sum(p["day"] < since for p in self.state()["parts"])
        if gone:
            self._swap(lambda now: now | {"parts": [p for p in now["parts"] if p["day"] >= since], "counters": {d: c for d, c in now["counters"].items() if d >= since}, "before": {d: c for d, c in now["before"].items() if d >= since}})
        return gone

    def merge(self, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Parts of days that have several become one, through ``fold`` (counts added up, say); how many were merged.

        The newest batch's part stays by itself, as that batch may run again. Parts that come meanwhile stay too.
        """
        now = self.state()
        old = [p for p in now["parts"] if p["batch"] != now["batch"] or p["batch"] is None]
        several = {d for d in {p["day"] for p in old} if sum(p["day"] == d for p in old) > 1}
        names = {p["name"] for p in old if p["day"] in several}
        if not names:
            return 0
        rows = self._rows(list(names))
        found = self._write(fold(rows).repartition(self.day), None)

        def change(state: dict) -> dict:
            have = {p["name"] for p in state["parts"]}
            if not names <= have:  # pruned meanwhile: what is left of the old parts must not come back
                days = {p["day"] for p in state["parts"]}
                return state | {"parts": [p for p in state["parts"] if p["name"] not in names] + [p for p in found if p["day"] in days]}
            return state | {"parts": [p for p in state["parts"] if p["name"] not in names] + found}

        self._swap(change)
        return len(names)

    def vacuum(self, recent: int = RECENT) -> int:
        """Delete lists but the last ``recent``, and data that none of those names; how many data folders that were.

        Data that is being written is on no list yet: call this where no batch or merge runs.
        """
        numbers = self._numbers()
        kept = [s for s in map(self._read, numbers[-recent:]) if s is not None]
        named = {p["name"].split("/")[1] for s in kept for p in s["parts"]}
        for number in numbers[:-recent]:
            fs, path = self._fs(f"_lists/{number:012d}")
            fs.delete(path, False)
        fs, path = self._fs("data")
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in named] if fs.exists(path) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def add_up(keys: list[str], sums: list[str], **others: str) -> Callable[[DataFrame], DataFrame]:
    """A fold that adds up ``sums`` by key; ``others`` are further aggregates by column, as SQL."""
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in sums), *(F.expr(e).alias(c) for c, e in others.items()))
