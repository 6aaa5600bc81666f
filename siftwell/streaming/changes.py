"""Change streams: debounce, classification, counters and index refresh."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

QUIET = "500 milliseconds"


def debounced(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(path, ts, change, events): of each path's changes that follow each other
    within the quiet time, the last. Works on a batch, and on a stream with a
    watermark on ts."""
    window = F.session_window("ts", quiet)
    rows = changes.groupBy("path", window.alias("w")).agg(F.max("ts").alias("ts"), F.max_by("change", "ts").alias("change"), F.count("*").alias("events"))
    return rows.select("path", "ts", "change", "events")


def counters(changes: DataFrame) -> DataFrame:
    """(change, events, paths): totals and distinct paths by kind."""
    return changes.groupBy("change").agg(F.count("*").alias("events"), F.countDistinct("path").alias("paths"))


def streaming_counters(changes: DataFrame) -> DataFrame:
    """As counters(), with an approximate number of paths, for a stream."""
    return changes.groupBy("change").agg(F.count("*").alias("events"), F.approx_count_distinct("path").alias("paths"))


def activity(changes: DataFrame) -> DataFrame:
    """(first, last, events)."""
    return changes.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))


def recent(changes: DataFrame, now, seconds: int = 30, keep: int = 3) -> DataFrame:
    """The latest changes within so many seconds of now."""
    moment = F.lit(now).cast("timestamp")
    since = moment - F.make_interval(secs=F.lit(seconds))
    return changes.where((F.col("ts") > since) & (F.col("ts") <= moment)).orderBy(F.desc("ts"), "path").limit(keep)


def classified(observed: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """(path, ts, change) of a stream (path, ts, hash; a null hash where the file
    is gone): added, modified or deleted against the last hash seen of the
    path; nothing where it didn't change."""

    def step(key, batches, state):
        (last,) = state.get if state.exists else (None,)
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")
        for ts, now in zip(rows["ts"], rows["hash"]):
            now = None if pd.isna(now) else now
            change = "added" if last is None and now is not None else "deleted" if last is not None and now is None else "modified" if last != now else None
            if change:
                out.append((key[0], ts, change))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["path", "ts", "change"])

    return observed.groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, change string", "hash string", "append", getattr(GroupStateTimeout, timeout))


def start_refresh(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Applies each micro-batch of changes to an index; several queries may read
    one stream, and each is stopped on its own."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class FolderChanges(DataSource):
    """Source `folder_changes`: (path, ts, change) of a folder, by comparing its
    listings; option path, and exclude with names split by commas."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, ts timestamp, change string"

    def streamReader(self, schema):
        return FolderReader(self.options)


class _Rows(InputPartition):
    def __init__(self, rows: list) -> None:
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    """Offsets are the number of changes seen; the log of them is kept by the
    driver, so a restart begins with the folder's present state."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.exclude = [x for x in options.get("exclude", "").split(",") if x]
        self.known: dict[str, tuple] = {}
        self.log: list[tuple] = []
        self.base = 0

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        import datetime
        import os

        now, seen = datetime.datetime.now(), {}
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = [d for d in dirs if d not in self.exclude]
            for name in names:
                path = os.path.join(folder, name)
                try:
                    s = os.stat(path)
                except OSError:
                    continue
                seen[os.path.relpath(path, self.root)] = (s.st_size, s.st_mtime_ns)
        for path in sorted(seen.keys() | self.known.keys()):
            old, new = self.known.get(path), seen.get(path)
            if old != new:
                self.log.append((path, now, "added" if old is None else "deleted" if new is None else "modified"))
        self.known = seen
        return {"seen": self.base + len(self.log)}

    def partitions(self, start: dict, end: dict):
        return [_Rows(self.log[max(0, start["seen"] - self.base) : max(0, end["seen"] - self.base)])]

    def read(self, partition):
        yield from partition.rows

    def commit(self, end: dict) -> None:
        drop = end["seen"] - self.base
        if drop > 0:
            self.log, self.base = self.log[drop:], end["seen"]


def watch(spark: SparkSession, folder: str, exclude: list[str] = ()) -> DataFrame:
    """A stream of a folder's changes."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", folder).option("exclude", ",".join(exclude)).load()
