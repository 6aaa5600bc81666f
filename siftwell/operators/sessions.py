"""Sessions, activities and model event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

DAY = 86_400_000
#: Seconds of silence after which a run counts as stuck, by the last tool.
TIMEOUTS = {"Task": 600, "Bash": 300, "WebFetch": 240}
DEFAULT_TIMEOUT = 120


def latest_per_project(sessions: DataFrame) -> DataFrame:
    order = Window.partitionBy("project_path").orderBy(F.desc("last_accessed_at"), "id")
    return sessions.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def expired(sessions: DataFrame, now: int, days: int = 30) -> DataFrame:
    return sessions.where(F.col("last_accessed_at") < now - days * DAY)


def touched(sessions: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """sessions, those of ids (id) accessed now; unknown ids are new sessions."""
    wanted = ids.select("id", F.lit(True).alias("__w")).distinct()
    rows = sessions.join(wanted, "id", "full_outer")
    now_ = F.lit(now).cast("long")
    return rows.withColumns({"created_at": F.coalesce("created_at", now_), "last_accessed_at": F.when(F.col("__w"), now_).otherwise(F.col("last_accessed_at"))}).select(*sessions.columns)


def history(entries: DataFrame, keep: int = 100) -> DataFrame:
    """The last entries of each session."""
    order = Window.partitionBy("session_id").orderBy(F.desc("timestamp"), "query")
    return entries.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def reduced(events: DataFrame) -> DataFrame:
    """One row of a model run: its session, last tool, cost and result, which is
    the last error, else result, else text, else a notice."""
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("seq")))
    text = F.try_element_at("texts", F.lit(-1))
    tool = F.try_element_at("tools", F.lit(-1))
    row = events.agg(last(F.col("session_id")).alias("session_id"), last(F.col("error")).alias("e"), last(F.col("result")).alias("r"), last(text).alias("t"), last(tool).alias("last_tool"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return row.select("session_id", "last_tool", "cost", F.coalesce("e", "r", "t", F.lit("No response")).alias("result"))


def activity_stats(activity: DataFrame) -> DataFrame:
    """(nodes, completed, failed, total_duration)."""
    spent = F.col("end_time") - F.col("start_time")
    return activity.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(spent), F.lit(0)).alias("total_duration"))


def lifecycle(updates: DataFrame) -> DataFrame:
    """(id, name, status, start_time, end_time, duration) of activities from
    their updates (id, name, status, time): the latest status, and how long from
    the first update to one that ends it."""
    ends = F.col("status").isin("completed", "failed")
    rows = updates.groupBy("id").agg(F.max_by("name", "time").alias("name"), F.max_by("status", "time").alias("status"), F.min("time").alias("start_time"), F.max(F.when(ends, F.col("time"))).alias("end_time"))
    return rows.withColumn("duration", F.col("end_time") - F.col("start_time"))


def tool_usage(activity: DataFrame) -> DataFrame:
    return activity.where("tool IS NOT NULL").groupBy("tool").agg(F.count("*").alias("uses"))


def activity_tree(activity: DataFrame) -> DataFrame:
    """(id, root, depth): every node below its root; nodes whose ancestors end
    at a missing one are left out, as are cycles.

    Each round joins nodes with their furthest known ancestors, which doubles
    the distance, so a tree of depth n takes log n joins of the whole table and
    has none of a recursive query's limits. Rounds are written to the shared
    folder, so that plans stay short and no executor's loss costs them.
    """
    cur = activity.select("id", F.coalesce("parent_tool_use_id", "id").alias("up"), F.when(F.col("parent_tool_use_id").isNull(), 0).otherwise(1).alias("depth"))
    left = None
    while True:
        a, b = cur.alias("a"), cur.alias("b")
        nxt = a.join(b, F.col("a.up") == F.col("b.id")).select("a.id", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("b.depth") > 0).alias("more"))
        nxt = written(nxt, "tree")
        before, left = left, nxt.where("more").count()
        if not left or left == before:
            return nxt.where("NOT more").select("id", F.col("up").alias("root"), "depth")
        cur = nxt.drop("more")


def timeout_seconds(tool: Column) -> Column:
    out = F.lit(DEFAULT_TIMEOUT)
    for name, seconds in TIMEOUTS.items():
        out = F.when(tool == name, seconds).otherwise(out)
    return out


def silence_sessions(events: DataFrame, key: str, gap: Column | str) -> DataFrame:
    """(key, start, end, events): runs of events without a longer gap. gap: an
    interval, or a column of them by event."""
    window = F.session_window("ts", gap)
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
