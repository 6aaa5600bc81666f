"""Session files, activity logs and language-model event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SESSIONS


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, project_path, created_at, last_accessed_at, metadata) of
    session-*.json; files that don't parse are left out."""
    names = {"id": "id", "projectPath": "project_path", "createdAt": "created_at", "lastAccessedAt": "last_accessed_at", "metadata": "metadata"}
    raw = spark.read.option("pathGlobFilter", "session-*.json").text(folder, wholetext=True)
    parsed = raw.select(F.from_json("value", "id string, projectPath string, createdAt long, lastAccessedAt long, metadata map<string,string>", {"mode": "PERMISSIVE"}).alias("s")).where("s.id IS NOT NULL")
    rows = parsed.select(*[(F.to_json(f"s.{a}") if a == "metadata" else F.col(f"s.{a}")).alias(b) for a, b in names.items()])
    return rows.select(*(x.split()[0] for x in SESSIONS.split(", ")))


def tail(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """(pos, value): a log file's last lines, in order; blank ones don't count.
    Each partition gives its own last lines, so the file is never in one row."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    last = rows.orderBy(F.desc("block"), F.desc("n")).limit(lines)
    return last.select((F.row_number().over(Window.orderBy("block", "n")) - 1).alias("pos"), "value")


def events(raw: DataFrame) -> DataFrame:
    """(seq, type, subtype, session_id, result, cost, texts, tools) of an event
    stream (seq, raw), one JSON object a line; other lines are left out."""
    schema = "type string, subtype string, session_id string, result string, error string, total_cost_usd double, message struct<content: array<struct<type: string, text: string, name: string>>>"
    parsed = raw.where(F.trim("raw").startswith("{")).select("seq", F.from_json("raw", schema).alias("e")).where("e.type IS NOT NULL")
    of = lambda kind, field: F.transform(F.filter("e.message.content", lambda c: c["type"] == kind), lambda c: c[field])
    return parsed.select("seq", "e.type", "e.subtype", "e.session_id", "e.result", "e.error", F.col("e.total_cost_usd").alias("cost"), of("text", "text").alias("texts"), of("tool_use", "name").alias("tools"))
