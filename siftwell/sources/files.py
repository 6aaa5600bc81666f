"""Files of a tree as relations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import EXCLUSIONS, excluded, glob_regex, merged
from ..functions.text import human_bytes
from ..operators.tree import content_hash, need_hashing

TRUNCATED = "\n... [truncated due to size limit]"
CONFIG_NAMES = (".siftrc.json", ".siftrc")


def load_config(folder: str, names: tuple[str, ...] = CONFIG_NAMES) -> dict:
    """The first configuration file that parses; {} without one."""
    for name in names:
        try:
            found = json.loads((Path(folder) / name).read_text())
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            return found
    return {}


def save_config(folder: str, config: dict, name: str = CONFIG_NAMES[0]) -> None:
    (Path(folder) / name).write_text(json.dumps(config, indent=2) + "\n")


def listing(spark: SparkSession, root: str, config: dict | None = None, exclusions: list[str] = (), pattern: str | None = None, legacy: bool = False) -> DataFrame:
    """(path, size, mtime, url): files below root that aren't excluded; path is
    relative to it. Contents aren't read."""
    config = config or {}
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = raw.option("pathGlobFilter", pattern) if pattern else raw
    rows = raw.load(base).select(F.col("path").alias("url"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    path = F.regexp_replace(F.col("url"), "^(?:file:/*)?/?" + _quoted(base.removeprefix("file:").strip("/")) + "/", "")
    rows = rows.select(path.alias("path"), "size", "mtime", "url")
    out = merged([] if config.get("replaceExclusions") else EXCLUSIONS, config.get("exclude"), list(exclusions))
    return rows.where(~excluded(F.col("path"), out, config.get("include") or [], legacy))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in ".^$*+?{}[]\\|()" else c for c in text)


def contents(spark: SparkSession, root: str, files: DataFrame | None = None, limit: int | None = None, **options) -> DataFrame:
    """(path, content, size, mtime, hash). files: only those of a listing, found
    by path, and no other is opened beyond its row. limit: longest content, cut
    there and marked."""
    wanted = files if files is not None else listing(spark, root, **options)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    rows = wanted.join(raw.select(F.col("path").alias("url"), "content"), "url")
    text = F.decode("content", "UTF-8")
    if limit:
        text = truncated(text, limit)
    return rows.select("path", text.alias("content"), "size", "mtime", content_hash(F.col("content")).alias("hash"))


def truncated(content: Column, limit: int) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.left(content, F.lit(limit)), F.lit(TRUNCATED))).otherwise(content)


def changed_contents(spark: SparkSession, root: str, known: DataFrame, **options) -> DataFrame:
    """Contents that differ from a hash table (path, size, mtime, hash): files
    whose size and time agree aren't read; of the others those with the same
    hash are left out."""
    stale = need_hashing(listing(spark, root, **options), known)
    return contents(spark, root, stale).join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def paths(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path): files below root that aren't excluded."""
    return listing(spark, root, **options).select("path")


def by_priority(files: DataFrame, pattern: str) -> DataFrame:
    """Files that match the pattern first, else by path."""
    return files.orderBy(F.when(matches(F.col("path"), pattern), 0).otherwise(1), "path")


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern)) if "*" in pattern else path.contains(pattern)


def numbered(files: DataFrame, slices: int = 64) -> DataFrame:
    """Files with current_file (1, 2, ..., by hash bucket, then path) and
    total_files. Ranks come from counts per bucket, so no partition holds all."""
    rows = files.withColumn("__b", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int"))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__c"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.sum("__c").alias("total_files"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("path"))
    return rows.withColumn("__n", inside).join(F.broadcast(before), "__b").crossJoin(F.broadcast(total)).withColumn("current_file", F.col("__before") + F.col("__n")).drop("__b", "__n", "__before")


def size_estimate(files: DataFrame) -> DataFrame:
    """(files, bytes, shown)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("shown", human_bytes(F.col("bytes")))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): every line, from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")
