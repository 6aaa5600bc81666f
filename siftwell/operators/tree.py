"""File trees, content hashes, their differences, and refresh of an index."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """Equal for equal content; 64 bits in hex."""
    return F.lower(F.hex(F.xxhash64(content)))


def file_nodes(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth, type, hash, size): a row for each file and
    for each directory above one, the root (an empty path) included.

    A directory's hash is that of its children's hashes, sorted and joined. It
    is made from the deepest level up; a level's directories come from one
    aggregation, and the levels are few whatever the number of files.
    """
    parent = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    leaves = files.select("path", parent.alias("parent"), F.substring_index("path", "/", -1).alias("name"), (F.length("path") - F.length(F.translate("path", "/", "")) + 1).alias("depth"), F.lit("file").alias("type"), "hash", "size")
    deepest = leaves.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    nodes, below = leaves, leaves.where(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):
        up = F.when(F.col("parent").contains("/"), F.regexp_extract("parent", "^(.*)/[^/]*$", 1)).otherwise("")
        dirs = below.groupBy("parent").agg(content_hash(F.array_join(F.array_sort(F.collect_list("hash")), "|")).alias("hash"), F.sum("size").alias("size"))
        dirs = dirs.select(F.col("parent").alias("path"), up.alias("parent"), F.substring_index("parent", "/", -1).alias("name"), F.lit(depth).alias("depth"), F.lit("directory").alias("type"), "hash", "size")
        nodes = nodes.unionByName(dirs)
        below = dirs.unionByName(leaves.where(F.col("depth") == depth))
    return nodes


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted, from two tables with path and
    hash."""
    a, b = old.select("path", F.col("hash").alias("old")), new.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def need_hashing(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Of listed files (path, size, mtime) those whose size or time of change
    isn't the known one; only their content has to be read."""
    return listed.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, hash, ...) that are new or have another hash."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def remove_files(rows: DataFrame, paths: DataFrame, column: str = "file") -> DataFrame:
    """rows without those of the paths (path)."""
    return rows.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame | None = None, column: str = "file") -> DataFrame:
    """old with the rows of every file in new replaced, and without gone files."""
    paths = new.select(F.col(column).alias("path")).distinct()
    if gone is not None:
        paths = paths.unionByName(gone.select("path"))
    return remove_files(old, paths, column).unionByName(new)


def was_updated(before: dict, after: dict) -> bool:
    """Whether two stats() rows differ."""
    return any(before.get(k) != after.get(k) for k in ("total_entries", "total_files"))


def integrity(indexed: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, state): files that only the index or only the hash table knows."""
    a, b = indexed.select("path").distinct().withColumn("i", F.lit(True)), tracked.select("path").distinct().withColumn("t", F.lit(True))
    state = F.when(F.col("i").isNull(), "not indexed").when(F.col("t").isNull(), "not tracked")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state IS NOT NULL")


class SingleFlight:
    """Of calls that overlap one runs; the others wait for its result."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.running: threading.Event | None = None
        self.result = self.error = None

    def __call__(self, work):
        with self.lock:
            mine = self.running is None
            if mine:
                self.running, self.error = threading.Event(), None
            done = self.running
        if mine:
            try:
                self.result = work()
            except BaseException as e:
                self.error = e
                raise
            finally:
                with self.lock:
                    self.running = None
                done.set()
            return self.result
        done.wait()
        if self.error is not None:
            raise self.error
        return self.result
