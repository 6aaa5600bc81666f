"""Reports over a whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dir_name


def stats(definitions: DataFrame) -> DataFrame:
    return definitions.agg(F.count("*").alias("total_entries"), F.countDistinct("file").alias("total_files"))


def distribution(definitions: DataFrame, by: str = "type", width: int = 20) -> DataFrame:
    """(by, entries, share, bar): counts, percent of all, and bar length in
    proportion to the greatest count."""
    counted = definitions.groupBy(by).agg(F.count("*").alias("entries"))
    # One row per group: a total by cross join needs no single-partition window.
    whole = counted.agg(F.sum("entries").alias("__all"), F.max("entries").alias("__most"))
    return counted.crossJoin(F.broadcast(whole)).select(by, "entries", (F.col("entries") * 100 / F.col("__all")).alias("share"), F.floor(F.col("entries") * width / F.col("__most")).cast("int").alias("bar"))


def file_complexity(definitions: DataFrame, limit: int = 10) -> DataFrame:
    """(file, types, entries): files of most distinct types."""
    return definitions.groupBy("file").agg(F.countDistinct("type").alias("types"), F.count("*").alias("entries")).orderBy(F.desc("types"), F.desc("entries"), "file").limit(limit)


def directories(definitions: DataFrame, limit: int = 5) -> DataFrame:
    """(dir, files): directories of most files."""
    return definitions.groupBy(dir_name(F.col("file")).alias("dir")).agg(F.countDistinct("file").alias("files")).orderBy(F.desc("files"), "dir").limit(limit)


def architecture(definitions: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(object_oriented, functional, strongly_typed): what the mix of types
    suggests. names: another type's name for class, function, interface, type."""
    n = {k: (names or {}).get(k, k) for k in ("class", "function", "interface", "type")}
    counts = definitions.agg(*[F.count_if(F.col("type") == v).alias(k) for k, v in n.items()])
    c = F.col
    return counts.select(
        (c("class") > 0.3 * c("function")).alias("object_oriented"),
        (c("function") > 2 * c("class")).alias("functional"),
        (c("interface") + c("type") > 0.5 * (c("class") + c("function"))).alias("strongly_typed"),
    )


def hotspots(definitions: DataFrame, refs: DataFrame, per_type: int = 5) -> DataFrame:
    """(type, term, usage_count, place): most used terms of each type."""
    used = refs.groupBy("target_term").agg(F.count("*").alias("usage_count"))
    terms = definitions.select("type", "term").distinct()
    order = Window.partitionBy("type").orderBy(F.desc("usage_count"), "term")
    return terms.join(used, F.col("term") == F.col("target_term")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_type).select("type", "term", "usage_count", "place")


def entry_points(definitions: DataFrame, limit: int = 5) -> DataFrame:
    """(file, entries): files whose name suggests that a program starts there."""
    base = F.lower(F.substring_index("file", "/", -1))
    return definitions.where(base.rlike("main|index|app|server|cli")).groupBy("file").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "file").limit(limit)
