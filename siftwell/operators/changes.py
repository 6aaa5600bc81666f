"""What a change set touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import GENERIC_NAMES
from ..functions.text import dir_name
from .reports import in_test

SYMBOLS = ("function", "class", "interface")


def staged_wins(changes: DataFrame) -> DataFrame:
    """One row per path: the staged one, then the first."""
    order = Window.partitionBy("path").orderBy(F.desc("is_staged"), "seq")
    return changes.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def changed_symbols(changes: DataFrame, definitions: DataFrame, refs: DataFrame, types: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """(path, term, type, line, usage_count, place): symbols of changed files
    that are used somewhere, by usage within the path. Names that say nothing
    and those of 2 letters at most don't count; of a term's rows the first."""
    d = definitions.where(F.col("type").isin(*types) & (F.length("term") > 2) & ~F.lower("term").isin(*GENERIC_NAMES))
    touched = d.join(staged_wins(changes).select("path"), F.col("file") == F.col("path"), "left_semi")
    first = touched.groupBy(F.col("file").alias("path"), "term").agg(F.min_by(F.struct("type", "line"), "entry_seq").alias("d"))
    used = refs.groupBy("target_term").agg(F.count("*").alias("usage_count"))
    order = Window.partitionBy("path").orderBy(F.desc("usage_count"), "term")
    return first.join(used, F.col("term") == F.col("target_term")).select("path", "term", "d.type", "d.line", "usage_count").withColumn("place", F.row_number().over(order))


def total_impact(symbols: DataFrame, full: bool = True) -> DataFrame:
    """(path, impact): by changed path. full: the three most used symbols, and
    others used twice at least; else all."""
    counts = (F.col("place") <= 3) | (F.col("usage_count") >= 2) if full else F.lit(True)
    return symbols.groupBy("path").agg(F.sum(F.when(counts, F.col("usage_count")).otherwise(0)).alias("impact"))


def risk(impact: Column) -> Column:
    return F.when(impact == 0, "None").when(impact < 10, "Low").when(impact < 50, "Medium").otherwise("High")


def impacted_files(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, file, refs): other files that use one of a path's three most used
    symbols, if it is used twice at least."""
    top = symbols.where("place <= 3 AND usage_count >= 2").select("path", "term")
    rows = refs.join(top, F.col("target_term") == F.col("term")).where(F.col("file").cast("string") != F.col("path").cast("string"))
    return rows.groupBy("path", "file").agg(F.count("*").alias("refs"))


def by_directory(impacted: DataFrame, limit: int = 3) -> DataFrame:
    """(dir, files): directories of most impacted files."""
    return impacted.groupBy(dir_name(F.col("file").cast("string")).alias("dir")).agg(F.countDistinct("file").alias("files")).orderBy(F.desc("files"), "dir").limit(limit)


def tests_to_run(impacted: DataFrame, limit: int = 5) -> DataFrame:
    return impacted.where(in_test(F.col("file"))).select("file").distinct().orderBy("file").limit(limit)


def key_files(impacted: DataFrame, limit: int = 3) -> DataFrame:
    """(file, refs): impacted files that aren't tests, of most references."""
    return impacted.where(~in_test(F.col("file"))).groupBy("file").agg(F.sum("refs").alias("refs")).orderBy(F.desc("refs"), "file").limit(limit)


def high_impact(symbols: DataFrame, beyond: int = 5) -> DataFrame:
    return symbols.where(F.col("usage_count") > beyond)


def report(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: total impact with and without references from the changed file
    itself, impacted files, symbols of high impact, and the risk."""
    total = total_impact(symbols).agg(F.coalesce(F.sum("impact"), F.lit(0)).alias("total_impact"))
    outside = impacted_files(symbols, refs).agg(F.coalesce(F.sum("refs"), F.lit(0)).alias("external_refs"), F.countDistinct("file").alias("impacted_files"))
    high = high_impact(symbols).agg(F.count("*").alias("high_impact"))
    return total.crossJoin(outside).crossJoin(high).withColumn("risk", risk(F.col("total_impact")))
