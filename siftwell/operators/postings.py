"""The inverted index as a relation derived from definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def partial_keys(term: Column, camel: bool = False) -> Column:
    """Keys a term is also found by: its parts between _ and between -, longer
    than 2. camel: parts between a small and a capital letter too."""
    key = F.lower(term)
    parts = F.concat(F.split(key, "_"), F.split(key, "-"))
    if camel:
        parts = F.concat(parts, F.split(F.lower(F.regexp_replace(term, "([a-z])([A-Z])", "$1_$2")), "_"))
    return F.filter(F.array_distinct(parts), lambda p: (F.length(p) > 2) & (p != key))


def postings(definitions: DataFrame, camel: bool = False) -> DataFrame:
    """(key, part, key_entry, key_part, and the definition's columns).

    A definition is posted under its lower-case term (part 0) and under its
    partial keys (1, 2, ...). Of partial postings with the same key, term and
    line only the first stays, whatever their files; whole ones all stay. The
    order of postings is (entry_seq, part); key_entry and key_part are the place
    of the key's first posting, which orders the keys.
    """
    keys = F.concat(F.array(F.lower("term")), partial_keys(F.col("term"), camel))
    rows = definitions.select("*", F.posexplode(keys).alias("part", "key"))
    # A whole posting is alone in its window, so a frequent term makes no large
    # one; and as only first rows stay, others are dropped before the shuffle.
    alone = F.when(F.col("part") == 0, F.col("entry_seq"))
    first = Window.partitionBy("key", "term", "line", alone).orderBy("entry_seq", "part")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    # Likewise the key's first posting comes from an aggregation, not a window;
    # it is never one of those dropped, and an entry has a key once at most.
    place = rows.groupBy(F.col("key").alias("__key")).agg(F.min("entry_seq").alias("key_entry"), F.min_by("part", "entry_seq").alias("key_part"))
    return kept.join(place, F.col("key") == F.col("__key")).drop("__key")


def top_terms(index: DataFrame, limit: int = 100) -> DataFrame:
    """(key, postings): keys of most postings, the earlier key first on ties."""
    counted = index.groupBy("key").agg(F.count("*").alias("postings"), F.min(F.struct("entry_seq", "part")).alias("at"))
    return counted.orderBy(F.desc("postings"), "at").limit(limit).select("key", "postings")
