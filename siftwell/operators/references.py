"""Reference lookup and impact of a term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impact(refs: DataFrame, term: str | None = None) -> DataFrame:
    """(target_term, reference_type, refs, files): references by type, for one
    term or for each."""
    rows = refs if term is None else refs.where(F.col("target_term") == term)
    return rows.groupBy("target_term", "reference_type").agg(F.count("*").alias("refs"), F.countDistinct("file").alias("files"))


def impact_summary(refs: DataFrame, term: str | None = None) -> DataFrame:
    """(target_term, total_refs, files): in all."""
    rows = refs if term is None else refs.where(F.col("target_term") == term)
    return rows.groupBy("target_term").agg(F.count("*").alias("total_refs"), F.countDistinct("file").alias("files"))


def grouped_by_file(refs: DataFrame, term: str) -> DataFrame:
    """(file, lines, types): a term's references by file, lines ascending; types
    such as `call: 2, import: 1`, the more frequent first, then by name."""
    rows = refs.where(F.col("target_term") == term)
    counts = rows.groupBy("file", "reference_type").agg(F.count("*").alias("n"))
    types = counts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reference_type"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["reference_type"], F.lit(": "), (-x["n"]).cast("string"))), ", ")
    lines = rows.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.join(types.select("file", text.alias("types")), "file")


def external(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """References to definitions from files other than the definition's."""
    d = definitions.select("term", F.col("file").alias("defined_in")).distinct()
    return refs.join(d, F.col("target_term") == F.col("term")).where("file <> defined_in").drop("term")
