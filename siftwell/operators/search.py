"""Ranked, exact, boolean, regex and group search over postings."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.groups import BOUNDARY_PREFIXES, variations


@dataclass(frozen=True)
class Options:
    """types: of these types. files: of a path that holds, or as a glob
    matches, any of these. limit: most results. exact: by whole key only."""

    types: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    limit: int = 100
    exact: bool = False


#: Identity of a result; of several postings of one the first counts.
IDENTITY = ("file", "line", "term")


def selected(options: Options) -> Column:
    """The filter on type and file; it belongs below the choice of the first
    posting, since type isn't part of a result's identity."""
    out = F.col("type").isin(*options.types) if options.types else F.lit(True)
    if options.files:
        out = out & reduce(lambda a, b: a | b, [F.col("file").contains(f) | (F.col("file").rlike(_glob(f)) if "*" in f or "?" in f else F.lit(False)) for f in options.files])
    return out


def _glob(pattern: str) -> str:
    return glob_regex(pattern).lstrip("^").replace("[^/]*", ".*")


def at_boundary(key: Column, query: str) -> Column:
    """Whether a part of key between _ or -, or between . or /, starts with the
    query, or key starts with a verb such as get and then the query."""
    starts = lambda pattern: F.exists(F.split(key, pattern), lambda p: p.startswith(query))
    return starts("[_-]") | starts("[./]") | reduce(lambda a, b: a | b, [key.startswith(p + query) for p in BOUNDARY_PREFIXES])


def _candidates(index: DataFrame, query: str, options: Options) -> DataFrame:
    """Postings that match, with strat, variant and score."""
    key, q = F.col("key"), query.lower()
    rows = index.where(selected(options))
    if not q:
        return rows.withColumns({"strat": F.lit(0), "variant": F.lit(0), "score": F.lit(0.5)})
    if options.exact:
        return rows.where(key == q).withColumns({"strat": F.lit(0), "variant": F.lit(0), "score": F.lit(1.0)})
    hit = lambda strat, score: F.struct(F.lit(strat).alias("s"), score.alias("v"))
    kind = (
        F.when(key == q, hit(1, F.lit(1.0)))
        .when(key.startswith(q), hit(3, F.lit(0.85)))
        .when(key.endswith(q), hit(3, F.lit(0.80)))
        .when(at_boundary(key, q), hit(3, F.lit(0.75)))
        .when(key.contains(q), hit(4, F.lit(0.6) * F.lit(float(len(q))) / F.length(key)))
    )
    out = rows.withColumn("__k", kind).where("__k IS NOT NULL").withColumns({"strat": F.col("__k.s"), "variant": F.lit(0), "score": F.col("__k.v")}).drop("__k")
    words = variations(q)
    if words:
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: F.contains(key, x["w"]))
        more = rows.withColumn("__v", hits).where("size(__v) > 0")
        more = more.withColumns({"strat": F.lit(5), "variant": F.col("__v")[0]["i"], "score": F.lit(0.5)}).drop("__v")
        out = out.unionByName(more)
    return out


_APPENDED = ("strat", "variant", "key_entry", "key_part", "entry_seq", "part")


def ranked(index: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """The search's results with score and rank (1, 2, ...).

    Postings are appended by strategy: equal key 1.0; prefix 0.85, suffix 0.80,
    word boundary 0.75; substring 0.6 by its share of the key; words that the
    query abbreviates 0.5. Of each (file, line, term) the first appended counts.
    Results are by score, then as appended.
    """
    first = Window.partitionBy(*IDENTITY).orderBy(*_APPENDED)
    found = _candidates(index, query, options).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    order = [F.desc("score"), *_APPENDED]
    top = found.orderBy(*order).limit(options.limit or 100)
    # Of limit rows only, so one partition is enough for their ranks.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("strat", "variant", "key_entry", "key_part", "part", "key")


def usage(refs: DataFrame, sample: int = 3) -> DataFrame:
    """(target_term, usage_count, sample_usages): references to each term and
    the first few in order."""
    row = F.struct("ref_seq", "file", "line", "reference_type")
    first = refs.groupBy("target_term").agg(F.count("*").alias("usage_count"), F.min_by(row, "ref_seq").alias("__one")) if sample == 1 else None
    if first is not None:
        return first.select("target_term", "usage_count", F.array("__one").alias("sample_usages"))
    n = Window.partitionBy("target_term").orderBy("ref_seq")
    kept = refs.withColumn("__n", F.row_number().over(n)).where(F.col("__n") <= sample)
    samples = kept.groupBy("target_term").agg(F.array_sort(F.collect_list(row)).alias("sample_usages"))
    return refs.groupBy("target_term").agg(F.count("*").alias("usage_count")).join(samples, "target_term")


def with_usage(results: DataFrame, refs: DataFrame, sample: int = 3) -> DataFrame:
    """Results with usage_count and up to `sample` sample_usages. Only the
    references to the results' terms are aggregated; a result is bounded by the
    search's limit, so its terms are broadcast."""
    terms = results.select(F.col("term").alias("target_term")).distinct()
    counted = usage(refs.join(F.broadcast(terms), "target_term", "left_semi"), sample)
    joined = results.join(counted, F.col("term") == F.col("target_term"), "left").drop("target_term")
    return joined.withColumns({"usage_count": F.coalesce("usage_count", F.lit(0)), "sample_usages": F.coalesce("sample_usages", F.array().cast(counted.schema["sample_usages"].dataType))})


def search(index: DataFrame, refs: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    return with_usage(ranked(index, query, options), refs)


def any_of(index: DataFrame, terms: list[str], options: Options = Options()) -> DataFrame:
    """Union of each term's results, in the order of the terms, then ranks."""
    parts = [ranked(index, t, options).withColumn("__t", F.lit(i)) for i, t in enumerate(terms)]
    if not parts:
        return ranked(index, "", options).limit(0)
    first = Window.partitionBy(*IDENTITY).orderBy("__t", "rank")
    kept = reduce(DataFrame.unionByName, parts).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("__t", "rank"))).drop("__n", "__t")


def all_of(index: DataFrame, terms: list[str], options: Options = Options()) -> DataFrame:
    """The first term's results on lines where each other term has one too."""
    out = ranked(index, terms[0], options)
    for t in terms[1:]:
        out = out.join(ranked(index, t, options).select("file", "line"), ["file", "line"], "left_semi")
    return out


def none_of(index: DataFrame, term: str, options: Options = Options(), scan: int | None = None) -> DataFrame:
    """Everything but the term's results. scan: only the first so many of
    everything, as the legacy search does."""
    out = ranked(index, term, replace(options, exact=False))
    return everything(index, options, scan).join(out, list(IDENTITY), "left_anti")


def everything(index: DataFrame, options: Options = Options(), scan: int | None = None) -> DataFrame:
    """Each definition once, in order of keys; without scan nothing is cut and
    rank is null, as no global order is made."""
    if scan:
        return ranked(index, "", replace(options, limit=scan, exact=False))
    first = Window.partitionBy(*IDENTITY).orderBy(*_APPENDED[2:])
    kept = index.where(selected(options)).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.withColumns({"score": F.lit(0.5), "rank": F.lit(None).cast("int")}).drop("__n", "key_entry", "key_part", "part", "key")


def matching(index: DataFrame, pattern: str, options: Options = Options(), scan: int | None = None) -> DataFrame:
    """Definitions whose term holds a match of a regular expression, with
    case; an invalid pattern finds nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return everything(index, options, scan).limit(0)
    return everything(index, options, scan).where(F.col("term").rlike(pattern))


def in_group(index: DataFrame, refs: DataFrame, terms: list[str], options: Options = Options(limit=50), sort: str = "relevance") -> DataFrame:
    """A concept group's results with usage, sorted and limited."""
    found = with_usage(any_of(index, terms, replace(options, limit=100)), refs)
    return in_order(found, sort).limit(options.limit)


def in_order(results: DataFrame, sort: str = "relevance") -> DataFrame:
    """By usage, name, file or relevance; ties by rank."""
    keys = {"usage": [F.desc("usage_count")], "name": [F.collate("term", "UNICODE")], "file": [F.collate("file", "UNICODE")]}.get(sort, [])
    return results.orderBy(*keys, "rank")
