"""Reports over the results of one search.

Results have rank, term, type, file, line, score, usage_count and sample_usages;
where named, also context, related_terms and surrounding_lines. They are bounded
by the search's limit; windows over all of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markers, short_path

PRIORITY = {"class": 5, "interface": 4, "function": 3, "type": 2, "enum": 1}
COMMON_TERMS = "async await class const export extends false from function import interface null public return static string this true type undefined void".split()


def _priority(kind: Column, order: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in order.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def primary(results: DataFrame, order: dict[str, int] = PRIORITY) -> DataFrame:
    """The definition a search is most likely about: of the kinds in order the
    foremost, then by score; failing those the first result."""
    p = _priority(F.col("type"), order)
    return results.orderBy(F.desc(p), F.when(p > 0, -F.col("score")), "rank").limit(1)


def primary_by_usage(results: DataFrame) -> DataFrame:
    """The result with the greatest score times 1 + usage / 10."""
    return results.orderBy(F.desc(F.col("score") * (1 + F.col("usage_count") / 10)), "rank").limit(1)


def stats(results: DataFrame) -> DataFrame:
    """(results, files, avg_usage, max_usage, with_usage)."""
    return results.agg(
        F.count("*").alias("results"), F.countDistinct("file").alias("files"), F.coalesce(F.avg("usage_count"), F.lit(0.0)).alias("avg_usage"),
        F.coalesce(F.max("usage_count"), F.lit(0)).alias("max_usage"), F.count_if(F.col("usage_count") > 0).alias("with_usage"),
    )


def histogram(results: DataFrame) -> DataFrame:
    """(bucket, results): by score, in steps of a tenth; 1.0 belongs to the last."""
    low = F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("int") * 10
    return results.groupBy(F.format_string("%d-%d%%", low, low + 10).alias("bucket")).agg(F.count("*").alias("results"))


def relations(results: DataFrame, terms: int = 20) -> DataFrame:
    """(term, related): of the first terms, all related terms, sorted."""
    first = results.groupBy("term").agg(F.min("rank").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("related_terms")))).alias("related"))
    return first.orderBy("at", "term").limit(terms).select("term", F.filter("related", lambda x: x != F.col("term")).alias("related"))


def top_usage(results: DataFrame, files: int = 3, rows: int = 3) -> DataFrame:
    """(file, place, term, line, more): the files of most sample usages, the
    first rows of each, and how many more it has."""
    used = results.select("rank", "term", F.posexplode("sample_usages").alias("pos", "u")).select("rank", "pos", "term", F.col("u.file").alias("file"), F.col("u.line").alias("line"))
    n = Window.partitionBy("file").orderBy("rank", "pos")
    counted = used.groupBy("file").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("at"))
    top = counted.orderBy(F.desc("n"), "at").limit(files).drop("at")
    kept = used.withColumn("place", F.row_number().over(n)).where(F.col("place") <= rows)
    return kept.join(F.broadcast(top), "file").select("file", "place", "term", "line", F.greatest(F.lit(0), F.col("n") - rows).alias("more"))


def breaking(results: DataFrame, limit: int = 5) -> DataFrame:
    """(place, spot, term): where a change would be felt first: usages of the
    most used results, each short path and line once."""
    used = results.where("usage_count > 0").select("rank", "usage_count", "term", F.posexplode("sample_usages").alias("pos", "u"))
    spots = used.withColumn("spot", F.concat(short_path(F.col("u.file").cast("string")), F.lit(":"), F.col("u.line").cast("string")))
    order = [F.desc("usage_count"), "rank", "pos"]
    once = spots.withColumn("n", F.row_number().over(Window.partitionBy("spot").orderBy(*order))).where("n = 1")
    return once.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= limit).select("place", "spot", "term")


def patterns(results: DataFrame, terms: int = 5) -> DataFrame:
    """(related, results, per_file): most frequent related terms that are longer
    than 3 and not common, and their rounded number per file."""
    found = results.select("rank", "file", F.posexplode("related_terms").alias("pos", "related")).where(F.length("related") > 3).where(~F.lower("related").isin(*COMMON_TERMS))
    counted = found.groupBy("related").agg(F.count("*").alias("results"), F.min(F.struct("rank", "pos")).alias("at"))
    files = results.agg(F.countDistinct("file").alias("files"))
    return counted.crossJoin(F.broadcast(files)).orderBy(F.desc("results"), "at").limit(terms).select("related", "results", F.round(F.col("results") / F.col("files")).cast("int").alias("per_file"))


def traits(results: DataFrame) -> DataFrame:
    """One row: main language and its percent, whether most are asynchronous,
    errors thrown, results in tests, and the most used result beyond 5 uses."""
    language = results.groupBy("language").agg(F.count("*").alias("n"), F.min("rank").alias("at")).orderBy(F.desc("n"), "at").limit(1).select(F.col("language").alias("main_language"), F.col("n").alias("__n"))
    thrown = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("context", F.lit(r"throw new (\w*Error)"), F.lit(1))))))
    counts = results.agg(
        F.count("*").alias("__all"), (F.count_if(F.col("context").contains("async")) * 2 > F.count("*")).alias("mostly_async"), thrown.alias("errors"),
        F.count_if(in_test(F.col("file"))).alias("in_tests"), F.max(F.when(F.col("usage_count") > 5, F.struct("usage_count", (-F.col("rank")).alias("r"), "term")))["term"].alias("widely_used"),
    )
    return counts.join(language, how="left").select("main_language", F.round(F.col("__n") * 100 / F.col("__all")).cast("int").alias("percent"), "mostly_async", "errors", "in_tests", "widely_used")


def in_test(file: Column) -> Column:
    return file.contains(".test.") | file.contains(".spec.")


def ecosystem(results: DataFrame, limit: int = 5) -> DataFrame:
    """(related, place): the first related terms, in order of appearance."""
    seen = results.select("rank", F.posexplode("related_terms").alias("pos", "related")).groupBy("related").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("at"))).where(F.col("place") <= limit).select("related", "place")


def frequent_callee(results: DataFrame) -> DataFrame:
    """(callee, calls): the most called function in the contexts."""
    calls = results.select("rank", F.explode(F.regexp_extract_all("context", F.lit(r"(\w+)\("), F.lit(1))).alias("callee"))
    return calls.groupBy("callee").agg(F.count("*").alias("calls"), F.min("rank").alias("at")).orderBy(F.desc("calls"), "at", "callee").limit(1).select("callee", "calls")


def much_called(results: DataFrame, limit: int = 5) -> DataFrame:
    """(label): `term (n calls)` of functions and classes used more than 5 times."""
    return results.where((F.col("usage_count") > 5) & F.col("type").isin("function", "class")).orderBy("rank").limit(limit).select(F.format_string("%s (%d calls)", "term", "usage_count").alias("label"))


def file_roles(results: DataFrame) -> DataFrame:
    """(file, role): what a file is to the search; the first rule that holds."""
    f = results.groupBy("file").agg(F.collect_set("type").alias("t"), F.max("score").alias("s"), F.count("*").alias("n"), F.sum("usage_count").alias("u"))
    has = lambda kind: F.array_contains("t", kind)
    role = (
        F.when(in_test(F.col("file")), "tests").when(has("class") & (F.col("s") > 0.9), "core implementation").when(has("interface"), "type definitions")
        .when(F.col("n") > 5, "heavy usage").when(F.col("u") > 0, "shared code").when(has("function"), "helper functions").otherwise("related")
    )
    return f.select("file", role.alias("role"))


def signature(context: Column, kind: Column) -> Column:
    """The declaring part of a line, by type."""
    first = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract(context, p, 0), F.lit("")) for p in ps], F.trim(context))
    return (
        F.when(kind == "function", first(r"(?:async\s+)?(?:function|def|func|fn)\s+\w+\s*[(][^)]*[)](?:\s*(?:->|:)\s*[\w<>\[\], ]+)?", r"\w+\s*[:=]\s*(?:async\s*)?\([^)]*\)\s*=>"))
        .when(kind.isin("class", "interface"), first(r"(?:class|interface|struct|trait|protocol|enum|type)\s+\w+(?:[^{:]*)?"))
        .when(kind.isin("variable", "constant"), first(r"(?:const|let|var|static|final)\s+\w+(?:\s*:\s*[\w<>\[\]]+)?", r"\w+\s*(?::\s*\w+)?\s*="))
        .otherwise(F.trim(context))
    )


def exported(language: Column, term: Column, context: Column, kind: Column) -> Column:
    """Whether a definition is visible outside; null where a language has no
    rule for it."""
    return (
        F.when(language.isin("typescript", "javascript"), context.startswith("export ") | context.contains("module.exports"))
        .when(language == "python", ~term.startswith("_") & (kind != "variable"))
        .when(language == "go", term.rlike("^[A-Z]"))
        .when(language == "rust", context.startswith("pub "))
    )


def near_markers(results: DataFrame) -> DataFrame:
    """(rank, found): development markers on the lines around a result."""
    return results.select("rank", markers(F.array_join("surrounding_lines", "\n")).alias("found")).where("size(found) > 0")


_RELEVANT = [
    r"\b(?:function|def|func|fn)\b", r"\bclass\b", r"\binterface\b", r"\bstruct\b", r"\breturn\b", r"\bthrow\b|\braise\b", r"\bawait\b", r"\basync\b", r"\bif\b", r"\bfor\b|\bwhile\b",
    r"\btry\b|\bcatch\b|\bexcept\b", r"\bimport\b|\brequire\b", r"\bexport\b", r"\bnew\b", r"=>", r"\w+\(", r"\bconst\b|\blet\b|\bvar\b", r"@\w+", r"//|#", r"\bextends\b|\bimplements\b", r"\bself\b|\bthis\b", r"\bnull\b|\bNone\b|\bnil\b", r"\btest\b|\bassert\b",
]


def best_context(results: DataFrame, lines: int = 2) -> DataFrame:
    """(rank, context_lines): the most telling lines around each result, in
    their order. Each of 23 patterns counts 2; a line gains 3 less its distance
    from the middle, 1 if indented and 2 if it opens a block."""
    rows = results.select("rank", F.size("surrounding_lines").alias("n"), F.posexplode("surrounding_lines").alias("pos", "text")).where("trim(text) <> ''")
    away = F.abs(F.col("pos") - F.floor(F.col("n") / 2))
    score = sum((F.col("text").rlike(p).cast("int") * 2 for p in _RELEVANT), F.lit(0)) + F.greatest(F.lit(0), 3 - away) + F.col("text").rlike(r"^\s").cast("int") + F.col("text").rlike(r"\{\s*$").cast("int") * 2
    order = Window.partitionBy("rank").orderBy(F.desc("score"), "away", "pos")
    best = rows.withColumns({"score": score, "away": away}).withColumn("n", F.row_number().over(order)).where(F.col("n") <= lines)
    return best.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("context_lines"))


def guessed_return(results: DataFrame) -> DataFrame:
    """(returns): the first Promise<T>, or returned name, by rank."""
    value = F.coalesce(F.nullif(F.regexp_extract("context", r"Promise<([^>]+)>", 1), F.lit("")), F.nullif(F.regexp_extract("context", r"return\s+(?!new\b)(\w+)", 1), F.lit("")))
    return results.select("rank", value.alias("returns")).where("returns IS NOT NULL").orderBy("rank").limit(1).select("returns")


def compact(results: DataFrame) -> DataFrame:
    """(rank, row): one line of text per result."""
    uses = F.when(F.col("usage_count") > 0, F.format_string(" (%d)", "usage_count")).otherwise("")
    return results.select("rank", F.concat(F.col("term"), uses, F.lit(" → "), F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string"), F.coalesce(F.col("column"), F.lit(0)).cast("string") if "column" in results.columns else F.lit("0"))).alias("row"))


def as_json(results: DataFrame) -> DataFrame:
    """(rank, row): one JSON object per result, absent fields left out."""
    return results.select("rank", F.to_json(F.struct(*results.columns)).alias("row"))


def suggestions(query: str, results: DataFrame, limit: int = 3) -> list[str]:
    """What to look at next, by the shape of the results."""
    row = stats(results).first()
    if not row["results"]:
        half = query[: max(3, -(-len(query) // 2))]
        return [f"search {half}", f"search --regex {query}", "group list"][:limit]
    out = []
    top = primary(results).first()
    if top["usage_count"]:
        out.append(f"refs {top['term']}")
    if row["files"] > 5:
        out.append(f"search {query} --file {top['file']}")
    if row["results"] > 20:
        out.append(f"search {query} --type {top['type']}")
    return (out + [f"search {query} --exact"])[:limit]
