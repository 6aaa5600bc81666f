"""The operators as queries over the star-schema tables, each with its SQL.

Tables play the engine's roles: part holds definitions, lineitem references to
them, documents and pages files, events changes, conversations a chat log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import globs, groups, text
from .operators import changes, overview, references, reports, search, sessions, tree
from .operators.postings import postings, top_terms
from .plans import grammar
from .sources import files as source_files
from .streaming import changes as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Roles


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def definitions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entry_seq"), F.translate("p_name", " ", "_").alias("term"), F.col("p_type").alias("type"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", "_").alias("target_term"))
    rows = table(spark, d, "lineitem").join(p, "l_partkey")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_seq"), "target_term", F.col("l_returnflag").alias("reference_type"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 40).cast("string")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("tie"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    change = F.when(kind == "signup", "added").when(kind == "error", "deleted").otherwise("modified")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), "ts", change.alias("change"))


DEFS = """defs AS (SELECT p_partkey AS entry_seq, replace(p_name, ' ', '_') AS term, p_type AS type, p_brand AS file, p_size AS line FROM part)"""
REFS = """refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_seq, replace(p_name, ' ', '_') AS target_term, l_returnflag AS reference_type,
  'Brand#' || (l_suppkey % 40) AS file, l_linenumber AS line, l_partkey AS tie FROM lineitem JOIN part ON p_partkey = l_partkey)"""
POSTINGS = (
    DEFS
    + """,
    cut AS (SELECT *, list_concat(string_split(lower(term), '_'), string_split(lower(term), '-')) AS l FROM defs),
    named AS (SELECT entry_seq, term, type, file, line, unnest(l) AS key, unnest(range(len(l))) AS i FROM cut),
    once AS (SELECT entry_seq, term, type, file, line, key, min(i) AS i FROM named WHERE length(key) > 2 AND key <> lower(term) GROUP BY ALL),
    parts AS (SELECT entry_seq, term, type, file, line, key, row_number() OVER (PARTITION BY entry_seq ORDER BY i) AS part FROM once),
    firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY key, term, line ORDER BY entry_seq, part) = 1),
    posted AS (SELECT entry_seq, term, type, file, line, lower(term) AS key, 0 AS part FROM defs UNION ALL SELECT entry_seq, term, type, file, line, key, part FROM firsts),
    index AS (SELECT *, min(entry_seq * 100 + part) OVER (PARTITION BY key) AS k FROM posted)"""
)


def _ranked_sql(q: str, limit: int = 100, where: str = "true", exact: bool = False, name: str = "ranked") -> str:
    """CTEs that end in one of that name: the ranked results of a query."""
    q = q.lower()
    prefixes = " OR ".join(f"starts_with(key, '{p}{q}')" for p in groups.BOUNDARY_PREFIXES)
    boundary = f"len(list_filter(string_split_regex(key, '[_-]'), lambda p: starts_with(p, '{q}'))) > 0 OR len(list_filter(string_split_regex(key, '[./]'), lambda p: starts_with(p, '{q}'))) > 0 OR {prefixes}"
    if not q:
        found = f"SELECT *, 0 AS strat, 0 AS variant, 0.5::DOUBLE AS score FROM index WHERE {where}"
    elif exact:
        found = f"SELECT *, 0 AS strat, 0 AS variant, 1.0::DOUBLE AS score FROM index WHERE ({where}) AND key = '{q}'"
    else:
        found = f"""SELECT *, CASE WHEN score = 1 THEN 1 WHEN score >= 0.75 THEN 3 ELSE 4 END AS strat, 0 AS variant FROM (
            SELECT *, CASE WHEN key = '{q}' THEN 1.0::DOUBLE WHEN starts_with(key, '{q}') THEN 0.85 WHEN ends_with(key, '{q}') THEN 0.8 WHEN {boundary} THEN 0.75
              WHEN contains(key, '{q}') THEN 0.6::DOUBLE * {len(q)} / length(key) END AS score FROM index WHERE {where}) WHERE score IS NOT NULL"""
        for i, w in enumerate(groups.variations(q)):
            found += f" UNION ALL BY NAME SELECT *, 5 AS strat, {i} AS variant, 0.5::DOUBLE AS score FROM index WHERE ({where}) AND contains(key, '{w}')"
    return f"""{name}_found AS ({found}),
    {name}_once AS (SELECT * FROM {name}_found QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY strat, variant, k, entry_seq, part) = 1),
    {name} AS (SELECT entry_seq, term, type, file, line, score, row_number() OVER (ORDER BY score DESC, strat, variant, k, entry_seq, part) AS rank
      FROM {name}_once ORDER BY rank LIMIT {limit})"""


USAGE = "usage AS (SELECT target_term, count(*) AS usage_count FROM refs GROUP BY 1)"
_SHOW = ("rank", "term", "type", "file", "line", "score")


def _show(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_SHOW, *more).withColumn("score", F.round("score", 6))


def _shown_sql(q: str, limit: int = 100, **kw) -> str:
    return f"WITH {POSTINGS}, {_ranked_sql(q, limit, **kw)} SELECT rank, term, type, file, line, round(score, 6) AS score FROM ranked"


# Index and search


@query(f"WITH {POSTINGS} SELECT entry_seq, term, type, file, line, key, part, k // 100 AS key_entry, k % 100 AS key_part FROM index")
def q_postings(spark, d):
    return postings(definitions(spark, d))


@query(f"""WITH {POSTINGS}, {REFS}, {_ranked_sql("widg")}, {USAGE},
    samples AS (SELECT target_term, array_to_string(list(ref_seq ORDER BY ref_seq), ',') AS samples FROM (
      SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY target_term ORDER BY ref_seq, tie) <= 3) GROUP BY 1)
    SELECT rank, term, type, file, line, round(score, 6) AS score, coalesce(usage_count, 0) AS usage_count, coalesce(samples, '') AS samples
    FROM ranked LEFT JOIN usage ON term = usage.target_term LEFT JOIN samples ON term = samples.target_term""")  # fmt: skip
def q_search_fuzzy(spark, d):
    found = search.search(postings(definitions(spark, d)), refs(spark, d), "widg")
    samples = F.array_join(F.transform("sample_usages", lambda x: x["ref_seq"].cast("string")), ",")
    return _show(found.withColumn("samples", samples), "usage_count", "samples")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q_search_fuzzy(spark, d)


@query(_shown_sql("blue", exact=True))
def q_search_exact(spark, d):
    return _show(search.ranked(postings(definitions(spark, d)), "blue", search.Options(exact=True)))


@query(_shown_sql("", limit=200, where="type IN ('SMALL', 'LARGE') AND contains(file, 'Brand#1')"))
def q_search_all_filtered(spark, d):
    return _show(search.ranked(postings(definitions(spark, d)), "", search.Options(("SMALL", "LARGE"), ("Brand#1",), 200)))


@query(_shown_sql("ol", limit=150))
def q_search_substring(spark, d):
    return _show(search.ranked(postings(definitions(spark, d)), "ol", search.Options(limit=150)))


_PREFIXED = """SELECT DISTINCT term, t FROM (SELECT replace(p_name, ' ', '_') AS term FROM part), LATERAL (SELECT unnest(['get' || term, 'x.' || term, term || '/a', 'super' || term]) AS t)"""


@query(f"""SELECT t AS term, len(list_filter(string_split_regex(t, '[_-]'), lambda p: starts_with(p, 'blue'))) > 0 OR len(list_filter(string_split_regex(t, '[./]'), lambda p: starts_with(p, 'blue'))) > 0
    OR {" OR ".join(f"starts_with(t, '{p}blue')" for p in groups.BOUNDARY_PREFIXES)} AS hit FROM ({_PREFIXED})""")  # fmt: skip
def q_boundary(spark, d):
    term = F.col("term")
    made = F.array(F.concat(F.lit("get"), term), F.concat(F.lit("x."), term), F.concat(term, F.lit("/a")), F.concat(F.lit("super"), term))
    rows = definitions(spark, d).select("term").distinct().select(F.explode(made).alias("term")).distinct()
    return rows.select("term", search.at_boundary(F.col("term"), "blue").alias("hit"))


@query(" UNION ALL ".join(f"SELECT '{q}' AS query, {i} AS place, '{w}' AS word" for q in ("auth", "con", "res", "util") for i, w in enumerate(groups.variations(q))))
def q_variations(spark, d):
    rows = [(q, i, w) for q in ("auth", "con", "res", "util") for i, w in enumerate(groups.variations(q))]
    return spark.createDataFrame(rows, "query string, place int, word string")


@query(f"""WITH {POSTINGS}, {_ranked_sql("anvil", name="a")}, {_ranked_sql("red", name="b")},
    both_ AS (SELECT *, 0 AS t FROM a UNION ALL SELECT *, 1 AS t FROM b),
    kept AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY t, rank) = 1)
    SELECT term, type, file, line, round(score, 6) AS score, row_number() OVER (ORDER BY t, rank) AS rank FROM kept""")  # fmt: skip
def q_search_or(spark, d):
    return _show(search.any_of(postings(definitions(spark, d)), ["anvil", "red"]))


@query(f"""WITH {POSTINGS}, {_ranked_sql("blue", 500, name="a")}, {_ranked_sql("ring", 500, name="b")}
    SELECT rank, term, type, file, line, round(score, 6) AS score FROM a WHERE (file, line) IN (SELECT (file, line) FROM b)""")  # fmt: skip
def q_search_and(spark, d):
    return _show(search.all_of(postings(definitions(spark, d)), ["blue", "ring"], search.Options(limit=500)))


@query(f"""WITH {POSTINGS}, {_ranked_sql("blue", 100, name="b")},
    once_ AS (SELECT * FROM index QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY k, entry_seq, part) = 1)
    SELECT term, type, file, line FROM once_ WHERE (file, line, term) NOT IN (SELECT (file, line, term) FROM b)""")  # fmt: skip
def q_search_not(spark, d):
    return search.none_of(postings(definitions(spark, d)), "blue").select("term", "type", "file", "line")


@query(f"""WITH {POSTINGS},
    once_ AS (SELECT * FROM index QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY k, entry_seq, part) = 1)
    SELECT term, type, file, line FROM once_ WHERE regexp_matches(term, '^(hot|cold)_r(od|ing)$')""")  # fmt: skip
def q_search_regex(spark, d):
    found = grammar.evaluate(grammar.parse("/^(hot|cold)_r(od|ing)$/"), postings(definitions(spark, d)))
    return found.select("term", "type", "file", "line")


@query(f"""WITH {POSTINGS}, {REFS}, {USAGE}, {_ranked_sql("widget", name="a")}, {_ranked_sql("gear", name="b")}, {_ranked_sql("bolt", name="c")},
    all_ AS (SELECT *, 0 AS t FROM a UNION ALL SELECT *, 1 AS t FROM b UNION ALL SELECT *, 2 AS t FROM c),
    kept AS (SELECT * FROM all_ QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY t, rank) = 1),
    placed AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY t, rank) AS rank FROM kept)
    SELECT rank, term, type, file, line, round(score, 6) AS score, coalesce(usage_count, 0) AS usage_count
    FROM placed LEFT JOIN usage ON term = target_term ORDER BY usage_count DESC, rank LIMIT 50""")  # fmt: skip
def q_group_search(spark, d):
    config = {"customGroups": {"hardware": ["widget", "gear", "bolt"]}}
    found = search.in_group(postings(definitions(spark, d)), refs(spark, d), groups.group_terms("hardware", config), sort="usage")
    return _show(found, "usage_count")


@query(f"""WITH {POSTINGS}, {_ranked_sql("small", 200, name="a")}, {_ranked_sql("rod", 200, name="b")},
    t AS (SELECT a.* FROM a WHERE (file, line) IN (SELECT (file, line) FROM b)) SELECT rank, term, type, file, line, round(score, 6) AS score FROM t""")  # fmt: skip
def q_query_words(spark, d):
    return _show(grammar.evaluate(grammar.parse("small rod"), postings(definitions(spark, d))))


@query(f"""WITH {POSTINGS}, {_ranked_sql("zz", name="a")}, {_ranked_sql("widget", name="b")},
    all_ AS (SELECT *, 0 AS t FROM a UNION ALL SELECT *, 1 AS t FROM b),
    kept AS (SELECT * FROM all_ QUALIFY row_number() OVER (PARTITION BY file, line, term ORDER BY t, rank) = 1)
    SELECT term, type, file, line, round(score, 6) AS score, row_number() OVER (ORDER BY t, rank) AS rank FROM kept""")  # fmt: skip
def q_fallback_split(spark, d):
    return _show(grammar.run("zz_widget", postings(definitions(spark, d)), refs(spark, d), search.Options()))


@query("""SELECT term, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(
      regexp_replace(regexp_replace(term, '([a-z])([A-Z])', '\\1|\\2', 'g'), '[_-]', '|', 'g'), '\\|'), lambda p: lower(trim(p))), lambda p: length(p) > 1))), ',') AS parts
    FROM (SELECT DISTINCT replace(p_name, ' ', '_') || p_type AS term FROM part)""")
def q_smart_split(spark, d):
    rows = definitions(spark, d).select(F.concat("term", "type").alias("term")).distinct()
    return rows.select("term", F.array_join(F.array_sort(grammar.smart_split_column(F.col("term"))), ",").alias("parts"))


def _sorted_sql(order: str) -> str:
    return f"""WITH {POSTINGS}, {REFS}, {USAGE}, {_ranked_sql("ring", 80)}
        SELECT row_number() OVER (ORDER BY {order}) AS place, term, type, file, line, usage_count FROM ranked JOIN usage ON term = target_term"""


def _sorted(spark, d, sort: str) -> DataFrame:
    found = search.with_usage(search.ranked(postings(definitions(spark, d)), "ring", search.Options(limit=80)), refs(spark, d))
    from pyspark.sql import Window

    key = {"usage": [F.desc("usage_count")], "name": [F.collate("term", "UNICODE")], "file": [F.collate("file", "UNICODE")]}[sort]
    placed = search.in_order(found, sort).withColumn("place", F.row_number().over(Window.orderBy(*key, "rank")))
    return placed.select("place", "term", "type", "file", "line", "usage_count")


@query(_sorted_sql("usage_count DESC, rank"))
def q_sort_usage(spark, d):
    return _sorted(spark, d, "usage")


@query(_sorted_sql("term, rank"))
def q_sort_name(spark, d):
    return _sorted(spark, d, "name")


@query(f"WITH {POSTINGS} SELECT key, count(*) AS postings FROM index GROUP BY key ORDER BY postings DESC, min(entry_seq * 100 + part) LIMIT 20")
def q_top_terms(spark, d):
    return top_terms(postings(definitions(spark, d)), 20)


_ORDER = {"PROMO": 5, "STANDARD": 4, "ECONOMY": 3}


@query(f"""WITH {POSTINGS}, {_ranked_sql("gear")}, p AS (SELECT *, CASE type WHEN 'PROMO' THEN 5 WHEN 'STANDARD' THEN 4 WHEN 'ECONOMY' THEN 3 ELSE 0 END AS pr FROM ranked)
    SELECT rank, term, type, file, line, round(score, 6) AS score FROM p ORDER BY pr DESC, CASE WHEN pr > 0 THEN -score END, rank LIMIT 1""")  # fmt: skip
def q_primary_definition(spark, d):
    return _show(reports.primary(search.ranked(postings(definitions(spark, d)), "gear"), _ORDER))


@query(f"""WITH {POSTINGS}, {REFS}, {USAGE}, {_ranked_sql("gear")} SELECT rank, term, type, file, line, round(score, 6) AS score, usage_count
    FROM ranked JOIN usage ON term = target_term ORDER BY ranked.score * (1 + usage_count / 10) DESC, rank LIMIT 1""")  # fmt: skip
def q_primary_by_usage(spark, d):
    return _show(reports.primary_by_usage(search.search(postings(definitions(spark, d)), refs(spark, d), "gear")), "usage_count")


# References and reports


@query(f"WITH {DEFS}, {REFS}, {USAGE} SELECT entry_seq, term, coalesce(usage_count, 0) AS usage_count FROM defs LEFT JOIN usage ON term = target_term")
def q_usage_join(spark, d):
    used = references.impact_summary(refs(spark, d)).select("target_term", F.col("total_refs").alias("usage_count"))
    return definitions(spark, d).join(used, F.col("term") == F.col("target_term"), "left").select("entry_seq", "term", F.coalesce("usage_count", F.lit(0)).alias("usage_count"))


@query(f"WITH {REFS} SELECT target_term, reference_type, count(*) AS refs, count(DISTINCT file) AS files FROM refs GROUP BY ALL")
def q_impact_by_type(spark, d):
    return references.impact(refs(spark, d))


@query(f"WITH {REFS} SELECT target_term, count(*) AS total_refs, count(DISTINCT file) AS files FROM refs GROUP BY ALL")
def q_impact_summary(spark, d):
    return references.impact_summary(refs(spark, d))


@query(f"""WITH {REFS}, r AS (SELECT * FROM refs WHERE target_term = 'red_ring'), c AS (SELECT file, reference_type, count(*) AS n FROM r GROUP BY ALL)
    SELECT file, (SELECT array_to_string(list(line ORDER BY line), ',') FROM r WHERE r.file = f.file) AS lines,
      (SELECT string_agg(reference_type || ': ' || n, ', ' ORDER BY n DESC, reference_type) FROM c WHERE c.file = f.file) AS types
    FROM (SELECT DISTINCT file FROM r) f""")  # fmt: skip
def q_refs_grouped(spark, d):
    return references.grouped_by_file(refs(spark, d), "red_ring").select("file", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "types")


@query(f"""WITH {DEFS}, {REFS} SELECT target_term, defined_in, count(*) AS n FROM refs JOIN (SELECT DISTINCT term, file AS defined_in FROM defs) ON term = target_term
    WHERE file <> defined_in GROUP BY ALL""")  # fmt: skip
def q_external_refs(spark, d):
    return references.external(refs(spark, d), definitions(spark, d)).groupBy("target_term", "defined_in").agg(F.count("*").alias("n"))


@query(f"WITH {DEFS} SELECT count(*) AS total_entries, count(DISTINCT file) AS total_files FROM defs")
def q_index_stats(spark, d):
    return overview.stats(definitions(spark, d))


@query(f"""WITH {DEFS}, c AS (SELECT type, count(*) AS entries FROM defs GROUP BY 1)
    SELECT type, entries, round(entries * 100.0 / sum(entries) OVER (), 6) AS share, floor(entries * 20 / max(entries) OVER ())::INTEGER AS bar FROM c""")  # fmt: skip
def q_type_distribution(spark, d):
    return overview.distribution(definitions(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {DEFS} SELECT file, count(DISTINCT type) AS types, count(*) AS entries FROM defs GROUP BY 1 ORDER BY types DESC, entries DESC, file LIMIT 10")
def q_file_complexity(spark, d):
    return overview.file_complexity(definitions(spark, d))


_DOCS = "docs AS (SELECT source || '/' || lang || '/' || doc_id AS path, text AS content, n_chars AS size FROM documents)"


@query(f"WITH {_DOCS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT path) AS files FROM docs GROUP BY 1 ORDER BY files DESC, dir LIMIT 5")
def q_dirs(spark, d):
    return overview.directories(documents(spark, d).select(F.col("path").alias("file")))


@query(f"""WITH {DEFS} SELECT c > 0.3 * f AS object_oriented, f > 2 * c AS functional, i + t > 0.5 * (c + f) AS strongly_typed FROM (
    SELECT count_if(type = 'SMALL') AS c, count_if(type = 'LARGE') AS f, count_if(type = 'PROMO') AS i, count_if(type = 'ECONOMY') AS t FROM defs)""")  # fmt: skip
def q_arch_flags(spark, d):
    return overview.architecture(definitions(spark, d), {"class": "SMALL", "function": "LARGE", "interface": "PROMO", "type": "ECONOMY"})


@query(f"""WITH {DEFS}, {REFS}, {USAGE} SELECT type, term, usage_count, row_number() OVER (PARTITION BY type ORDER BY usage_count DESC, term) AS place
    FROM (SELECT DISTINCT type, term FROM defs) JOIN usage ON term = target_term QUALIFY place <= 5""")  # fmt: skip
def q_hotspots(spark, d):
    return overview.hotspots(definitions(spark, d), refs(spark, d))


@query("SELECT * FROM (SELECT url AS file, count(*) AS entries FROM pages WHERE regexp_matches(lower(string_split(url, '/')[-1]), 'main|index|app|server|cli') GROUP BY 1) ORDER BY entries DESC, file LIMIT 5")
def q_entry_points(spark, d):
    return overview.entry_points(table(spark, d, "pages").select(F.col("url").alias("file")))


def _found(spark, d, q: str = "ring", limit: int = 100) -> DataFrame:
    return search.search(postings(definitions(spark, d)), refs(spark, d), q, search.Options(limit=limit))


def _found_sql(q: str = "ring", limit: int = 100) -> str:
    return f"WITH {POSTINGS}, {REFS}, {USAGE}, {_ranked_sql(q, limit)}, found AS (SELECT ranked.*, coalesce(usage_count, 0) AS usage_count FROM ranked LEFT JOIN usage ON term = target_term)"


@query(_found_sql() + " SELECT count(*) AS results, count(DISTINCT file) AS files, round(avg(usage_count), 6) AS avg_usage, max(usage_count) AS max_usage, count_if(usage_count > 0)::BIGINT AS with_usage FROM found")
def q_result_stats(spark, d):
    return reports.stats(_found(spark, d)).withColumn("avg_usage", F.round("avg_usage", 6))


@query(_found_sql("ol") + " SELECT b || '-' || (b + 10) || '%' AS bucket, count(*) AS results FROM (SELECT least(9, floor(score * 10))::INTEGER * 10 AS b FROM found) GROUP BY 1")
def q_relevance_hist(spark, d):
    return reports.histogram(_found(spark, d, "ol"))


@query(_found_sql() + """, r AS (SELECT term, min(rank) AS at_, string_agg(DISTINCT type, ',' ORDER BY type) AS related FROM found GROUP BY 1)
    SELECT term, related FROM r ORDER BY at_, term LIMIT 20""")
def q_graph(spark, d):
    found = _found(spark, d).withColumn("related_terms", F.array("type"))
    return reports.relations(found).select("term", F.array_join("related", ",").alias("related"))


_SAMPLES = """, s AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY target_term ORDER BY ref_seq, tie) <= 3),
    u AS (SELECT rank, term, found.usage_count, s.file, s.line, row_number() OVER (PARTITION BY rank ORDER BY ref_seq, s.file, s.line) AS pos FROM found JOIN s ON term = s.target_term)"""


@query(_found_sql(limit=40) + _SAMPLES + """, top AS (SELECT file, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, min(rank * 10 + pos) LIMIT 3)
    SELECT u.file, row_number() OVER (PARTITION BY u.file ORDER BY rank, pos) AS place, term, line, greatest(0, n - 3) AS more FROM u JOIN top ON u.file = top.file QUALIFY place <= 3""")
def q_top_usage(spark, d):
    return reports.top_usage(_found(spark, d, limit=40))


@query(_found_sql(limit=40) + _SAMPLES + """, o AS (SELECT *, file || ':' || line AS spot FROM u WHERE usage_count > 0),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY spot ORDER BY usage_count DESC, rank, pos) = 1)
    SELECT row_number() OVER (ORDER BY usage_count DESC, rank, pos) AS place, spot, term FROM f QUALIFY place <= 5""")
def q_breaking(spark, d):
    return reports.breaking(_found(spark, d, limit=40))


@query(_found_sql() + """, r AS (SELECT rank, unnest([term, file]) AS related, unnest([0, 1]) AS pos FROM found)
    SELECT related, count(*) AS results, round(count(*) / (SELECT count(DISTINCT file) FROM found))::INTEGER AS per_file FROM r WHERE length(related) > 3
    GROUP BY 1 ORDER BY results DESC, min(rank * 10 + pos) LIMIT 5""")
def q_patterns(spark, d):
    return reports.patterns(_found(spark, d).withColumn("related_terms", F.array("term", "file")))


@query(_found_sql() + """, r AS (SELECT rank, unnest([term, file]) AS related, unnest([0, 1]) AS pos FROM found), s AS (SELECT related, min(rank * 10 + pos) AS at_ FROM r GROUP BY 1)
    SELECT related, row_number() OVER (ORDER BY at_) AS place FROM s QUALIFY place <= 5""")
def q_ecosystem(spark, d):
    return reports.ecosystem(_found(spark, d).withColumn("related_terms", F.array("term", "file")))


@query(_found_sql() + " SELECT rank, term || CASE WHEN usage_count > 0 THEN ' (' || usage_count || ')' ELSE '' END || ' → ' || file || ':' || line || ':0' AS row FROM found")
def q_compact_rows(spark, d):
    return reports.compact(_found(spark, d))


_CODE = """code AS (SELECT DISTINCT replace(p_name, ' ', '_') AS term, unnest(['typescript', 'python', 'go', 'rust', 'json']) AS language, unnest(['function', 'function', 'variable', 'class', 'constant']) AS type,
    unnest(['export function ', 'def ', 'var ', 'pub struct ', '']) AS head, unnest(['(a, b) {', '(a, b) -> int:', ' = 1', ' {', ': 1']) AS tail FROM part)"""


def _code(spark, d) -> DataFrame:
    heads = [("typescript", "function", "export function ", "(a, b) {"), ("python", "function", "def ", "(a, b) -> int:"), ("go", "variable", "var ", " = 1"), ("rust", "class", "pub struct ", " {"), ("json", "constant", "", ": 1")]
    kinds = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("language", "type", "head", "tail"), h)]) for h in heads])
    rows = definitions(spark, d).select("term").distinct().select("term", F.explode(kinds).alias("k"))
    return rows.select("term", "k.language", "k.type", F.concat("k.head", "term", "k.tail").alias("context"))


@query(f"""WITH {_CODE} SELECT term, language, CASE language WHEN 'typescript' THEN 'function ' || term || '(a, b)' WHEN 'python' THEN 'def ' || term || '(a, b) -> int'
    WHEN 'go' THEN 'var ' || term WHEN 'rust' THEN 'struct ' || term || ' ' ELSE term || ': 1' END AS signature FROM code""")
def q_signature(spark, d):
    return _code(spark, d).select("term", "language", reports.signature(F.col("context"), F.col("type")).alias("signature"))


@query(f"""WITH {_CODE} SELECT term, language, CASE language WHEN 'typescript' THEN starts_with(head || term, 'export ') WHEN 'python' THEN NOT starts_with(term, '_') AND type <> 'variable'
    WHEN 'go' THEN regexp_matches(term, '^[A-Z]') WHEN 'rust' THEN starts_with(head, 'pub ') END AS exported FROM code""")
def q_exported(spark, d):
    return _code(spark, d).select("term", "language", reports.exported(F.col("language"), F.col("term"), F.col("context"), F.col("type")).alias("exported"))


_CONTEXT = """CASE WHEN rank % 4 = 0 THEN 'async function ' || term || '(): Promise<Row' || rank || '> {' WHEN rank % 4 = 1 THEN 'return total' || rank || '; throw new ' || type || 'Error()'
    WHEN rank % 4 = 2 THEN 'save(' || term || ')' ELSE 'save(load(' || term || '))' END"""


def _with_context(spark, d, q: str = "ring", limit: int = 100) -> DataFrame:
    """Results with a context line, a language and a path, by rank."""
    r, rank = F.col("rank") % 4, F.col("rank").cast("string")
    context = (
        F.when(r == 0, F.concat(F.lit("async function "), "term", F.lit("(): Promise<Row"), rank, F.lit("> {")))
        .when(r == 1, F.concat(F.lit("return total"), rank, F.lit("; throw new "), "type", F.lit("Error()")))
        .when(r == 2, F.concat(F.lit("save("), "term", F.lit(")")))
        .otherwise(F.concat(F.lit("save(load("), "term", F.lit("))")))
    )
    language = F.when(F.col("rank") % 3 == 0, "go").otherwise("python")
    path = F.concat(F.lower("file"), F.when(F.col("rank") % 5 == 0, ".test.ts").otherwise(".ts"))
    return _found(spark, d, q, limit).withColumns({"context": context, "language": language, "file": path})


def _context_sql(q: str = "ring", limit: int = 100) -> str:
    return _found_sql(q, limit) + f""", ctx AS (SELECT * REPLACE (lower(file) || CASE WHEN rank % 5 = 0 THEN '.test.ts' ELSE '.ts' END AS file), {_CONTEXT} AS context, CASE WHEN rank % 3 = 0 THEN 'go' ELSE 'python' END AS language FROM found)"""


@query(_context_sql() + """, l AS (SELECT language, count(*) AS n FROM ctx GROUP BY 1 ORDER BY n DESC, min(rank) LIMIT 1)
    SELECT (SELECT language FROM l) AS main_language, round((SELECT n FROM l) * 100.0 / count(*))::INTEGER AS percent, count_if(contains(context, 'async')) * 2 > count(*) AS mostly_async,
      (SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM (SELECT unnest(regexp_extract_all(context, 'throw new (\\w*Error)', 1)) AS e FROM ctx)) AS errors,
      count_if(contains(file, '.test.') OR contains(file, '.spec.'))::BIGINT AS in_tests, (SELECT term FROM ctx WHERE usage_count > 5 ORDER BY usage_count DESC, rank LIMIT 1) AS widely_used FROM ctx""")
def q_traits(spark, d):
    return reports.traits(_with_context(spark, d)).withColumn("errors", F.array_join("errors", ","))


@query(_context_sql() + """, c AS (SELECT rank, unnest(regexp_extract_all(context, '(\\w+)\\(', 1)) AS callee FROM ctx)
    SELECT callee, count(*) AS calls FROM c GROUP BY 1 ORDER BY calls DESC, min(rank), callee LIMIT 1""")
def q_frequent_callee(spark, d):
    return reports.frequent_callee(_with_context(spark, d))


@query(_context_sql() + """ SELECT CASE WHEN rank % 4 = 0 THEN 'Row' || rank ELSE 'total' || rank END AS returns FROM ctx WHERE rank % 4 IN (0, 1) ORDER BY rank LIMIT 1""")
def q_guessed_return(spark, d):
    return reports.guessed_return(_with_context(spark, d))


@query(_found_sql() + " SELECT term || ' (' || usage_count || ' calls)' AS label FROM (SELECT * FROM found WHERE usage_count > 5 AND type IN ('SMALL', 'PROMO') ORDER BY rank LIMIT 5)")
def q_much_called(spark, d):
    kind = F.when(F.col("type").isin("SMALL", "PROMO"), "function").otherwise("string")
    return reports.much_called(_found(spark, d).withColumn("type", kind))


@query(_context_sql() + """, f AS (SELECT file, list(DISTINCT type) AS t, max(score) AS s, count(*) AS n, sum(usage_count) AS u FROM ctx GROUP BY 1)
    SELECT file, CASE WHEN contains(file, '.test.') THEN 'tests' WHEN list_contains(t, 'SMALL') AND s > 0.9 THEN 'core implementation' WHEN list_contains(t, 'PROMO') THEN 'type definitions'
      WHEN n > 5 THEN 'heavy usage' WHEN u > 0 THEN 'shared code' ELSE 'related' END AS role FROM f""")
def q_file_roles(spark, d):
    kind = F.when(F.col("type") == "SMALL", "class").when(F.col("type") == "PROMO", "interface").otherwise("other")
    return reports.file_roles(_with_context(spark, d).withColumn("type", kind))


@query(_found_sql("ring", 30) + """ SELECT rank, CASE rank % 3 WHEN 0 THEN '  return ' || term || '(x) {|go to ' || type WHEN 1 THEN type || ' alone|class ' || term ELSE 'nothing here|' || term || ' too' END AS context_lines FROM found""")
def q_best_context(spark, d):
    """Of four lines around each result the two that tell most."""
    r, term, kind = F.col("rank") % 3, F.col("term"), F.col("type")
    lines = (
        F.when(r == 0, F.array(F.lit("zzz"), F.concat(F.lit("  return "), term, F.lit("(x) {")), F.concat(F.lit("go to "), kind), F.lit("")))
        .when(r == 1, F.array(F.lit(""), F.lit("yyy"), F.concat(kind, F.lit(" alone")), F.concat(F.lit("class "), term)))
        .otherwise(F.array(F.lit("x"), F.lit("nothing here"), F.concat(term, F.lit(" too")), F.lit("w")))
    )
    best = reports.best_context(_found(spark, d, "ring", 30).withColumn("surrounding_lines", lines))
    return best.select("rank", F.array_join("context_lines", "|").alias("context_lines"))


@query(_found_sql("ring", 30) + " SELECT rank, CASE rank % 3 WHEN 0 THEN 'TODO' ELSE 'FIXME,NOTE' END AS found FROM found WHERE rank % 3 < 2")
def q_near_markers(spark, d):
    r = F.col("rank") % 3
    lines = F.when(r == 0, F.array(F.lit("// todo: x"), F.lit("TODO"))).when(r == 1, F.array(F.lit("a FIXME"), F.lit("note b"))).otherwise(F.array(F.lit("plain")))
    return reports.near_markers(_found(spark, d, "ring", 30).withColumn("surrounding_lines", lines)).select("rank", F.array_join("found", ",").alias("found"))


@query(_found_sql("ring", 30) + """ SELECT rank, '{"term":"' || term || '","file":"' || file || '","line":' || line || ',"uses":' || usage_count || '}' AS row FROM found""")
def q_json_rows(spark, d):
    found = _found(spark, d, "ring", 30).select("term", "file", "line", F.col("usage_count").alias("uses"), F.lit(None).cast("string").alias("gone"), "rank")
    return reports.as_json(found).select("rank", F.regexp_replace("row", ',"rank":[0-9]+', "").alias("row"))


_CAMEL = """SELECT DISTINCT key FROM (SELECT unnest(list_concat([lower(t)], list_filter(list_concat(string_split(lower(t), '_'), string_split(lower(t), '-'), string_split(lower(regexp_replace(t, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_')), lambda p: length(p) > 2))) AS key
    FROM (SELECT split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS t FROM part))"""


@query(_CAMEL)
def q_postings_camel(spark, d):
    words = F.split("term", "_")
    camel = F.concat(words[0], F.upper(F.left(words[1], F.lit(1))), F.substring(words[1], 2, 100))
    return postings(definitions(spark, d).withColumn("term", camel), camel=True).select("key").distinct()


@query(f"""WITH {POSTINGS}, {_ranked_sql("", 1000, name="e")}, {_ranked_sql("blue", 100, name="b")} SELECT term, type, file, line FROM e WHERE (file, line, term) NOT IN (SELECT (file, line, term) FROM b)""")
def q_search_not_capped(spark, d):
    return search.none_of(postings(definitions(spark, d)), "blue", scan=1000).select("term", "type", "file", "line")


@query(f"""WITH {POSTINGS}, {_ranked_sql("blu", name="ranked", where="contains(file, 'Brand#1') OR regexp_matches(file, '.*#2.')")} SELECT rank, term, type, file, line, round(score, 6) AS score FROM ranked""")
def q_search_glob(spark, d):
    return _show(search.ranked(postings(definitions(spark, d)), "blu", search.Options(files=("Brand#1", "*#2?"))))


# Files


@query(f"""WITH {_DOCS} SELECT count(*) AS files, sum(size)::BIGINT AS bytes,
    CASE WHEN sum(size) < 1048576 THEN printf('%.1f KB', sum(size) / 1024.0) WHEN sum(size) < 1073741824 THEN printf('%.1f MB', sum(size) / 1048576.0) ELSE printf('%.1f GB', sum(size) / 1073741824.0) END AS shown FROM docs""")
def q_file_scan_stats(spark, d):
    return source_files.size_estimate(documents(spark, d))


_LEGACY = " OR ".join(f"regexp_matches(path, '{globs.glob_regex(p)}')" if "*" in p else f"contains(path, '{p}')" for p in globs.EXCLUSIONS)
_PATHS = "paths AS (SELECT DISTINCT unnest(['src/router' || p_size || '.ts', 'out/' || p_brand || '.js', 'src/layout.tsx', 'dist/a.js', 'a/node_modules/x.js', 'src/foo.test.ts', 'x.log', 'src/' || p_type || '.py', 'vendor/m.go', '.github/workflows/ci.yml', 'lib/b.so']) AS path FROM part)"


def _paths(spark, d) -> DataFrame:
    made = F.array(F.concat(F.lit("src/router"), F.col("p_size").cast("string"), F.lit(".ts")), F.concat(F.lit("out/"), "p_brand", F.lit(".js")), F.lit("src/layout.tsx"), F.lit("dist/a.js"), F.lit("a/node_modules/x.js"), F.lit("src/foo.test.ts"), F.lit("x.log"), F.concat(F.lit("src/"), "p_type", F.lit(".py")), F.lit("vendor/m.go"), F.lit(".github/workflows/ci.yml"), F.lit("lib/b.so"))
    return table(spark, d, "part").select(F.explode(made).alias("path")).distinct()


@query(f"""WITH {_PATHS} SELECT path, regexp_matches(path, '(^|/)(out|dist|node_modules|vendor)(/|$)') OR regexp_matches(path, '(^|/)[^/]*\\.(log|so)(/|$)') AS excluded, {_LEGACY} AS excluded_before FROM paths""")
def q_exclusions(spark, d):
    return _paths(spark, d).select("path", globs.excluded(F.col("path")).alias("excluded"), globs.excluded(F.col("path"), legacy=True).alias("excluded_before"))


@query(f"""WITH {_DOCS} SELECT path, row_number() OVER (ORDER BY CASE WHEN contains(path, '/de/') THEN 0 ELSE 1 END, path) AS place FROM docs QUALIFY place <= 100""")
def q_priority_sort(spark, d):
    from pyspark.sql import Window

    first = source_files.by_priority(documents(spark, d), "/de/").limit(100)
    order = Window.orderBy(F.when(source_files.matches(F.col("path"), "/de/"), 0).otherwise(1), "path")
    return first.withColumn("place", F.row_number().over(order)).select("path", "place")


@query(f"""WITH {_PATHS} SELECT path, CASE WHEN regexp_matches(path, '\\.(js|ts|tsx)$') THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.yml' THEN 'yaml' END AS format FROM paths""")
def q_format_dispatch(spark, d):
    return _paths(spark, d).select("path", globs.file_format(F.col("path")).alias("format"))


@query(f"""WITH {_DOCS}, l AS (SELECT path, string_split(content, chr(10)) AS lines FROM docs) SELECT path, unnest(range(1, len(lines) + 1)) AS line, length(unnest(lines)) AS chars FROM l""")
def q_lines(spark, d):
    return source_files.lines(documents(spark, d)).select("path", "line", F.length("text").alias("chars"))


@query(f"""WITH {_DOCS} SELECT path, current_file, total_files FROM (SELECT path, row_number() OVER (ORDER BY path) AS current_file, count(*) OVER () AS total_files FROM docs)""")
def q_numbered_files(spark, d):
    return source_files.numbered(documents(spark, d), 1).select("path", "current_file", "total_files")


@query(f"""WITH {_DOCS} SELECT path, CASE WHEN length(content) > 500 THEN left(content, 500) || chr(10) || '... [truncated due to size limit]' ELSE content END AS content FROM docs""")
def q_truncated(spark, d):
    return documents(spark, d).select("path", source_files.truncated(F.col("content"), 500).alias("content"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_]\w*'), lambda x: length(x) > 2 AND x NOT IN
    ('break', 'case', 'chan', 'for', 'func', 'make', 'map', 'new', 'nil', 'range', 'real', 'type', 'var', 'error', 'close', 'copy', 'len', 'int', 'cap', 'byte', 'bool', 'import', 'select', 'string', 'struct', 'switch', 'return', 'true', 'false', 'go', 'if', 'else', 'const', 'print', 'delete', 'default', 'append', 'panic', 'goto', 'imag', 'rune', 'interface', 'package', 'complex', 'continue', 'defer', 'fallthrough', 'println', 'recover')))), ',') AS terms FROM documents""")
def q_related_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.identifiers(F.col("text"), "go")), ",").alias("terms"))


_WORDS = "words AS (SELECT DISTINCT unnest([p_name, p_brand, p_type, p_partkey::VARCHAR, upper(p_type) || '_', p_name || '/x.js', 'ABC_DEFGHIJ']) AS w FROM part)"


@query(f"""WITH {_WORDS}, d AS (SELECT w, regexp_full_match(w, '[0-9]+') AS digits, regexp_full_match(w, '[A-Z_]+') AND length(w) < 10 AS short, contains(w, ' ') OR contains(w, '/') OR contains(w, '.') AS marks FROM words)
    SELECT w, NOT (digits OR short) AND (marks OR length(w) > 10) AS meaningful, NOT (digits OR short) AND (marks OR contains(w, '-') OR length(w) > 15) AS json, NOT (digits OR length(w) < 3) AS shell FROM d""")
def q_meaningful(spark, d):
    p = table(spark, d, "part")
    made = F.array("p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"), F.concat(F.upper("p_type"), F.lit("_")), F.concat("p_name", F.lit("/x.js")), F.lit("ABC_DEFGHIJ"))
    w = F.col("w")
    return p.select(F.explode(made).alias("w")).distinct().select("w", text.meaningful(w).alias("meaningful"), text.meaningful_json(w).alias("json"), text.meaningful_shell(w).alias("shell"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'TODO: ' WHEN 1 THEN 'see the fixme and BUG in ' WHEN 2 THEN ' hack ' ELSE '' END || left(text, 20) AS comment FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'TODO' WHEN 2 THEN 'HACK' END AS marker, CASE doc_id % 4 WHEN 0 THEN 'TODO' WHEN 1 THEN 'FIXME,BUG' WHEN 2 THEN 'HACK' ELSE '' END AS markers FROM c""")
def q_dev_markers(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "TODO: ").when(k == 1, "see the fixme and BUG in ").when(k == 2, " hack ").otherwise("")
    rows = table(spark, d, "documents").select("doc_id", F.concat(head, F.left("text", F.lit(20))).alias("comment"))
    return rows.select("doc_id", text.marker(F.col("comment")).alias("marker"), F.array_join(text.markers(F.col("comment")), ",").alias("markers"))


_ENV = "env AS (SELECT p_partkey, unnest(['API_KEY', 'DB_HOST', 'PORT', 'AWS_REGION', 'SMTP_USER', 'FEATURE_X', 'LOG_LEVEL', 'CACHE_DIR', 'TITLE', 'BASE_URL']) AS k, p_name AS v FROM part)"


@query(f"""WITH {_ENV} SELECT p_partkey, k, CASE WHEN k = 'API_KEY' THEN CASE WHEN length(v) > 8 THEN left(v, 4) || '****' ELSE '****' END ELSE v END AS shown,
    CASE k WHEN 'API_KEY' THEN 'api' WHEN 'DB_HOST' THEN 'database' WHEN 'PORT' THEN 'network' WHEN 'AWS_REGION' THEN 'aws' WHEN 'SMTP_USER' THEN 'email' WHEN 'FEATURE_X' THEN 'feature'
      WHEN 'LOG_LEVEL' THEN 'logging' WHEN 'CACHE_DIR' THEN 'path' WHEN 'BASE_URL' THEN 'api' ELSE 'config' END AS category FROM env""")
def q_mask_env(spark, d):
    names = F.array(*[F.lit(x) for x in "API_KEY DB_HOST PORT AWS_REGION SMTP_USER FEATURE_X LOG_LEVEL CACHE_DIR TITLE BASE_URL".split()])
    rows = table(spark, d, "part").select("p_partkey", F.explode(names).alias("k"), F.col("p_name").alias("v"))
    return rows.select("p_partkey", "k", text.masked(F.col("k"), F.col("v")).alias("shown"), text.env_category(F.col("k"), F.col("v")).alias("category"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, array_to_string(string_split(url, '/')[-2:], '/') AS short FROM pages")
def q_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.short_path(F.col("url")).alias("short"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<script\\b[^>]*>')) AS scripts, len(regexp_extract_all(html, '<style\\b[^>]*>')) AS styles,
    array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'class="([^"]*)"', 1))), ',') AS classes, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ',') AS tags FROM pages""")
def q_page_sections(spark, d):
    found = lambda p, g=1: F.regexp_extract_all("html", F.lit(p), F.lit(g))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return table(spark, d, "pages").select("page_id", F.size(found(r"<script\b[^>]*>", 0)).alias("scripts"), F.size(found(r"<style\b[^>]*>", 0)).alias("styles"), joined(found('class="([^"]*)"')).alias("classes"), joined(found("<([a-z][a-z0-9]*)")).alias("tags"))


@query("""SELECT k AS term, 'constant' AS type, count(*) AS n, sum(v::BIGINT)::BIGINT AS total FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events) GROUP BY 1""")
def q_json_flatten(spark, d):
    parsed = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    pairs = parsed.select(F.explode("m").alias("term", "v"))
    return pairs.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total")).withColumn("type", F.lit("constant"))


# Hashes, trees and refresh


def _hashed(spark, d) -> DataFrame:
    return documents(spark, d).withColumn("hash", F.md5("content"))


@query(f"""WITH {_DOCS}, p AS (SELECT string_split(path, '/') AS s, size FROM docs),
    n AS (SELECT array_to_string(s, '/') AS path, len(s) AS depth, 'file' AS type, size FROM p UNION ALL SELECT array_to_string(s[:2], '/'), 2, 'directory', size FROM p UNION ALL SELECT s[1], 1, 'directory', size FROM p UNION ALL SELECT '', 0, 'directory', size FROM p)
    SELECT path, depth, type, sum(size)::BIGINT AS size FROM n GROUP BY ALL""")
def q_merkle(spark, d):
    return tree.file_nodes(_hashed(spark, d)).groupBy("path", "depth", "type").agg(F.sum("size").alias("size"))


def _edited(files: DataFrame) -> DataFrame:
    """Every 7th file gone, every 5th changed, every 11th also under a new name."""
    k = F.pmod(F.substring_index("path", "/", -1).cast("long"), F.lit(385))
    kept = files.where(k % 7 != 0).withColumn("hash", F.when(k % 5 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return kept.unionByName(files.where(k % 11 == 0).withColumn("path", F.concat(F.lit("new/"), "path")))


_DIFF = f"""WITH {_DOCS}, o AS (SELECT path, string_split(path, '/')[-1]::BIGINT % 385 AS k FROM docs)
    SELECT path, CASE WHEN k % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM o WHERE k % 7 = 0 OR k % 5 = 0 UNION ALL SELECT 'new/' || path, 'added' FROM o WHERE k % 11 = 0"""


@query(_DIFF)
def q_tree_diff(spark, d):
    old = _hashed(spark, d)
    return tree.tree_diff(old, _edited(old))


@query(f"""WITH {_DOCS}, o AS (SELECT path, md5(content) AS hash, string_split(path, '/')[-1]::BIGINT % 385 AS k FROM docs)
    SELECT path, hash || 'x' AS hash FROM o WHERE k % 7 <> 0 AND k % 5 = 0 UNION ALL SELECT 'new/' || path, hash FROM o WHERE k % 11 = 0""")
def q_hash_skip(spark, d):
    old = _hashed(spark, d)
    return tree.changed_files(_edited(old), old).select("path", "hash")


@query(f"""WITH {_DOCS}, o AS (SELECT path, md5(content) AS hash, string_split(path, '/')[-1]::BIGINT % 385 AS k FROM docs)
    SELECT path, CASE WHEN k % 5 = 0 THEN hash || 'x' ELSE hash END AS hash FROM o WHERE k % 7 <> 0 UNION ALL SELECT 'new/' || path, hash FROM o WHERE k % 11 = 0""")
def q_refresh_upsert(spark, d):
    old = _hashed(spark, d)
    new = _edited(old)
    gone = tree.tree_diff(old, new).where("change = 'deleted'")
    return tree.upsert(old, tree.changed_files(new, old), gone, "path").select("path", "hash")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'not tracked' ELSE 'not indexed' END AS state, doc_id::VARCHAR AS path FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 3 = 0)")
def q_integrity(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("path"))
    return tree.integrity(t.where("n % 5 = 0"), t.where("n % 3 = 0"))


# Change sets


_CHANGES = """changes AS (SELECT 'Brand#' || k AS path FROM range(1, 40) t(k) WHERE k % 3 = 1)"""


def _changes(spark) -> DataFrame:
    rows = [(f"Brand#{k}", "M", k % 2 == 0, k) for k in range(1, 40) if k % 3 == 1] + [("Brand#4", "A", True, 99)]
    return changes.staged_wins(spark.createDataFrame(rows, "path string, status string, is_staged boolean, seq int"))


_SYMBOLS = f"""WITH {DEFS}, {REFS}, {USAGE}, {_CHANGES},
    once_ AS (SELECT file AS path, term, arg_min(type, entry_seq) AS type, arg_min(line, entry_seq) AS line FROM defs WHERE file IN (SELECT path FROM changes) AND type IN ('SMALL', 'LARGE', 'PROMO') GROUP BY 1, 2),
    symbols AS (SELECT path, term, type, line, usage_count, row_number() OVER (PARTITION BY path ORDER BY usage_count DESC, term) AS place FROM once_ JOIN usage ON term = target_term)"""


def _symbols(spark, d) -> DataFrame:
    return changes.changed_symbols(_changes(spark), definitions(spark, d), refs(spark, d), ("SMALL", "LARGE", "PROMO"))


@query(_SYMBOLS + " SELECT * FROM symbols")
def q_changes_impact(spark, d):
    return _symbols(spark, d)


@query(_SYMBOLS + """, t AS (SELECT path, sum(CASE WHEN place <= 3 OR usage_count >= 2 THEN usage_count ELSE 0 END)::BIGINT AS impact FROM symbols GROUP BY 1)
    SELECT path, impact, CASE WHEN impact = 0 THEN 'None' WHEN impact < 10 THEN 'Low' WHEN impact < 50 THEN 'Medium' ELSE 'High' END AS risk FROM t""")
def q_risk(spark, d):
    return changes.total_impact(_symbols(spark, d)).withColumn("risk", changes.risk(F.col("impact")))


@query(_SYMBOLS + """, s AS (SELECT path, term FROM symbols WHERE place <= 3 AND usage_count >= 2)
    SELECT path, file, count(*) AS refs FROM refs JOIN s ON term = target_term WHERE file <> path GROUP BY ALL""")
def q_impacted_files(spark, d):
    return changes.impacted_files(_symbols(spark, d), refs(spark, d))


@query(_SYMBOLS + """, s AS (SELECT path, term FROM symbols WHERE place <= 3 AND usage_count >= 2), i AS (SELECT path, file, count(*) AS refs FROM refs JOIN s ON term = target_term WHERE file <> path GROUP BY ALL)
    SELECT file, sum(refs)::BIGINT AS refs FROM i GROUP BY 1 ORDER BY refs DESC, file LIMIT 3""")
def q_key_files(spark, d):
    return changes.key_files(changes.impacted_files(_symbols(spark, d), refs(spark, d)))


@query(_SYMBOLS + """, s AS (SELECT path, term FROM symbols WHERE place <= 3 AND usage_count >= 2), i AS (SELECT path, file, count(*) AS refs FROM refs JOIN s ON term = target_term WHERE file <> path GROUP BY ALL)
    SELECT *, CASE WHEN total_impact = 0 THEN 'None' WHEN total_impact < 10 THEN 'Low' WHEN total_impact < 50 THEN 'Medium' ELSE 'High' END AS risk FROM (
      SELECT coalesce((SELECT sum(CASE WHEN place <= 3 OR usage_count >= 2 THEN usage_count ELSE 0 END) FROM symbols), 0)::BIGINT AS total_impact, coalesce((SELECT sum(refs) FROM i), 0)::BIGINT AS external_refs,
        (SELECT count(DISTINCT file) FROM i) AS impacted_files, (SELECT count(*) FROM symbols WHERE usage_count > 5) AS high_impact)""")
def q_change_report(spark, d):
    return changes.report(_symbols(spark, d), refs(spark, d))


_IMPACTED = "i AS (SELECT 'p' || (l_orderkey % 3) AS path, CASE WHEN l_suppkey % 4 = 0 THEN 'test/s' || l_suppkey || '.spec.ts' ELSE 'src/d' || (l_suppkey % 7) || '/s' || l_suppkey || '.ts' END AS file, count(*) AS refs FROM lineitem GROUP BY ALL)"


def _impacted(spark, d) -> DataFrame:
    s = F.col("l_suppkey")
    file = F.when(s % 4 == 0, F.concat(F.lit("test/s"), s.cast("string"), F.lit(".spec.ts"))).otherwise(F.concat(F.lit("src/d"), (s % 7).cast("string"), F.lit("/s"), s.cast("string"), F.lit(".ts")))
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_orderkey") % 3).cast("string")).alias("path"), file.alias("file"))
    return rows.groupBy("path", "file").agg(F.count("*").alias("refs"))


@query(f"WITH {_IMPACTED} SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT file) AS files FROM i GROUP BY 1 ORDER BY files DESC, dir LIMIT 3")
def q_impacted_dirs(spark, d):
    return changes.by_directory(_impacted(spark, d))


@query(f"WITH {_IMPACTED} SELECT DISTINCT file FROM i WHERE contains(file, '.spec.') ORDER BY file LIMIT 5")
def q_tests_to_run(spark, d):
    return changes.tests_to_run(_impacted(spark, d))


@query("SELECT path, status, is_staged, seq FROM (SELECT 'f' || (o_custkey % 50) AS path, o_orderstatus AS status, o_orderkey % 3 = 0 AS is_staged, o_orderkey::INTEGER AS seq FROM orders) QUALIFY row_number() OVER (PARTITION BY path ORDER BY is_staged DESC, seq) = 1")
def q_staged_wins(spark, d):
    o = table(spark, d, "orders")
    return changes.staged_wins(o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("path"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("is_staged"), F.col("o_orderkey").cast("int").alias("seq")))


# Streams, sessions and logs


@query("""WITH e AS (SELECT *, 'src/f' || user_id || '.ts' AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change FROM events),
    g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts) AS n FROM g)
    SELECT path, max(ts) AS ts, arg_max(change, ts) AS change, count(*) AS events FROM s GROUP BY path, n""")
def q_debounce(spark, d):
    return stream.debounced(events(spark, d), "30 minutes")


_EVENTS = "e AS (SELECT event_id, 'src/f' || user_id || '.ts' AS path, ts, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change FROM events)"


@query(f"WITH {_EVENTS} SELECT change, count(*) AS events, count(DISTINCT path) AS paths FROM e GROUP BY 1")
def q_change_counters(spark, d):
    return stream.counters(events(spark, d))


@query(f"WITH {_EVENTS} SELECT event_id, path, ts, change FROM e WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 3 HOUR AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, path LIMIT 3")
def q_recent_changes(spark, d):
    return stream.recent(events(spark, d), "2024-01-15 00:00:00", 3 * 3600)


@query(f"WITH {_EVENTS} SELECT min(ts) AS first, max(ts) AS last, count(*) AS events FROM e")
def q_change_activity(spark, d):
    return stream.activity(events(spark, d))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS events FROM s GROUP BY user_id, n""")
def q_inactivity_sessions(spark, d):
    return sessions.silence_sessions(table(spark, d, "events"), "user_id", "2 hours")


def _sessions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("project_path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_accessed_at"))


_SESSIONS = "sess AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS project_path, epoch_ms(o_orderdate) AS created_at, epoch_ms(o_orderdate) AS last_accessed_at FROM orders)"


@query(f"WITH {_SESSIONS} SELECT * FROM sess QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY last_accessed_at DESC, id) = 1")
def q_session_latest(spark, d):
    return sessions.latest_per_project(_sessions(spark, d))


@query(f"WITH {_SESSIONS} SELECT * FROM sess WHERE last_accessed_at < 1000000000000 - 30 * 86400000::BIGINT")
def q_session_expiry(spark, d):
    return sessions.expired(_sessions(spark, d), 1_000_000_000_000)


@query("SELECT user_id AS session_id, event_id AS timestamp, event_type AS query FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def q_history(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("timestamp"), F.col("event_type").alias("query"))
    return sessions.history(rows, 5)


def _activity(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    t = F.col("turn")
    return c.select(
        ident(t).alias("id"), F.when(t > 0, ident(t - 1)).alias("parent_tool_use_id"), F.when(t % 3 == 0, "failed").when(t % 3 == 1, "completed").otherwise("running").alias("status"),
        (t * 1000).alias("start_time"), F.when(t % 3 == 1, t * 1000 + F.length("text")).alias("end_time"), F.when(F.col("role") == "assistant", "Task").alias("tool"),
    ).dropDuplicates(["id"])


_ACTIVITY = """act AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role FROM conversations)"""


@query(f"""WITH RECURSIVE {_ACTIVITY}, t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM act WHERE turn = 0 UNION ALL SELECT a.conv_id, a.turn, t.depth + 1 FROM act a JOIN t ON a.conv_id = t.conv_id AND a.turn = t.turn + 1)
    SELECT conv_id || ':' || turn AS id, conv_id || ':0' AS root, depth FROM t""")
def q_activity_tree(spark, d):
    return sessions.activity_tree(_activity(spark, d))


@query("""WITH act AS (SELECT conv_id, turn, any_value(length(text)) AS n FROM conversations GROUP BY 1, 2)
    SELECT count(*) AS nodes, count_if(turn % 3 = 1)::BIGINT AS completed, count_if(turn % 3 = 0)::BIGINT AS failed FROM act""")
def q_activity_stats(spark, d):
    return sessions.activity_stats(_activity(spark, d)).drop("total_duration")


@query(f"WITH {_ACTIVITY} SELECT 'Task' AS tool, count(*) AS uses FROM act WHERE role = 'assistant'")
def q_tool_usage(spark, d):
    return sessions.tool_usage(_activity(spark, d))


@query("""SELECT arg_max(user_id::VARCHAR, event_id) AS session_id, max_by('t' || (value::INTEGER % 3), event_id) AS last_tool, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS cost,
    max_by('result ' || event_id, event_id) FILTER (event_type = 'purchase') AS result FROM events""")
def q_llm_reduce(spark, d):
    e = table(spark, d, "events")
    buy = F.col("event_type") == "purchase"
    none = F.lit(None).cast("string")
    rows = e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"), F.when(buy, F.concat(F.lit("result "), F.col("event_id").cast("string"))).alias("result"), none.alias("error"),
        F.when(buy, F.col("value")).alias("cost"), F.array("event_type").alias("texts"), F.array(F.concat(F.lit("t"), (F.round("value").cast("int") % 3).cast("string"))).alias("tools"),
    )
    return sessions.reduced(rows).withColumn("cost", F.round("cost", 4))


@query("""WITH u AS (SELECT user_id AS id, event_type AS name, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, event_id AS time FROM events)
    SELECT id, arg_max(name, time) AS name, arg_max(status, time) AS status, min(time) AS start_time, max(CASE WHEN status <> 'running' THEN time END) AS end_time, end_time - start_time AS duration FROM u GROUP BY 1""")
def q_activity_lifecycle(spark, d):
    k = F.col("event_type")
    status = F.when(k == "purchase", "completed").when(k == "error", "failed").otherwise("running")
    return sessions.lifecycle(table(spark, d, "events").select(F.col("user_id").alias("id"), k.alias("name"), status.alias("status"), F.col("event_id").alias("time")))


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(a.c, 5000) AS created_at, CASE WHEN b.id IS NOT NULL THEN 5000 ELSE a.c END AS last_accessed_at
    FROM (SELECT o_orderkey::VARCHAR AS id, epoch_ms(o_orderdate) AS c FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey % 3 = 0) b ON a.id = b.id""")
def q_session_touch(spark, d):
    ids = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("id"))
    known = _sessions(spark, d).where("cast(id AS long) % 2 = 0")
    return sessions.touched(known, ids, 5000).select("id", "created_at", "last_accessed_at")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 600 WHEN 'error' THEN 300 ELSE 120 END AS gap FROM events),
    m AS (SELECT *, max(ts + to_seconds(gap * 60)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e),
    s AS (SELECT *, sum(CASE WHEN until IS NULL OR ts >= until THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def q_tool_timeouts(spark, d):
    """Runs of events that end by a silence whose length hangs on the last tool."""
    k = F.col("event_type")
    tool = F.when(k == "view", "Task").when(k == "error", "Bash").otherwise(k)
    gap = F.concat((sessions.timeout_seconds(tool) * 60).cast("string"), F.lit(" seconds"))
    return sessions.silence_sessions(table(spark, d, "events"), "user_id", gap).drop("end")


_NDJSON = """raw AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'noise' WHEN event_type = 'purchase' THEN '{"type":"result","session_id":"s' || user_id || '","result":"r","total_cost_usd":' || value || '}'
    ELSE '{"type":"assistant","message":{"content":[{"type":"text","text":"t' || event_id || '"},{"type":"tool_use","name":"Bash"}]}}' END AS raw FROM events)"""


@query("""SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'result' ELSE 'assistant' END AS type, CASE WHEN event_type = 'purchase' THEN 's' || user_id END AS session_id,
    CASE WHEN event_type = 'purchase' THEN value END AS cost, CASE WHEN event_type <> 'purchase' THEN 't' || event_id END AS said, CASE WHEN event_type <> 'purchase' THEN 'Bash' END AS tool FROM events WHERE event_type <> 'error'""")
def q_event_stream(spark, d):
    from .sources import logs

    e, k = table(spark, d, "events"), F.col("event_type")
    result = F.concat(F.lit('{"type":"result","session_id":"s'), F.col("user_id").cast("string"), F.lit('","result":"r","total_cost_usd":'), F.col("value").cast("string"), F.lit("}"))
    said = F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"t'), F.col("event_id").cast("string"), F.lit('"},{"type":"tool_use","name":"Bash"}]}}'))
    rows = logs.events(e.select(F.col("event_id").alias("seq"), F.when(k == "error", "noise").when(k == "purchase", result).otherwise(said).alias("raw")))
    return rows.select("seq", "type", "session_id", "cost", F.try_element_at("texts", F.lit(1)).alias("said"), F.try_element_at("tools", F.lit(1)).alias("tool"))


@query("""SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS pascal,
    CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS preview, CASE WHEN p_partkey * 1000 // 3600000 > 0 THEN (p_partkey // 3600) || 'h ' || ((p_partkey // 60) % 60) || 'm'
    WHEN p_partkey // 60 > 0 THEN (p_partkey // 60) || 'm ' || (p_partkey % 60) || 's' ELSE p_partkey || 's' END AS duration, trim(p_name) AS unquoted, rpad(p_name, greatest(14, length(p_name))::INTEGER, ' ') AS padded FROM part""")
def q_text_helpers(spark, d):
    p, name = table(spark, d, "part"), F.col("p_name")
    quoted = F.concat(F.lit('"'), name, F.lit(' ${x}$(y)"'))
    return p.select("p_partkey", text.pascal_case(F.translate(name, " ", "-")).alias("pascal"), text.preview(name, 8).alias("preview"), text.human_duration(F.col("p_partkey") * 1000).alias("duration"), text.unquoted(quoted).alias("unquoted"), text.padded(name, 14).alias("padded"))


@query("""SELECT doc_id, length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) + 1 AS line_of_200, array_to_string(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x, ' ')), '|') AS around FROM documents""")
def q_line_helpers(spark, d):
    t = table(spark, d, "documents")
    lines = F.split("text", "\n")
    return t.select("doc_id", text.line_of(F.col("text"), F.lit(200)).alias("line_of_200"), F.array_join(text.surrounding(lines, F.lit(1), 2, 2), "|").alias("around"))


@query("SELECT name, count(*) AS terms FROM (VALUES " + ", ".join(f"('{g}', '{t}')" for g, (_, ts) in groups.GROUPS.items() for t in ts.split()) + ") v(name, term) GROUP BY 1")
def q_concept_groups(spark, d):
    return groups.groups_table(spark).select("name", F.size("terms").cast("long").alias("terms"))


@query()
def q_stream_counters(spark, d):
    """A streaming run over the events, to its end; its last counts."""
    import uuid

    name = f"counters_{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.col("event_type")
    rows = source.select(F.col("user_id").cast("string").alias("path"), "ts", F.when(kind == "signup", "added").when(kind == "error", "deleted").otherwise("modified").alias("change"))
    q = stream.streaming_counters(rows).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


SAMPLES = {
    "app/models.py": 'import os\n\n# TODO: split this up\nclass User(Base):\n    """One account"""\n    def name(self):\n        return format_name(self)\n',
    "app/server.go": 'package main\n\nimport (\n\t"fmt"\n)\n\ntype Server struct {\n\tName string\n}\n\nfunc (s *Server) Run() {\n\tfmt.Println("it is running")\n}\n',
    "app/lib.rs": "/// A point in the plane\n#[derive(Debug)]\npub struct Point { x: i32 }\nimpl Point {\n  pub fn new() -> Self { make(1) }\n}\n",
    "app/View.swift": "struct Home: View {\n  var body: some View { Text(\"hello there\") }\n}\n",
    "app/api.ts": "import { get } from './http'\nexport class Api extends Base {\n  async load(id: string) { return get(`/items/${id}`) }\n}\nconst twice = (x) => x * 2\n",
    "app/Card.svelte": '<script>\nexport let title\nlet n = $state(0)\n</script>\n<Button on:click={go}>{title}</Button>\n<style>\n.card { --gap: 2px; }\n</style>\n',
    "conf/app.yaml": "server:\n  host: localhost\n  port: 8080\n",
    "conf/Cargo.toml": '[package]\nname = "demo"\n[dependencies]\nserde = "1.0"\n',
    "conf/package.json": '{"name": "demo", "scripts": {"build": "tsc"}, "dependencies": {"x": "^1"}}',
    "conf/.env": "DB_HOST=localhost\nAPI_KEY=abcdefghijkl\nBASE_URL=https://api.example.com/v1\n",
    "bin/run.sh": "#!/bin/bash\nNAME=\"some value\"\ndeploy() {\n  build_all $NAME\n}\n",
}


@query()
def q_extractors(spark, d):
    """All extractors, over small sources."""
    from .extract import registry

    return registry.extracted(spark.createDataFrame(list(SAMPLES.items()), "path string, content string"))
