"""The corpus operators as queries over the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, html_wrappers, line_dedup, mixing, near_dedup, packing, quality, token_store, warc_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_classes(_table(spark, sf_dir, "embeddings"))


def near_vectors_at_0_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs behind operator 1's classes."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def near_vectors_at_0_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 at a threshold at which the smallest tables have pairs, so that
    its SQL has rows to compare."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.4, block=64)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), copy_column="copy_no")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_text(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are texts, so the blocks are given as texts too."""
    archive = warc_dedup.deduplicate(warc_dedup.crawl_records(_table(spark, sf_dir, "pages")))
    return archive.withColumn("block", F.col("block").cast("string"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("__content").alias("content_score"), F.col("__meta").alias("metadata_score"), F.col("__score").alias("score"), F.col("__keep").alias("keep"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_near_lines(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, near_vectors_at_0_95, near_vectors_at_0_4, op2_mixing, op3_token_store, op4_html_extraction, op5_warc, op6_packing, op7_quality_classifier, op8_minhash_near_dedup, op9_line_dedup, op10_exact_dedup)}


_URN = "'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def _urn(key: str) -> str:
    return f"(SELECT {_URN} FROM (SELECT md5({key}) AS h))"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": """
            WITH RECURSIVE pairs AS (
              SELECT DISTINCT a.vec_id AS a, b.vec_id AS b
              FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
              WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
            ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
            numbers AS (SELECT a AS id, count(*) AS n FROM ends GROUP BY a),
            reach(id, root) AS (
              SELECT b, a FROM pairs UNION
              SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.id WHERE e.b > r.root),
            roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
            SELECT v.vec_id, coalesce(r.root, v.vec_id) AS class_id, coalesce(n.n, 0) AS n_links
            FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) v
            LEFT JOIN numbers n ON n.id = v.vec_id LEFT JOIN roots r ON r.id = v.vec_id""",
        "near_vectors_at_0_95": """
            SELECT DISTINCT a.vec_id AS id_a, b.vec_id AS id_b
            FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95""",
        "near_vectors_at_0_4": """
            SELECT DISTINCT a.vec_id AS id_a, b.vec_id AS id_b
            FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""",
        "op2_mixing": """
            WITH sizes AS (
              SELECT source, sum(length(text)) AS size FROM documents GROUP BY source),
            rates AS (
              SELECT source, 1.0::DOUBLE * sum(size) OVER () * pow(size::DOUBLE, 0.7) / sum(pow(size::DOUBLE, 0.7)) OVER () / size AS rate
              FROM sizes),
            terms AS (
              SELECT source, rate, k, exp(k * ln(rate) - rate - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS p
              FROM rates, range(0, 200) t(k)),
            cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
            draws AS (
              SELECT *, ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
            counted AS (
              SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source = d.source AND cdf.c <= d.u) AS n FROM draws d)
            SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy_no FROM counted""",
        "op5_warc": f"""
            WITH seen AS (
              SELECT page_id, url, html, 'sha1:' || sha1(html) AS digest, kind, wait
              FROM pages, (VALUES ('response', 0, 1), ('revisit', 2592000, 5), ('response', 86400, 7)) v(kind, wait, every)
              WHERE page_id % every = 0),
            records AS (
              SELECT {_urn("page_id || ':' || kind || ':' || wait || ':' || url")} AS id, kind, url, html, digest,
                strftime(make_timestamp((1704067200 + page_id % 86400 + wait) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date
              FROM seen),
            firsts AS (
              SELECT digest, min(date || ' ' || id) AS k FROM records WHERE kind = 'response' GROUP BY digest),
            origin AS (
              SELECT f.digest, r.id AS o_id, r.url AS o_url, r.date AS o_date
              FROM firsts f JOIN records r ON r.digest = f.digest AND r.date || ' ' || r.id = f.k AND r.kind = 'response'),
            sorted AS (
              SELECT r.*, o.*, CASE WHEN r.kind = 'response' AND r.id = o.o_id THEN 'response' ELSE 'revisit' END AS t
              FROM records r JOIN origin o ON r.digest = o.digest),
            blocks AS (
              SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10)
                || CASE WHEN t = 'response' THEN html ELSE '' END AS block, {_urn("id || ':deduplicated'")} AS fresh, {_urn("o_id || ':deduplicated'")} AS o_fresh
              FROM sorted)
            SELECT id AS source_record_id, t AS warc_type, url AS target_uri, date AS warc_date, digest AS payload_digest,
              CASE WHEN t = 'revisit' THEN o_fresh END AS refers_to,
              replace('WARC/1.1' || chr(10) || 'WARC-Type: ' || t || chr(10) || 'WARC-Record-ID: <' || fresh || '>' || chr(10) || 'WARC-Date: ' || date || chr(10)
                || 'WARC-Target-URI: ' || url || chr(10) || 'WARC-Payload-Digest: ' || digest || chr(10) || 'WARC-Block-Digest: sha1:' || sha1(block) || chr(10)
                || CASE WHEN t = 'revisit' THEN 'WARC-Profile: {warc_dedup.PROFILE}' || chr(10) || 'WARC-Refers-To: <' || o_fresh || '>' || chr(10)
                     || 'WARC-Refers-To-Target-URI: ' || o_url || chr(10) || 'WARC-Refers-To-Date: ' || o_date || chr(10) ELSE '' END
                || 'Content-Type: application/http; msgtype=response' || chr(10) || 'Content-Length: ' || strlen(block) || chr(10), chr(10), chr(13) || chr(10)) AS header,
              block
            FROM blocks""",
        "op8_minhash_near_dedup": r"""
            WITH RECURSIVE words AS (
              SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z[:^ascii:]]+') AS w FROM documents),
            grams AS (
              SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
              FROM words),
            sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
            common AS (
              SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            edges AS (
              SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.5),
            reach(id, root) AS (
              SELECT b, a FROM edges UNION
              SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, r.root FROM reach r JOIN edges e ON r.id IN (e.a, e.b)
              WHERE CASE WHEN e.a = r.id THEN e.b ELSE e.a END > r.root)
            SELECT * FROM documents WHERE doc_id NOT IN (SELECT id FROM reach)""",
        "op10_exact_dedup": """
            SELECT doc_id, text, lang, source, n_chars FROM (
              SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id % 2, doc_id) AS rn FROM documents)
            WHERE rn = 1 OR text IS NULL""",
    }
