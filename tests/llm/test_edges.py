"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names the operators use themselves."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import embedding_dedup, exact_dedup, html_wrappers, line_dedup, mixing, near_dedup, packing, quality, token_store, warc_dedup

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60000))
WORDS = "the quick brown fox jumps over a lazy dog near the old river bank today"
ROWS = [
    (1, WORDS, "en", "a", 10),
    (2, WORDS, "en", "a", 10),
    (2, WORDS, "en", "a", 10),
    (3, WORDS + " again", None, "b", None),
    (4, None, "en", "a", 0),
    (5, "", "en", None, 0),
    (6, "", "en", None, 0),
    (None, WORDS, "en", "a", 10),
    (None, None, None, None, None),
    (7, "\n\n \n", "fr", "b", 4),
    (8, LONG, "en", "b", len(LONG)),
    (9, LONG, "en", "b", len(LONG)),
    (10, "ok", "en", "b", 2),
    (11, "Ünï € \U0001f600 ok\nsame line here twice\nsame line here twice", "de", "c", 30),
    (None, "only this one has no number", "en", "a", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = sorted(set("id key root a b h n u v e m lead line line_no tid keys class bucket rank span spans piece len tie copy rate cdf size weight grams gen shard filter meta content layout __y digest kind gone rank known label cdf number at doc seen said zc zm own of print words __h __gen __rn __n __source __cdf __copy __place __gone __v a.b `q`".split()))


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH]).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (3, 1), (10, 0), (8, 1), (None, 1), (5, None), (4, 7)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def untouched(before, after):
    assert after.columns == before.columns
    keep = {(r["doc_id"], r["text"], r["id"], r["class"]) for r in before.collect()}
    assert all((r["doc_id"], r["text"], r["id"], r["class"]) in keep for r in after.collect())


def test_exact(docs, none):
    out = exact_dedup.drop_exact_duplicates(docs)
    untouched(docs, out)
    # of WORDS the even generation's 2, of which one row; both null texts; one empty text; one LONG
    assert ids(out) == [2, 3, 4, 6, 7, 8, 10, 11, None, None]
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def test_near(docs, none):
    out = near_dedup.drop_near_duplicates(docs)
    untouched(docs, out)
    # 2 (both rows) and 3 are near 1; 9 equals 8; rows without number or words stay
    assert ids(out) == [1, 4, 5, 6, 7, 8, 10, 11, None, None, None]
    assert near_dedup.drop_near_duplicates(none).count() == 0


def test_lines(docs, none):
    out = line_dedup.drop_near_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] == WORDS and [r["text"] for r in by[2]] == ["", ""]
    assert by[4][0]["text"] is None and by[4][0]["n_lines"] is None
    assert by[5][0]["text"] == "" and by[7][0]["text"] == "\n\n \n" and by[7][0]["n_lines"] == 4
    assert by[8][0]["text"] == LONG and by[9][0]["text"] == ""
    assert by[11][0]["text"].endswith("\nsame line here twice") and by[11][0]["n_dropped"] == 1
    assert {r["text"] for r in by[None]} == {WORDS, None, "only this one has no number"}
    assert line_dedup.drop_near_lines(none).count() == 0


def test_mix(docs, none):
    out = mixing.mix_sources(docs, epochs=40.0, copy_column="copy_no")
    assert out.columns == [*docs.columns, "copy_no"]
    assert mixing.mix_sources(docs, copy_column="rank").columns == [*(c for c in docs.columns if c != "rank"), "rank"]
    counts = {(r["doc_id"], r["text"]): r["n"] for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert counts[(2, WORDS)] % 2 == 0 and (8, LONG) in counts and (4, None) in counts
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs, epochs=0.0).where("text IS NOT NULL AND text <> '' AND source IS NOT NULL").count() == 0


def test_pack(docs, none):
    rows = packing.pack_documents(docs, capacity=1024).collect()
    assert max(r["n_tokens"] for r in rows) <= 1024
    encode = token_store.token_ids(token_store.VOCABULARY)
    assert sum(r["n_tokens"] for r in rows) == sum(len(encode(r[1])) for r in ROWS if r[1])
    held = [d for r in rows for d, piece in zip(r["doc_ids"], r["pieces"]) if piece == 0]
    assert held.count(2) == 2 and held.count(None) == 2 and held.count(8) == 1
    assert packing.pack_documents(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, capacity=1001)


def test_quality(docs, labels, none, spark):
    out = quality.score_documents(docs, labels, labelled=50, pool=50)
    assert out.columns == [*docs.columns, "__content", "__meta", "__score", "__keep"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["__score"] <= 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    untouched(docs, kept)
    own = docs.withColumns({c: F.lit("mine") for c in ("__content", "__KEEP")})
    untouched(own, quality.keep_good(own, labels, labelled=50, pool=50))
    assert {r["__KEEP"] for r in quality.keep_good(own, labels.where("false")).collect()} == {"mine"}
    assert quality.score_documents(own, labels.where("false")).columns == out.columns
    assert quality.score_documents(none, labels).count() == 0
    unlabelled = quality.keep_good(docs, labels.where("false"))
    assert unlabelled.count() == len(ROWS)


def test_store(docs, none):
    store = token_store.token_store(docs).persist()
    recipes = store.where("kind = 'recipe'")
    assert recipes.count() == sum(r[1] is not None for r in ROWS)
    assert recipes.where("n_tokens = 0").count() == 2
    assert all(r["intact"] for r in token_store.restore(store).select("intact").collect())
    assert token_store.token_store(none).count() == 0


def test_pages(spark):
    rows = [(1, "http://h/a", "<p>one</p>"), (1, "http://h/a", "<p>one</p>"), (2, "http://H/b", "<p>two<p>three"), (3, None, "<p>free</p>"), (4, "http://x/", None), (5, "nohost", ""), (None, "http://h/c", "<b><i>text <script>x"), (6, "http://h/d", "<div>" * 3000 + LONG), (7, "http://h/e", "a < b & c &amp; d <")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "wrapper": F.lit("{"), "text": F.lit(1)})
    out = html_wrappers.extract_text(df)
    assert out.columns == ["page_id", "host", "text", "n_data", "n_template"]
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got[1]) == 2 and got[2][0]["text"] == "two\nthree" and got[2][0]["host"] == "h"
    assert got[3][0]["text"] == "free" and got[3][0]["host"] is None
    assert got[4][0]["text"] is None and got[4][0]["n_data"] is None and got[5][0]["text"] == ""
    assert got[6][0]["text"].startswith("word0") and got[7][0]["text"] == "a < b & c & d <"
    assert html_wrappers.extract_text(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(0, "u", "same"), (1, "v", "same"), (35, "w", "same"), (35, "w", "same"), (None, None, "x"), (3, "u3", None), (5, None, ""), (10, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_id": F.lit("1"), "block": F.lit("1"), "digest": F.lit("d")})
    records = warc_dedup.crawl_records(df)
    out = warc_dedup.deduplicate(records.withColumn("header", F.lit("1")).withColumn("refers_to", F.lit(2)))
    rows = out.collect()
    digests = [r["payload_digest"] for r in rows if r["warc_type"] == "response" and r["payload_digest"]]
    assert len(digests) == len(set(digests)) == 3
    assert sum(r["payload_digest"] is None for r in rows) == 1
    assert all(r["refers_to"] for r in rows if r["warc_type"] == "revisit")
    assert len(rows) == records.distinct().count()
    assert warc_dedup.deduplicate(warc_dedup.crawl_records(df.limit(0))).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [5.0, 0.0, 0.0]), (1, [0.0, 1.0]), (10, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "block": F.lit(3)})
    got = sorted((r["id_a"], r["id_b"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 2), (1, 10), (8, 9)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, docs, labels):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, docs, none, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        untouched(docs, after)
        assert stage(spark, none, sf_dir).count() == 0
        now = after.persist()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    encode = token_store.token_ids(token_store.VOCABULARY)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(encode(r["text"])) for r in now.collect() if r["text"])


def test_pipeline_against_its_parts(spark, data):
    """The run equals a plain version of each stage, applied to what came before."""
    documents = spark.read.parquet(f"{data}/documents.parquet")
    good = {r["doc_id"] for r in quality.keep_good(documents, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    rows = [r for r in documents.collect() if r["doc_id"] in good]
    seen, kept = set(), []
    for r in sorted(rows, key=lambda r: (r["doc_id"] % 2, r["doc_id"])):
        if r["text"] not in seen:
            seen.add(r["text"])
            kept.append(r)
    from tests.llm.test_operators import brute_edges, components_of, shingles

    near = components_of(brute_edges({r["doc_id"]: shingles(r["text"]) for r in kept}, 0.5))
    left = spark.createDataFrame([r for r in kept if r["doc_id"] not in near], documents.schema)
    want = {(r["doc_id"], r["n"]) for r in mixing.mix_sources(left).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    out = corpus_pipeline.run(spark, data).toPandas()
    held = collections.Counter(d for docs, pieces in zip(out.doc_ids, out.pieces) for d, piece in zip(docs, pieces) if piece == 0)
    assert set(held.items()) == want and out.n_tokens.max() <= packing.CAPACITY


def test_pipeline_of_empty_tables(spark, none, labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_classes_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [1.0, None]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [5.0, 0.0, 0.0]), (1, [0.0, 1.0]), (10, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in embedding_dedup.vector_classes(df).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 10: (1, 1), 8: (8, 1), 9: (8, 1), **{i: (i, 0) for i in (3, 4, 5, 7)}}
    assert embedding_dedup.vector_classes(df.limit(0)).count() == 0


def test_vectors_at_the_threshold_and_long_ones(spark):
    x = [[1.0, 0.0], [0.95, math.sqrt(1 - 0.95**2)], [0.9499, math.sqrt(1 - 0.9499**2)]]
    rows = [(i, v) for i, v in enumerate(x)] + [(10 + i, [1.0 + (i == k) for k in range(3000)]) for i in range(2)]
    got = {(r["id_a"], r["id_b"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(0, 1), (1, 2), (10, 11)}


def test_warc_ties_and_long_payloads(spark):
    big = b"x" * 5_000_000
    rows = [("r", "response", u, "2024-01-01T00:00:00Z", "sha1:1", b"H\r\n", big) for u in ("b", "a")]
    got = {r["target_uri"]: r for r in warc_dedup.deduplicate(spark.createDataFrame(rows, warc_dedup.RECORD)).collect()}
    assert got["a"]["warc_type"] == "response" and len(got["a"]["block"]) == 5_000_005 and got["b"]["warc_type"] == "revisit"
