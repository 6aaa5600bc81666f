"""Each operator against a brute-force version, a round trip or held-out rows."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from siftwell.llm import common, embedding_dedup, exact_dedup, html_wrappers, kernels, line_dedup, mixing, near_dedup, packing, quality, queries, token_store, warc_dedup
from tests.compare import same


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    same(queries.queries()[name](spark, data), duck, queries.oracle_sql()[name])


def components_of(edges):
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent) if find(x) != x}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1120)]
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == components_of([e for e in edges if e[0] != e[1]])


# 1


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([centre[rng.integers(40, size=300)] + rng.normal(scale=s, size=(300, 16)) for s in (0.02, 0.2, 0.5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for threshold, block in ((0.95, 64), (0.8, 37)):
        i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        got = {(r["id_a"], r["id_b"]) for r in embedding_dedup.near_vectors(df, threshold, block=block).collect()}
        assert got == set(zip(i.tolist(), j.tolist())) and got


def test_small_blocks_are_not_sent_to_each_other_one_by_one(spark, monkeypatch):
    """125 blocks that are all near to each other; then also some ids with two vectors, of which both are near to another."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1000, 64))
    x[500:600] = x[:100] + rng.normal(scale=0.1, size=(100, 64))
    x[900:950] = x[:50] + rng.normal(scale=0.1, size=(50, 64))
    sent, apply = [], GroupedData.applyInPandas

    def counted(self, *args):
        if "v" in self._df.columns:
            sent.append(self._df.agg(F.sum(F.octet_length("v"))).first()[0])
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.4, 1))
    for ids in (list(range(1000)), [k % 900 for k in range(1000)]):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x)], "vec_id long, embedding array<double>")
        got = [(r["id_a"], r["id_b"]) for r in embedding_dedup.near_vectors(df, 0.4, block=8).collect()]
        want = {(min(ids[p], ids[q]), max(ids[p], ids[q])) for p, q in zip(i.tolist(), j.tolist()) if ids[p] != ids[q]}
        assert len(got) == len(want) and set(got) == want
        assert sent.pop() <= 17 * x.nbytes and not sent


def test_one_vector_of_each_group_stays(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 12)), 4, axis=0) + rng.normal(scale=0.05, size=(120, 12))
    df = spark.createDataFrame([(i, v.tolist(), "g") for i, v in enumerate(x)], "vec_id long, embedding array<double>, gone string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = components_of(zip(*(k.tolist() for k in np.nonzero(np.triu(u @ u.T >= 0.95, 1)))))
    out = embedding_dedup.drop_near_vectors(df)
    assert out.columns == df.columns and sorted(r["vec_id"] for r in out.collect()) == [i for i in range(120) if i not in root]


def test_intervals_skip_distant_blocks():
    x = np.eye(4)[[0] * 1200 + [1] * 1200]
    i, j = embedding_dedup.join_intervals(x, x, x, x, 0.3, 0.95, True)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert got == {(a, b) for a in range(2400) for b in range(a + 1, 2400) if (a < 1200) == (b < 1200)}
    assert len(i) < 0.4 * 2400 * 2400


def classes_of(pairs, ids):
    root, n = components_of(pairs), collections.Counter(x for p in pairs for x in p)
    return {i: (root.get(i, i), n[i]) for i in ids}


def test_classes_count_every_pair_without_giving_it(spark, monkeypatch):
    """A crowd of near vectors, some ids with two vectors, and some alone."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=0.05, size=(400, 16)), rng.normal(size=(12, 16)).repeat(8, axis=0) + rng.normal(scale=0.2, size=(96, 16))])
    ids = [i % 480 for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    pairs = {(min(a, b), max(a, b)) for a, b in ((ids[p], ids[q]) for p, q in zip(i.tolist(), j.tolist())) if a != b}
    passed, written = [], embedding_dedup.written

    def counted(df, tag):
        out = written(df, tag)
        if tag == "links":
            passed.append(out.count())
        return out

    monkeypatch.setattr(embedding_dedup, "written", counted)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for block in (4096, 60):
        got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in embedding_dedup.vector_classes(df, block=block).collect()}
        assert got == classes_of(pairs, set(ids))
    assert len(pairs) > 60_000 and passed[0] < 0.3 * len(pairs)


def test_classes_match_sql_where_there_are_pairs(spark, data, duck):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    sql = queries.oracle_sql()["op1_embedding_near_dedup"].replace(">= 0.95", ">= 0.4")
    same(embedding_dedup.vector_classes(table, threshold=0.4, block=64), duck, sql)
    assert duck.execute(f"SELECT count(*) FROM ({sql}) WHERE n_links > 1 AND class_id <> vec_id").fetchone()[0]


def test_query_has_a_row_for_each_vector(spark, data):
    out = queries.queries()["op1_embedding_near_dedup"](spark, data)
    assert out.columns == ["vec_id", "class_id", "n_links"]
    assert out.count() == spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").distinct().count()


# 2


def test_poisson_table(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 4.0), ("c", 900.0), (None, 0.0), ("d", 30000.0)], "source string, rate double")
    for r in mixing.poisson_table(rates).collect():
        cdf, lam = np.array(r["cdf"]), r["rate"]
        p = np.diff(np.concatenate([[0.0], cdf]))
        assert abs(cdf[-1] - 1) < 1e-8 and abs((p * np.arange(len(p))).sum() - lam) < 1e-6 * max(lam, 1)


def test_mixing_meets_its_weights(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "a" if i % 4 else "b", 10) for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    out = mixing.mix_sources(df, weights, epochs=1.5).persist()
    size = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(r[1]) for r in rows)
    assert abs(size["b"] / (size["a"] + size["b"]) - 0.75) < 0.02
    assert abs(sum(size.values()) / (1.5 * total) - 1) < 0.03
    again = mixing.mix_sources(df.repartition(3), weights, epochs=1.5)
    count = lambda d: {(r["doc_id"], r["count"]) for r in d.groupBy("doc_id").count().collect()}
    assert count(out) == count(again)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 0.05


# 3


def test_store_restores_every_stream(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    store = token_store.token_store(docs, fan=8).persist()
    encode = token_store.encoder(token_store.VOCABULARY).encode_ordinary
    want = {r["doc_id"]: encode(r["text"]) for r in docs.collect()}
    got = token_store.restore(store).collect()
    assert all(r["intact"] for r in got) and {r["doc_id"]: list(r["ids"]) for r in got} == want
    chunks = store.where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    tops = store.where("kind LIKE 'manifest%'").groupBy("kind").count().orderBy("kind").collect()
    assert tops[-1]["count"] == 1 and tops[0]["count"] > 1
    broken = store.withColumn("ids", F.when(F.col("ids").isNotNull(), F.unhex(F.lit("0100"))))
    assert not any(r["intact"] for r in token_store.restore(broken).where("n_tokens > 0").collect())


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50000, 30000).astype(np.uint32)
    ends = token_store.cut_points(ids)
    sizes = np.diff(np.concatenate([[0], ends]))
    assert ends[-1] == len(ids) and sizes[:-1].min() >= token_store.LEAST and sizes.max() <= token_store.MOST
    moved = token_store.cut_points(np.concatenate([rng.integers(0, 50000, 777).astype(np.uint32), ids])) - 777
    assert len(set(ends.tolist()) & set(moved.tolist())) > 0.8 * len(ends)


def test_wide_ids_have_four_bytes(spark, monkeypatch):
    assert token_store.merkle_root([]) != token_store.merkle_root([b""])
    texts = ["a wide one", "narrow", "", "a wide one"]
    wide = [[70000 + ord(c) for c in t] if "wide" in t else [ord(c) for c in t] for t in texts]
    monkeypatch.setattr(token_store, "token_ids", lambda path: lambda text: np.array([(70000 if "wide" in text else 0) + ord(c) for c in text], np.uint32))
    run = token_store._chunked("")
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in run([batch]) for r in b.to_pylist()]
    bodies = [r["ids"] for r in rows if r["kind"] == "chunk"]
    assert len(bodies) == 2 and bodies[0][0] == 4 and len(bodies[0]) == 41 and len(bodies[1]) == 12
    store = spark.createDataFrame([tuple(r.values()) for r in rows], token_store.KIND)
    got = {r["doc_id"]: r for r in token_store.restore(store).collect()}
    assert all(got[i]["intact"] and got[i]["ids"] == wide[i] for i in range(4))


def test_equal_documents_fall_into_many_manifests(spark):
    docs = spark.createDataFrame([(i, "the same") for i in range(400)], "doc_id long, text string")
    sizes = [len(r["chunks"]) // 32 for r in token_store.token_store(docs, fan=16).where("kind = 'manifest1'").collect()]
    assert sum(sizes) == 400 and max(sizes) < 60


# 4


def page(title, paras, items, extra=""):
    lis = "".join(f"<li><a href=/{i}>{i}</a></li>" for i in items)
    return f"<html><body><nav><ul>{lis}</ul></nav><div class='x'>All about things</div><h1>{title}</h1>{extra}" + "".join(f"<p>{p}</p>" for p in paras) + "<footer>made by us</footer></body></html>"


def test_wrapper_recovers_a_known_template(spark):
    pages = [("h", page(f"Title {k}", [f"para {k} {j}" for j in range(1 + k % 3)], ["a", "b"][: 1 + k % 2], "<em>new</em><div class='note'>a note %d</div>" % k if k % 4 == 0 else "")) for k in range(12)]
    w = html_wrappers.wrappers(spark.createDataFrame(pages, "host string, html string")).first()["wrapper"]
    assert html_wrappers.expression(w) == "<html><body><nav><ul>(<li>#text)+</ul></nav><div.x>#text</div><h1>#text</h1>(#text<div.note>#text</div>)?(<p>#text)+<footer>#text</footer>"
    df = spark.createDataFrame([(i, "http://h/x", p) for i, (_, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_wrappers.extract_text(df).collect()}
    for k in range(12):
        want = [f"Title {k}"] + [f"a note {k}"] * (k % 4 == 0) + [f"para {k} {j}" for j in range(1 + k % 3)]
        assert got[k]["text"].split("\n") == want, (got[k]["text"], want)


def test_every_page_matches_its_wrapper(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in html_wrappers.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        want = set(re.findall(r"[^\W\d_]{4,}", re.sub("<[^>]*>", " ", article)))
        have = set(re.findall(r"[^\W\d_]{4,}", got[r["page_id"]]["text"]))
        assert len(want & have) >= 0.95 * len(want)


def test_copies_keep_blocks_of_their_own(spark):
    own = "<h2>Own heading</h2><blockquote>Own quote</blockquote><table><tr><td>Own cell</td></tr></table>"
    pages = [page(f"Title {k}", [f"para {k}"], ["a"]) for k in range(20)] + [page("Twice", ["the same"], ["a"], own)] * 2 + [""]
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract_text(df).collect()}
    assert got[20] == got[21] == "Twice\nOwn heading\nOwn quote\nOwn cell\nthe same"
    assert got[0] == "Title 0\npara 0" and got[22] == ""


ENDS = {
    "<body><img class='banner'><input class=menu><hr class='promo'/><p>kept": "kept",
    "<body><p class='ad'>buy<p>kept<div>also": "kept\nalso",
    "<body><div><p class='ad'>buy</div>kept": "kept",
    "<body><ul><li class='menu'>home<ul><li>deep</ul><li>kept</ul>also": "kept\nalso",
    "<body><ul><li>kept<li class='menu'>home</ul>also": "kept\nalso",
    "<body><dl><dt class='promo'>buy<dd>kept</dl>also": "kept\nalso",
    "<body><table><tr><td class='ad'>buy<td>kept<tr class='ad'><td>buy<td>this<tr><td>also</table>end": "kept\nalso\nend",
    "<body><table><thead class='ad'><tr><td>buy<tbody><tr><td>kept</table>": "kept",
    "<body><select><option class='ad'>buy<option>kept</select>also": "kept\nalso",
    "<html><head><title>name</title><meta name=x><body><p>kept": "kept",
    "<head><title>name</title><p>kept": "kept",
    "<head><title>name</title>kept": "kept",
    "<body class='home nav'><p>kept": "kept",
    "<article><p>one<section><p class='ad'>buy</section>two<p>three</article>": "one\ntwo\nthree",
    "<body><div class='ad'><div>buy</div>this<p>too</div>kept<nav>menu<ul><li>x</ul></nav>also": "kept\nalso",
    "<body><div class='ad'>buy<img class='x'><svg><path class='menu'/></svg><p>this</p></div>kept": "kept",
}


@pytest.mark.parametrize("html", ENDS)
def test_regions_end_where_html_ends_them(html):
    words = frozenset("ad banner menu nav promo".split())
    _, texts, aside = html_wrappers.tokens(html, html_wrappers.Symbols(), words)
    assert "\n".join(t for t, a in zip(texts, aside) if not a) == ENDS[html]


def test_classes_are_not_judged_unless_named(spark):
    pages = [(k, "http://h/", f"<div class='ad'>number {k}</div><p>text {k}</p><div class='menu'>the same</div>") for k in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract_text(df).collect()}
    assert got == {k: f"number {k}\ntext {k}" for k in range(4)}
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract_text(df, ("ad",)).collect()}
    assert got == {k: f"text {k}" for k in range(4)}


@pytest.mark.parametrize("cells", [1, 50, 1 << 28])
def test_alignments_are_longest(monkeypatch, cells):
    monkeypatch.setattr(html_wrappers, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_wrappers.align(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p < q and u < v for (p, u), (q, v) in zip(got, got[1:]))


def test_very_many_classes_and_long_pages(spark):
    many = "".join(f"<i></i><div class=c{k}>" for k in range(300_000)) + "end"
    long = ["".join(f"<h{(k * s) % 6 + 1}>{s} {k}" for k in range(12_000)) for s in (5, 7)]
    df = spark.createDataFrame([(0, "http://a/", many), (1, "http://a/", "<p>short"), *((2 + k, "http://b/", x) for k, x in enumerate(long))], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_wrappers.extract_text(df.repartition(4)).collect()}
    assert got[0]["text"] == "end" and got[1]["text"] == "short"
    assert all(got[2 + k]["n_data"] == 12_000 for k in range(2))


@pytest.mark.parametrize("width", [64, 65, 66, 97, 128, 500])
@pytest.mark.parametrize("lead", [0, 1, 37])
def test_units_of_any_length_are_folded(width, lead):
    s = html_wrappers.Symbols()
    unit, ahead = "".join(s.of(f"td.c{k}") for k in range(width)), "".join(s.of(f"h{k}") for k in range(lead))
    text, widths = html_wrappers.fold(ahead + unit * 3 + s.of("/table"), s)
    assert text == ahead + s.of(("+", s.items(unit))) + s.of("/table") and widths == [1] * lead + [3 * width, 1]
    assert html_wrappers.fold(unit + s.of("x") + unit, s)[0] == unit + s.of("x") + unit


def test_fold_and_align_keep_tokens():
    s = html_wrappers.Symbols()
    text, widths = html_wrappers.fold("".join(s.of(x) for x in "ul li # li # li # /ul".split()), s)
    assert len(text) == 3 and sum(widths) == 8
    assert html_wrappers.align("abcd", "xbcy") == [(1, 1), (2, 2)]


# 5


def test_archives_round_trip(spark, tmp_path, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(30)
    archive = warc_dedup.deduplicate(warc_dedup.crawl_records(pages)).persist()
    rows = archive.collect()
    kept = {r["payload_digest"] for r in rows if r["warc_type"] == "response"}
    assert len(kept) == sum(r["warc_type"] == "response" for r in rows)
    responses = {r["header"].split("WARC-Record-ID: <")[1].split(">")[0]: r["payload_digest"] for r in rows if r["warc_type"] == "response"}
    for r in rows:
        if r["warc_type"] == "revisit":
            assert responses[r["refers_to"]] == r["payload_digest"]
    index = warc_dedup.write_archives(archive.repartition(3), str(tmp_path)).collect()
    assert len(index) == len(rows)
    back = warc_dedup.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["header"], bytes(r["block"])) for r in back) == sorted((r["header"], bytes(r["block"])) for r in rows)
    import gzip

    one = index[0]
    with open(tmp_path / one["file"], "rb") as f:
        f.seek(one["offset"])
        assert gzip.decompress(f.read(one["length"])).startswith(b"WARC/1.1\r\n")


def test_archives_can_be_read_and_deduplicated_again(spark, tmp_path, data):
    records = warc_dedup.crawl_records(spark.read.parquet(f"{data}/pages.parquet").limit(12))
    archive = warc_dedup.deduplicate(records).persist()
    warc_dedup.write_archives(archive, str(tmp_path))
    back = warc_dedup.records_of(warc_dedup.read_archives(spark, str(tmp_path)))
    plain = lambda df: sorted((r["warc_type"], r["target_uri"], r["warc_date"], r["payload_digest"], r["block"]) for r in df.collect())
    assert plain(warc_dedup.deduplicate(back)) == plain(archive)
    payloads = {r["payload"] for r in records.collect() if r["payload"] is not None}
    assert {r["payload"] for r in back.where("warc_type = 'response'").collect()} == payloads


def test_bytes_of_any_kind_pass_through_archives(spark, tmp_path):
    odd = [b"\xff\xfe\x80", "caf\xe9".encode("latin-1"), b"", b"\r\n\r\n", bytes(range(256)) * 40000, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"]
    rows = [(f"urn:{k}", "response", f"http://h/{k}", "2024-01-01T00:00:00Z", f"sha1:{k}", b"HTTP/1.1 200 OK\r\nX: \xe9\r\n", x) for k, x in enumerate(odd)]
    archive = warc_dedup.deduplicate(spark.createDataFrame(rows, warc_dedup.RECORD))
    warc_dedup.write_archives(archive.repartition(2), str(tmp_path))
    head = "warc/1.1\r\n".upper() + "warc-type: response\r\nwarc-target-uri: http://plain/\r\nCONTENT-LENGTH:4\r\n\r\n"
    (tmp_path / "other.warc").write_bytes(head.encode() + b"\xff\xfe\r\n\r\n\r\n")
    back = warc_dedup.records_of(warc_dedup.read_archives(spark, f"file://{tmp_path}"))
    got = {r["target_uri"]: bytes(r["payload"]) for r in back.collect()}
    assert got == {f"http://h/{k}": x for k, x in enumerate(odd)} | {"http://plain/": b"\xff\xfe\r\n"}
    assert {bytes(r["http_header"]) for r in back.where("http_header IS NOT NULL").collect()} == {b"HTTP/1.1 200 OK\r\nX: \xe9\r\n"}


def test_archives_are_streamed():
    import gzip
    import io
    import zlib

    class Zeros(io.RawIOBase):
        """A member of a record of a gigabyte of zeros, made as it is read."""

        def __init__(self, size):
            self.pack, self.left = zlib.compressobj(6, zlib.DEFLATED, 31), size
            self.ready = self.pack.compress(f"WARC/1.1\r\ncontent-length: {size}\r\n\r\n".encode())

        def read(self, n=-1):
            while self.left and not self.ready:
                step = min(self.left, 1 << 22)
                self.left -= step
                self.ready = self.pack.compress(bytes(step)) + (b"" if self.left else self.pack.flush())
            out, self.ready = self.ready, b""
            return out

    (one,) = warc_dedup._records(warc_dedup._Members(Zeros(300 << 20)))
    assert len(one[1]) == 300 << 20
    cut = gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(ValueError):
        list(warc_dedup._records(warc_dedup._Members(io.BytesIO(cut))))


def test_revisit_without_original(spark):
    rows = [("r1", "revisit", "http://a", "2024-01-01T00:00:00Z", "sha1:zz", b"H\r\n", None), ("r2", "metadata", "http://a", "2024-01-01T00:00:00Z", None, b"", b"m"), ("r3", "response", "u", "2024-01-02T00:00:00Z", "sha1:p", b"H\r\n", b"p"), ("r4", "response", "v", "2024-01-01T00:00:00Z", "sha1:p", b"H\r\n", b"p")]
    got = {r["source_record_id"]: r for r in warc_dedup.deduplicate(spark.createDataFrame(rows, warc_dedup.RECORD)).collect()}
    assert len(got) == 4 and got["r1"]["refers_to"] is None and "WARC-Refers-To" not in got["r1"]["header"]
    assert got["r4"]["warc_type"] == "response" and got["r3"]["warc_type"] == "revisit" and got["r3"]["block"] == b"H\r\n\r\n"
    assert got["r2"]["block"] == b"\r\nm"


# 6


def test_packs_hold_every_token_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packs = packing.pack_documents(docs, capacity=2048, unit=8).collect()
    encode = token_store.token_ids(token_store.VOCABULARY)
    want = {r["doc_id"]: encode(r["text"]).tolist() for r in docs.collect()}
    got = collections.defaultdict(dict)
    for p in packs:
        ids = np.frombuffer(p["ids"], "<u2").tolist()
        assert len(ids) == p["n_tokens"] == sum(p["lengths"]) <= 2048
        at = 0
        for doc, piece, n in zip(p["doc_ids"], p["pieces"], p["lengths"]):
            assert piece not in got[doc]
            got[doc][piece] = ids[at : at + n]
            at += n
    assert {d: [x for k in sorted(parts) for x in parts[k]] for d, parts in got.items()} == {d: x for d, x in want.items() if x}
    assert [p["pack_id"] for p in sorted(packs)] == list(range(len(packs)))


@pytest.mark.parametrize("words", [3, 40, 900])
def test_packs_are_nearly_full(spark, words):
    rng = random.Random(words)
    texts = ["tree " * max(1, int(rng.lognormvariate(math.log(words), 0.8))) for _ in range(1500)]
    packs = packing.pack_documents(docs_of(spark, texts), capacity=4096).collect()
    total = sum(p["n_tokens"] for p in packs)
    fill = total / (4096 * len(packs) or 1)
    assert fill > (0.93 if words > 100 else 0.85 if words > 10 else 0.4), (fill, len(packs))


def test_column_generation_is_optimal():
    sizes = np.arange(1, 11)
    demand = np.zeros(10, np.int64)
    demand[[2, 3, 6]] = [40, 10, 20]  # sizes 3, 4, 7 into 10: 7+3 twenty times, 3+3+4 ten times
    lp = sum(x for _, x in packing.column_generation(demand, sizes, 10))
    assert abs(lp - 30) < 1e-6
    plan = packing.rounded_patterns(demand, sizes, 10)
    assert sum(p * n for p, n in plan).tolist() == demand.tolist() and sum(n for _, n in plan) == 30


def test_packs_are_within_a_brute_force_optimum():
    """Small instances against the least number of packs of all ways to fill them."""
    rng = random.Random(6)
    for _ in range(30):
        sizes, units = np.array(sorted(rng.sample(range(2, 9), 3))), 12
        demand = np.array([rng.randrange(5) for _ in sizes])
        plan = packing.rounded_patterns(demand, sizes, units, 1e-9)
        assert all((p * sizes).sum() <= units for p, _ in plan)
        assert sum((p * n for p, n in plan), np.zeros(3, int)).tolist() == demand.tolist()
        assert 0 <= sum(n for _, n in plan) - _fewest(tuple(demand.tolist()), tuple(sizes.tolist()), units) <= 1


def _fewest(left, sizes, units, memo=None):
    memo = {} if memo is None else memo
    if not any(left):
        return 0
    if left not in memo:
        best = sum(left)
        todo, seen = [(tuple(0 for _ in sizes), 0)], set()
        while todo:
            take, used = todo.pop()
            if take in seen:
                continue
            seen.add(take)
            grown = [(tuple(t + (i == k) for i, t in enumerate(take)), used + s) for k, s in enumerate(sizes) if take[k] < left[k] and used + s <= units]
            todo += grown
            if not grown:
                best = min(best, 1 + _fewest(tuple(a - b for a, b in zip(left, take)), sizes, units, memo))
        memo[left] = best
    return memo[left]


def test_knapsack_prices():
    value, counts = packing.best_pattern(np.array([0.1, 0.25, 0.3, 0.0, 0.0]), np.arange(1, 6), 5)
    assert abs(value - 0.6) < 1e-9 and counts.tolist() == [1, 2, 0, 0, 0]


# 7


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    out = quality.score_documents(docs, seen, labelled=300, pool=300).select("doc_id", F.col("__score").alias("s"), F.col("__keep").alias("k")).toPandas()
    test = out.merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert ((test.k) == (test.quality == 1)).mean() > 0.97
    assert test[test.quality == 1].k.mean() > 0.98
    assert out.s.between(0, 1).all() and len(out) == docs.count()


def test_pseudo_labels_come_from_all_unlabelled_rows(spark, monkeypatch):
    texts = [f"plain words number {i} of a text that reads well enough" if i % 2 else f"$$ ## {i} || ** %% ~~" for i in range(4000)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality long")
    seen, scores = [], quality._scores

    def counted(rows, *rest):
        seen.append(rows.count())
        return scores(rows, *rest)

    monkeypatch.setattr(quality, "_scores", counted, raising=True)
    out = quality.score_documents(docs, labels, dims=256, rounds=2).select("doc_id", "__keep").collect()
    assert seen == [4000, 4000] and all(r["__keep"] == bool(r["doc_id"] % 2) for r in out)


def test_views_teach_each_other():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400).astype(float)
    a, b = (y[:, None] * 2 - 1) + rng.normal(scale=1.2, size=(400, 3)), (y[:, None] * 2 - 1) + rng.normal(scale=1.2, size=(400, 2))
    known = np.where(np.arange(300) < 40, y[:300], np.nan)
    models = quality.co_train(a[:300], b[:300], known, rounds=3, per_round=40)
    p = (models[0].probability(a[300:]) + models[1].probability(b[300:])) / 2
    assert ((p > 0.5) == y[300:]).mean() > 0.9


# 8


def shingles(text, width=3):
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_edges(sets, threshold):
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    common = collections.Counter((a, b) for ids in inverted.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    return [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold]


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    got = {r["id"]: r["root"] for r in near_dedup.near_duplicates(docs).collect()}
    want = components_of(brute_edges(sets, 0.5))
    assert len(set(want.items()) & set(got.items())) >= 0.98 * len(want) and set(got) <= set(want)


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(2)
    common, errors = rng.integers(0, 2**63, 300).astype(np.uint64), []
    for share in (0, 60, 150, 300):
        a = np.concatenate([common, rng.integers(0, 2**63, share).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 2**63, share).astype(np.uint64)])
        sk = kernels.fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 512)
        errors.append(abs((sk[0] == sk[1]).mean() - 300 / (300 + 2 * share)))
    assert max(errors) < 0.08
    tiny = kernels.fast_sketch(np.array([5, 9], np.uint64), np.array([0, 1]), 3, 64)
    assert (tiny[:2] != np.iinfo(np.uint64).max).all() and (tiny[2] == np.iinfo(np.uint64).max).all()


def test_shingles_are_those_of_words():
    texts = ["Aa bb, cc dd", "one", "", "a b", "été là-bas ici", "x y z"]
    raw = "".join(t.lower() for t in texts).encode()
    off = np.cumsum([0] + [len(t.lower().encode()) for t in texts])
    values, row = kernels.word_shingles(np.frombuffer(raw, np.uint8), off, 3)
    assert np.bincount(row, minlength=6).tolist() == [2, 1, 0, 1, 2, 1]
    again, _ = kernels.word_shingles(np.frombuffer(b"bb cc dd", np.uint8), np.array([0, 8]), 3)
    assert values[1] == again[0] and len(set(values.tolist())) == len(values)


# 9


def test_line_dedup_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], k, x) for r in docs.collect() for k, x in enumerate(r["text"].split("\n"))]
    lines = sorted({x.strip(" ") for _, _, x in rows if x.strip(" ")})
    sets = {i: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for i, x in enumerate(lines)}
    root, number = components_of(brute_edges(sets, 0.8)), {x: i for i, x in enumerate(lines)}
    first, gone = {}, collections.defaultdict(set)
    for doc, k, x in sorted(rows):
        if x.strip(" "):
            i = number[x.strip(" ")]
            if first.setdefault(root.get(i, i), (doc, k)) != (doc, k):
                gone[doc].add(k)
    got = {r["doc_id"]: r for r in line_dedup.drop_near_lines(docs).collect()}
    total = sum(map(len, gone.values()))
    wrong = sum(abs(len(gone[i]) - r["n_dropped"]) for i, r in got.items())
    assert total and wrong <= 0.02 * total
    for doc in list(got)[:50]:
        if len(gone[doc]) == got[doc]["n_dropped"]:
            assert got[doc]["text"] == "\n".join(x for d, k, x in rows if d == doc and k not in gone[doc])


def test_jaccards_equal_sets():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé€") for _ in range(rng.randrange(0, 60)))
    a = [word() for _ in range(20000)] + ["x" * 300_000]
    b = [x[: len(x) // 2] + word() if rng.random() < 0.7 else x for x in a[:-1]] + ["x" * 300_000]
    cut = lambda x: {x[k : k + 4] for k in range(max(1, len(x) - 3))} if x else set()
    got = line_dedup.jaccards(pa.array(a), pa.array(b), 4)
    want = [len(cut(x) & cut(y)) / max(1, len(cut(x) | cut(y))) for x, y in zip(a, b)]
    assert np.allclose(got, want)


def test_many_copies_are_one_in_the_buckets(spark, monkeypatch):
    """Hot documents and lines: what is banded doesn't grow with their copies."""
    seen = []
    real = near_dedup.near_components

    def counted(bands, *rest):
        seen.append(bands.count())
        return real(bands, *rest)

    monkeypatch.setattr(near_dedup, "near_components", counted)
    text = "one two three four five six seven eight nine ten"
    docs = docs_of(spark, [text] * 3000 + [text + " eleven", "Something else that no other text says here"])
    got = {r["id"]: r["root"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict.fromkeys(range(1, 3001), 0) and seen == [3 * near_dedup.BANDS]


def test_large_buckets_of_unlike_rows_are_compared_in_slices(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 7)
    bands = spark.createDataFrame([(k % 2, i) for i in range(60) for k in (i, 0)], "key long, id long")
    verify = lambda pairs: pairs.where("a % 10 = b % 10 AND a > 0")
    got = {r["id"]: r["root"] for r in common.near_components(bands, verify).collect()}
    assert got == components_of([(a, b) for a in range(1, 60) for b in range(a + 1, 60) if a % 10 == b % 10])


def test_char_shingles_count():
    raw = "abcdefghijé".encode()
    values, starts, count = kernels.char_shingles(np.frombuffer(raw, np.uint8), np.array([0, 3, 3, len(raw)]), 4)
    assert count.tolist() == [1, 0, 5] and len(values) == 6


def variants(seed, n, words, changed):
    """Copies of a passage, each with other words in so many places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    passage, out = [word() for _ in range(words)], []
    for _ in range(n):
        own = list(passage)
        for i in rng.sample(range(words), changed(rng)):
            own[i] = word()
        out.append(" ".join(own))
    return out


def chars(line, width=8):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def test_parities_bound_differences():
    lines = variants(5, 40, 60, lambda r: r.randint(0, 9)) + ["", "short", "eight ch", "é" * 30] + variants(6, 3, 900, lambda r: 200)
    sizes, bits = line_dedup.parities(pa.array(lines), 8)
    sets = [chars(x) if x else set() for x in lines]
    assert sizes.tolist() == [len(s) for s in sets]
    tight = 0
    for i in range(len(lines)):
        for j in range(i):
            turned, differ = int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum()), len(sets[i] ^ sets[j])
            assert turned <= differ
            tight += turned > 0.8 * differ
    assert tight > 300


@pytest.mark.parametrize("crowd", [None, 0])
def test_unlike_variants_need_no_comparison(spark, monkeypatch, crowd):
    """every two of these variants share bands, few are near."""
    if crowd is not None:
        monkeypatch.setattr(common, "CROWD", crowd)
    lines = sorted(set(variants(8, 120, 60, lambda r: r.choice([2, 6, 7, 8, 9]))))
    sizes, written = collections.defaultdict(list), common.written

    def counted(df, tag):
        out = written(df, tag)
        sizes[tag].append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    df = docs_of(spark, lines)
    all_lines, comp = line_dedup.line_components(df)
    text = {r["line"]: lines[r["doc_id"]] for r in all_lines.collect()}
    got = {text[r["id"]]: text[r["root"]] for r in comp.collect()}
    groups = collections.defaultdict(set)
    for x in lines:
        groups[got.get(x, x)].add(x)
    sets = [chars(x) for x in lines]
    roots = components_of([(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    want = collections.defaultdict(set)
    for i, x in enumerate(lines):
        want[roots.get(i, i)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert 1 < len(want) < len(lines)
    assert sizes["rest"][0] < 0.2 * len(lines) * (len(lines) - 1) / 2
    assert crowd is None or len(sizes["tried"]) >= 1


# 10


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000, 60000])
def test_filter_has_all_members(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    blob = exact_dedup.build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert exact_dedup.filter_contains(blob, keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert exact_dedup.filter_contains(blob, other).mean() < 0.01
    assert len(blob) <= 104 + 1.5 * n


def test_equal_digests_are_compared_by_text(spark, monkeypatch):
    rng = random.Random(8)
    texts = [rng.choice(["aa", "bb", "cc", f"t{i}"]) for i in range(400)]
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 3)
    got = sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs_of(spark, texts), keys_per_filter=2).collect())
    first = {}
    for i in sorted(range(400), key=lambda i: (i % 2, i)):
        first.setdefault(texts[i], i)
    assert got == sorted(first.values())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_more_generations(spark, limit):
    texts = [f"t{i % 50}" for i in range(300)]
    docs = docs_of(spark, texts).withColumn("batch", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7 * 3))
    for generation in (None, F.col("batch")):
        got = exact_dedup.drop_exact_duplicates(docs, generation, generations=5, keys_per_filter=8, filter_bytes=limit)
        assert got.count() == 50 and got.select("text").distinct().count() == 50
    first = {}
    for i in sorted(range(300), key=lambda i: (i % 7 * 3 or 99, i)):
        first.setdefault(texts[i], i)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_only_positives_pass_the_filters(spark, limit):
    digests = spark.createDataFrame([(g, i * 7919 + g * 10**12) for g in range(3) for i in range(3000)] + [(2, 0), (2, 7919)], "gen int, h long")
    filters = common.written(exact_dedup.snapshot_filters(digests, 500), "filters")
    assert filters.count() == 19
    passed = exact_dedup.screen(digests, filters, limit)
    rows = {(r["gen"], r["h"], r["known"]) for r in passed.collect()}
    assert {(2, 0, 0), (2, 7919, 0)} <= rows and len(rows) < 0.01 * 9000 + 2
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (limit == 0)


def test_batches_are_appended(spark, tmp_path):
    store, seen = str(tmp_path / "store"), set()
    for batch in (["a", "b", "a", None, ""], ["b", "c", "c", None], [], ["", "c", "d", "a" * 100_000], ["a" * 100_000, "e"]):
        got = exact_dedup.append(docs_of(spark, batch).withColumn("digest", F.lit(1)), store, keys_per_filter=2)
        texts = [r["text"] for r in got.collect()]
        assert got.columns[-1] == "digest" and sorted(x for x in texts if x is not None) == sorted(set(batch) - seen - {None})
        assert texts.count(None) == batch.count(None)
        seen |= set(batch) - {None}
    assert len(list((tmp_path / "store").glob("snapshot-*/_COMPLETE"))) == 5
