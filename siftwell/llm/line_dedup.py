"""Operator 9, fuzzy line dedup by MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import measured, near_components, quoted, unused, written

WIDTH, BANDS, ROWS, THRESHOLD = 8, 8, 4, 0.8
PIECE = 1 << 17
#: Bits of a hash that tell a pair's shingles apart, beside the pair's number.
BITS = 50
#: 64-bit words of a line's parities.
PARITIES = 16


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, line_no, line): the lines that hold more than space."""
    text = F.col("text").cast("string")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("tid"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", F.trim("line"))
        .where("line <> ''")
    )


def _signed(width: int, bands: int, rows: int):
    """Adds, to the first of each line in a batch, its band keys and leaves the
    line's words to that one only."""

    def run(batches):
        for batch in batches:
            line = batch.column(3).to_numpy()
            _, first = np.unique(line, return_index=True)
            first.sort()
            words = batch.column(4).take(pa.array(first))
            raw, off = K.string_buffers(words)
            keys = np.zeros((len(first), bands), np.int64)
            for i, j in K.pieces(off, PIECE):
                values, starts, count = K.char_shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                keys[i:j] = K.band_keys(K.minhash(values, starts, count, bands * rows), bands)
            ends = np.zeros(len(line) + 1, np.int32)
            ends[first + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel()))
            at = np.full(len(line), -1)
            at[first] = np.arange(len(first))
            once = words.take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists, once], ["doc_id", "tid", "line_no", "line", "keys", "words"])

    return run


def _sets(text: pa.Array, i: int, j: int, width: int) -> np.ndarray:
    """The sorted distinct shingles of rows i to j, in the upper bits each
    row's number."""
    raw, off = K.string_buffers(text.slice(i, j - i))
    values, _, count = K.char_shingles(raw, off, width)
    values >>= np.uint64(64 - BITS)
    values |= np.repeat(np.arange(j - i, dtype=np.uint64), count) << np.uint64(BITS)
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def jaccards(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of each pair of lines. Many
    pairs are sorted and intersected at once."""
    out = np.zeros(len(a))
    size = np.diff(K.string_buffers(a)[1]) + np.diff(K.string_buffers(b)[1])
    for i, j in K.pieces(np.r_[0, np.cumsum(size)], PIECE, 1 << (64 - BITS)):
        x, y = _sets(a, i, j, width), _sets(b, i, j, width)
        row = lambda v: np.bincount((v >> np.uint64(BITS)).astype(np.int64), minlength=j - i)  # noqa: E731, B023
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        common = row(both[1:][both[1:] == both[:-1]])
        out[i:j] = common / np.maximum(1, row(x) + row(y) - common)
    return out


def parities(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the size of its shingle set, and bits (rows x PARITIES): bit
    i is the parity of the number of its shingles that fall into cell i. As each
    shingle that only one of two lines has turns one bit, the lines have at
    least as many of those as bits that differ."""
    cells = 64 * PARITIES
    sizes, bits = np.zeros(len(text), np.int64), np.zeros((len(text), PARITIES), np.int64)
    for i, j in K.pieces(K.string_buffers(text)[1], PIECE, 1024):
        values = _sets(text, i, j, width)
        row = (values >> np.uint64(BITS)).astype(np.int64)
        sizes[i:j] = np.bincount(row, minlength=j - i)
        odd = np.bincount(row * cells + (values & np.uint64(cells - 1)).astype(np.int64), minlength=(j - i) * cells) & 1
        bits[i:j] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(j - i, PARITIES)
    return sizes, bits


def line_components(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, tid, line_no, line) and (id, root) of the near ones,
    where line, id and root are 64-bit hashes of trimmed lines."""
    named = _lines(docs).select("doc_id", "tid", "line_no", F.xxhash64("line").alias("line"), F.col("line").alias("words"))
    signed = written(named.mapInArrow(_signed(width, bands, rows), "doc_id long, tid long, line_no int, line long, keys array<long>, words string"), "lines")
    banded = signed.where(F.size("keys") > 0).select(F.col("line").alias("id"), F.explode("keys").alias("key"))
    names = [f"p{i}" for i in range(PARITIES)]

    def summed(batches):
        for batch in batches:
            sizes, bits = parities(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, np.ascontiguousarray(bits.T))], ["id", "n", *names])

    def traits(ids: DataFrame) -> DataFrame:
        return texts_of(written(ids, "ids")).mapInArrow(summed, "id long, n long, " + ", ".join(f"{p} long" for p in names))

    def differ(x: str, y: str) -> tuple[Column, Column]:
        # a Jaccard similarity of at least t leaves (1 - t) / (1 + t) of both sizes to differ, at most
        n = [F.col(f"{side}.n") for side in (x, y)]
        turned = [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in names]
        return F.greatest(F.abs(n[0] - n[1]), sum(turned[1:], turned[0])), (n[0] + n[1]) * ((1 - threshold) / (1 + threshold) + 1e-9)

    def texts_of(ids: DataFrame) -> DataFrame:
        texts = signed.where("words IS NOT NULL").select(F.col("line").alias("id"), "words").join(measured(ids), "id", "left_semi")
        return texts.groupBy("id").agg(F.min("words").alias("words"))

    jaccard = F.arrow_udf(lambda a, b: pa.array(jaccards(a, b, width)), "double")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = written(texts_of(ids), "texts")
        left, right = texts.withColumnsRenamed({"id": "a", "words": "wa"}), texts.withColumnsRenamed({"id": "b", "words": "wb"})
        return pairs.join(left, "a").join(right, "b").where(jaccard("wa", "wb") >= threshold).select("a", "b")

    return signed.drop("keys", "words"), near_components(banded, verify, traits=traits, differ=differ)


def drop_near_lines(docs: DataFrame, **params) -> DataFrame:
    """docs, their text without the lines that nearly repeat another, and with
    n_lines and n_dropped; other columns as given, whatever their names (an
    existing n_lines or n_dropped is replaced).

    Lines are parted by newlines and compared, whole and of any length, without
    the space around them; those of nothing else are left where they are. Near:
    Jaccard similarity of the sets of 8-character shingles of at least 0.8; a
    shorter line is its own shingle, so near only to itself. Groups are the
    connected components over the whole table. Of each, the line of the least
    (doc_id, line number) stays; of one place in two texts of a doc_id, the one
    of the text of least hash. A pair at the threshold shares one of 8 bands of
    4 with 0.985, at 0.9 with 0.9999; all pairs that share one are verified on
    the full sets, save those whose parities show that they differ by more than
    near lines can. Lines are told apart by a 64-bit hash, a pair's shingles by
    one of 50 bits.

    A row with a null doc_id or a null text is passed on as it is (its counts
    are null) and keeps others from nothing; an empty text has one line and
    loses none. Rows that repeat doc_id and text are one document; of rows that
    share only the doc_id each is judged by its own text. An empty table stays
    empty.
    """
    lines, comp = line_components(docs, **params)
    rooted = lines.join(measured(comp.withColumnRenamed("id", "line")), "line", "left").select("doc_id", "tid", "line_no", F.coalesce("root", "line").alias("root"))
    place = F.struct("doc_id", "line_no", "tid")
    keepers = rooted.groupBy("root").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep <> last").select("root", "keep")
    keepers = written(keepers, "keepers")
    doc, tid, gone = unused(docs.columns, "doc", "tid", "gone")
    dropped = (
        rooted.join(measured(keepers), "root")
        .where(place != F.col("keep"))
        .groupBy(F.col("doc_id").alias(doc), F.col("tid").alias(tid))
        .agg(F.collect_set("line_no").alias(gone))
    )
    text = F.col("text").cast("string")
    joined = docs.join(measured(written(dropped, "dropped")), (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(tid)), "left")
    return _without(joined, text, docs.columns, F.col(gone))


def _without(joined: DataFrame, text: Column, columns: list[str], gone: Column) -> DataFrame:
    parts = F.split(text, "\n")
    index = F.map_from_arrays(gone, gone)
    stay = F.array_join(F.filter(parts, lambda x, i: ~F.map_contains_key(index, i)), "\n")
    # few numbers are found faster in the array, many in a map; the rows are the same
    few = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    known = F.col("doc_id").isNotNull() & text.isNotNull()
    new = F.when(gone.isNull(), text).when(F.size(gone) <= 16, few).otherwise(stay)
    kept = [new.alias(c) if c == "text" else F.col(quoted(c)) for c in columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *kept,
        F.when(known, F.size(parts)).alias("n_lines"),
        F.when(known, F.coalesce(F.size(gone), F.lit(0))).alias("n_dropped"),
    )
