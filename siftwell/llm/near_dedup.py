"""Operator 8, MinHash near-dedup with fast similarity sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import measured, near_components, unused, written

WIDTH, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
PIECE = 1 << 20
#: What a text must hold to be compared.
WORD = r"[0-9a-z]|[^\x00-\x7f]"


def _sketches(width: int, bands: int, rows: int):
    """(id, keys) of (id, text): a key per band; texts without a word have none."""

    def run(batches):
        for batch in batches:
            raw, off = K.string_buffers(pc.utf8_lower(batch.column(1)))
            ids = batch.column(0)
            for i, j in K.pieces(off, PIECE):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                values, row = K.word_shingles(part, at, width)
                keys = K.band_keys(K.fast_sketch(values, row, j - i, bands * rows), bands)
                keep = np.flatnonzero(np.bincount(row, minlength=j - i) > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys[keep].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(keep)), lists], ["id", "keys"])

    return run


def _sets(width: int):
    """(id, print, grams) of (id, print, text): the sorted distinct shingles."""

    def run(batches):
        for batch in batches:
            raw, off = K.string_buffers(pc.utf8_lower(batch.column(2)))
            for i, j in K.pieces(off, PIECE):
                values, row = K.word_shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sets, pa.binary())], ["id", "print", "grams"])

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root): every document that is a near copy, and the least doc_id of
    its group. Near: Jaccard similarity of the sets of width-word shingles of
    at least threshold, which counts as near (ties are in); groups are the
    connected components.

    Texts that are equal but for case (by SHA-256) are grouped first, and only
    the row of least doc_id of each is sketched, so that a text with very many
    copies is one in every bucket. Sketch coordinates collide with a
    probability equal to the similarity, so a pair at the threshold shares one
    of 40 bands of 4 with 0.92, at 0.6 with 0.996. Shared bands are verified
    exactly on the full sets, whatever the texts' length.

    Rows with a null doc_id or a null text, and texts without a word, are not
    compared. Rows that repeat a doc_id are one document, near to what any of
    its texts is near to. An empty table has no groups; other columns than
    doc_id and text aren't read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    base = base.where(F.lower("text").rlike(WORD)).withColumn("print", F.unhex(F.sha2(F.lower("text"), 256)))
    prints = base.select("id", "print")
    copied = prints.groupBy("print").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = written(prints.join(measured(written(copied.select("print", "lead"), "copied")), "print").distinct(), "copies")
    spare = written(copies.where("id <> lead").select("id", "print"), "spare")
    first = base.join(measured(spare), ["id", "print"], "left_anti")
    keys = written(first.select("id", "text").mapInArrow(_sketches(width, bands, rows), "id long, keys array<long>"), "sketches")

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([K.overlap(x, y) for x, y in zip(_views(a), _views(b))], pa.float64())

    def verify(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets = first.select("id", "print", "text").join(measured(ids), "id", "left_semi").mapInArrow(_sets(width), "id long, print binary, grams binary")
        sets = written(sets.groupBy("id", "print").agg(F.max("grams").alias("grams")).select("id", "grams"), "sets")
        left, right = sets.withColumnsRenamed({"id": "a", "grams": "ga"}), sets.withColumnsRenamed({"id": "b", "grams": "gb"})
        return pairs.join(left, "a").join(right, "b").where(jaccard("ga", "gb") >= threshold).select("a", "b").distinct()

    same = copies.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    return near_components(keys.select("id", F.explode("keys").alias("key")), verify, written(same, "same"))


def _views(x: pa.Array) -> list[memoryview]:
    """The values of a binary array, not copied."""
    x = x.cast(pa.large_binary())
    _, offsets, data = x.buffers()
    off = np.frombuffer(offsets, np.int64, len(x) + 1, x.offset * 8).tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(off[:-1], off[1:])]


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """docs without all but one (the least doc_id) of every group of near
    copies; all columns as given, whatever their names. Rows that are not
    compared (null doc_id or text, no word) stay, and rows that repeat a doc_id
    stay or go together. An empty table stays empty; texts of any length are
    compared whole. Ties and parameters as of near_duplicates()."""
    (gone,) = unused(docs.columns, "gone")
    out = written(near_duplicates(docs, **params).select(F.col("id").alias(gone)), "gone")
    return docs.join(measured(out), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
