"""Operator 6, packing by cutting-stock column generation."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import measured, written
from .token_store import VOCABULARY, encoder, token_ids

CAPACITY, UNIT = 32768, 8
#: The linear program is solved to this share of its optimum.
TOLERANCE = 1e-3
GIVE = 4 << 20


def class_sizes(units: int) -> np.ndarray:
    """Upper bounds of the length classes, in units: every one up to 32, every
    fourth up to 128, every sixteenth beyond, and the capacity."""
    sizes = np.r_[np.arange(1, 33), np.arange(36, 129, 4), np.arange(144, units + 1, 16), units]
    return np.unique(sizes[sizes <= units])


def best_pattern(value: np.ndarray, sizes: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: how many items of each class
    fill the capacity of units at the greatest value. A class's rooms that are
    apart by its size form a chain, along which maxima accumulate."""
    best, stages = np.zeros(units + 1), []
    for k in np.flatnonzero(value > 0):
        s, v = int(sizes[k]), value[k]
        n = units // s + 1
        room = np.full(n * s, -np.inf)
        room[: units + 1] = best[: n * s]
        room = room.reshape(n, s)
        lift = np.arange(n)[:, None] * v
        reach = np.maximum.accumulate(room - lift, axis=0)
        after = best.copy()
        after[: n * s] = np.where(reach > room - lift + 1e-12, reach + lift, room).ravel()[: units + 1]
        stages.append((k, s, best, after))
        best = after
    counts, at = np.zeros(len(sizes), int), units
    for k, s, before, after in reversed(stages):
        while after[at] != before[at]:
            counts[k] += 1
            at -= s
    return float(best[units]), counts


def column_generation(demand: np.ndarray, sizes: np.ndarray, units: int, tolerance: float = TOLERANCE, rounds: int = 100000) -> list[tuple[np.ndarray, float]]:
    """Linear relaxation of cutting stock: patterns and how often each is used.

    Revised simplex on the classes that occur. The basis starts with one
    pattern per class, as many items as fit; the duals price the items, the
    knapsack finds the pattern of greatest value, and it enters unless its
    value is 1 + tolerance at most: the optimum is no less than the present
    number of packs divided by that value, nor less than the items' sizes fill.
    """
    some = np.flatnonzero(demand > 0)
    if not len(some):
        return []
    patterns = [np.zeros(len(sizes), int) for _ in some]
    for p, k in zip(patterns, some):
        p[k] = units // sizes[k]
    inverse = np.diag(1.0 / np.array([p[k] for p, k in zip(patterns, some)]))
    x = inverse @ demand[some].astype(float)
    least = float(demand @ sizes) / units
    for _ in range(rounds):
        if x.sum() <= least * (1 + tolerance):
            break
        dual = np.zeros(len(sizes))
        dual[some] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(dual, sizes, units)
        if worth <= 1 + tolerance:
            break
        move = inverse @ pattern[some]
        ratio = np.where(move > 1e-11, x / np.where(move > 1e-11, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        x = np.maximum(x - step * move, 0)
        x[out] = step
        patterns[out] = pattern
    else:
        logging.getLogger(__name__).warning("the linear program was left after %d rounds, before its optimum; the packs are valid", rounds)
    return list(zip(patterns, x))


def rounded_patterns(demand: np.ndarray, sizes: np.ndarray, units: int, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that meet the demand exactly: the linear solution rounded
    down, then what is left by first-fit decreasing on the classes."""
    left, plan = demand.astype(np.int64).copy(), []
    for pattern, x in column_generation(demand, sizes, units, tolerance):
        used = pattern > 0
        n = min(int(np.floor(x + 1e-9)), int((left[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern, n))
            left -= pattern * n
    bins: list[list] = []
    for k in range(len(sizes) - 1, -1, -1):
        size, count = int(sizes[k]), int(left[k])
        for b in bins:
            if count and b[0] >= size:
                n = min(count, b[0] // size)
                b[0] -= n * size
                b[1][k] += n
                count -= n
        while count:
            n = min(count, units // size)
            pattern = np.zeros(len(sizes), int)
            pattern[k] = n
            bins.append([units - n * size, pattern])
            count -= n
    merged: dict[bytes, list] = {}
    for _, pattern in bins:
        merged.setdefault(pattern.tobytes(), [pattern, 0])[1] += 1
    return plan + [(p, n) for p, n in merged.values()]


def _pieces(vocabulary: str, capacity: int, unit: int, sizes: np.ndarray):
    """(doc_id, piece, length, class, bucket, rn, ids) of (doc_id, text): bucket
    is the task that read the text, rn counts its pieces of the class."""

    def run(batches):
        from pyspark import TaskContext

        encode, kind, bucket = token_ids(vocabulary), id_type(vocabulary), TaskContext.get().partitionId()
        names = ["doc_id", "piece", "length", "class", "bucket", "rn", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        seen = [0] * len(sizes)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()).astype(kind)
                for k in range(-(-len(ids) // capacity)):
                    part = ids[k * capacity : (k + 1) * capacity]
                    c = int(np.searchsorted(sizes, -(-len(part) // unit)))
                    rows.append((doc_id, k, len(part), c, bucket, seen[c], part.tobytes()))
                    seen[c] += 1
                    size += len(part) * part.itemsize
                if size > GIVE:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def id_type(vocabulary: str) -> str:
    """How an id is kept: 16 bits little-endian, 32 for a vocabulary beyond."""
    return "<u2" if encoder(vocabulary).n_vocab <= 1 << 16 else "<u4"


def placements(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """The place of every piece of a document: (doc_id, piece, length, pack_id,
    class, rank, ids). In a pack pieces lie in order of class, downward, then of
    rank. What else holds see pack_documents()."""
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    units = capacity // unit
    sizes = class_sizes(units)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text <> ''")
    table = written(base.mapInArrow(_pieces(vocabulary, capacity, unit, sizes), "doc_id long, piece int, length int, class int, bucket int, rn long, ids binary"), "pieces")
    below = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(table.groupBy("class", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(below), F.lit(0))), "offsets")
    demand = np.zeros(len(sizes), np.int64)
    for row in offsets.groupBy("class").agg(F.sum("count").alias("n")).collect():
        demand[row["class"]] = row["n"]
    spans, taken, pack = [], np.zeros(len(sizes), np.int64), 0
    for pattern, n in rounded_patterns(demand, sizes, units):
        for k in np.flatnonzero(pattern):
            each = int(pattern[k])
            spans.append((int(k), int(taken[k]), int(taken[k]) + each * n, pack, each))
            taken[k] += each * n
        pack += n
    plan = docs.sparkSession.createDataFrame(spans, "class int, lo long, hi long, pack long, each int").groupBy("class").agg(F.collect_list(F.struct("lo", "hi", "pack", "each")).alias("spans"))
    return (
        table.join(measured(offsets.select("class", "bucket", "before")), ["class", "bucket"])
        .withColumn("rank", F.col("rn") + F.col("before"))
        .join(F.broadcast(plan), "class")
        .withColumn("span", F.filter("spans", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
        .select("doc_id", "piece", "length", F.expr("span.pack + (rank - span.lo) div span.each").alias("pack_id"), "class", "rank", "ids")
    )


def pack_documents(docs: DataFrame, **params) -> DataFrame:
    """Packs of at most capacity token ids, one row each: (pack_id, doc_ids,
    pieces, lengths, n_tokens, ids).

    ids are the pack's token ids as 16-bit little-endian numbers (32-bit ones
    for a vocabulary beyond 65536), document after document; doc_ids, pieces
    and lengths name its parts in that order, so that the sums of lengths are
    the boundaries. A document of more than capacity ids is cut into pieces of
    that many and a rest, numbered from 0. Lengths are counted in classes over
    all pieces, each class by its upper bound (multiples of 8 ids up to 256, of
    32 up to 1024, of 128 beyond); a linear program over that histogram is
    solved by column generation, its patterns are rounded, and each class's
    pieces, ranked by where they stand in docs, take the patterns' places in
    turn. The driver handles the histogram and the patterns only, whose size
    doesn't depend on the documents. A task numbers its pieces as it reads them,
    and ranks come from the tasks' counts, so that the ids are shuffled once, to
    their packs; another partitioning of docs ranks, and packs, otherwise.

    Texts that are null or empty hold no id and are in no pack. Rows that
    repeat a doc_id, wholly equal ones too, are packed each for itself; no two
    pieces tie in rank. A null doc_id is kept as null. An empty
    table gives no packs. Other columns aren't read, whatever their names.
    """
    piece = F.struct(-F.col("class"), "rank", "doc_id", "piece", "length", "ids")
    packs = placements(docs, **params).groupBy("pack_id").agg(F.array_sort(F.collect_list(piece), lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0)).alias("p"))
    return packs.select(
        "pack_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.length").alias("lengths"),
        F.aggregate("p.length", F.lit(0), lambda s, n: s + n).alias("n_tokens"), F.unhex(F.array_join(F.transform("p.ids", F.hex), "")).alias("ids"),
    )


def _before(a, b):
    return (a["col1"] < b["col1"]) | ((a["col1"] == b["col1"]) & (a["rank"] < b["rank"]))
