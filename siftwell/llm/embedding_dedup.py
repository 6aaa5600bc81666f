"""Operator 1, embedding near-dedup by epsilon grid order join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, measured, unused, written

THRESHOLD, LEADING, BLOCK, LEAF = 0.95, 8, 4096, 512
#: Vectors of up to so many numbers have their whole covariance computed.
WHOLE = 1024
#: Parts of the grid order, of which every two that have near blocks are joined by one task: so many where there are as many
#: blocks, and more where one would hold more than so many bytes of vectors. A block is never larger than so many bytes.
PARTS, PART_BYTES, BLOCK_BYTES = 16, 8 << 20, 4 << 20
#: A task passes its near pairs on whenever it has so many.
PASSED = 1 << 20


def _unit(batch: pd.Series, dims: int, kind: type) -> np.ndarray:
    """Unit vectors of rows kept as bytes."""
    x = np.frombuffer(b"".join(batch), kind).reshape(-1, dims).astype(float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _packed(dims: int, kind: type):
    """Vectors as bytes, in the precision given; rows that have no direction are
    left out."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), dims)
                norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[good], "many": pdf["many"].to_numpy()[good], "v": [r.tobytes() for r in x[good].astype(kind)]})

    return run


def _axes(unit: DataFrame, dims: int, leading: int, number: type) -> np.ndarray:
    """The leading principal directions over all vectors. The driver receives a
    matrix from each group of partitions, not the vectors: of dims x dims, or,
    for long vectors, of dims x leading in each of three subspace iterations.
    Any orthonormal directions give the same pairs, these skip the most."""
    whole = dims <= WHOLE
    q = np.eye(dims) if whole else np.linalg.qr(np.random.default_rng(7).normal(size=(dims, leading)))[0]
    for _ in range(1 if whole else 3):
        got = _spread(unit, dims, q, number)
        if got is None:
            return q[:, :leading]
        mean, cov = got
        if whole:
            return np.linalg.eigh(cov - np.outer(mean, mean))[1][:, ::-1][:, :leading]
        q = np.linalg.qr(cov - np.outer(mean, mean @ q))[0]
    return q


def _spread(unit: DataFrame, dims: int, q: np.ndarray, number: type) -> tuple[np.ndarray, np.ndarray] | None:
    """The mean of all vectors x, and the mean of x (x q)."""
    width = q.shape[1]

    def sums(batches):
        n, s, c = 0, np.zeros(dims), np.zeros((dims, width))
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["v"], dims, number)
                n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ (x if width == dims else x @ q)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "c": [c.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(pdf["s"])).reshape(len(pdf), -1).sum(axis=0)
        c = np.frombuffer(b"".join(pdf["c"])).reshape(len(pdf), -1).sum(axis=0)
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "s": [s.tobytes()], "c": [c.tobytes()]})

    kind = "n long, s binary, c binary"
    parts = unit.mapInPandas(sums, kind)
    for fan in (256, 1):
        parts = parts.groupBy((F.xxhash64("s") % fan).alias("g")).applyInPandas(lambda pdf: add(pdf.sort_values("s")), kind)
    row = parts.first()
    return row and (np.frombuffer(row["s"]) / row["n"], np.frombuffer(row["c"]).reshape(dims, width) / row["n"])


def near_leaves(x: np.ndarray, zx: np.ndarray, y: np.ndarray, zy: np.ndarray, eps: float, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near rows of two sequences in grid order, by and by.
    Sequences whose boxes in the projection z are further apart than eps can't
    match; others are halved, down to leaves that are multiplied out in single
    precision; pairs within a margin of the threshold count as in double."""
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    dims = x.shape[1]
    margin, step = max(1e-4, 1.2e-7 * dims), max(1, (4 << 20) // dims)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a):
            continue
        gap = np.maximum(0, np.maximum(zx[a:b].min(axis=0) - zy[c:d].max(axis=0), zy[c:d].min(axis=0) - zx[a:b].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            cosine = (x4[a:b] @ y4[c:d].T).ravel()
            at = np.flatnonzero(cosine >= threshold - margin)
            i, j = at // (d - c) + a, at % (d - c) + c
            near = cosine[at] >= threshold + margin
            unsure = np.flatnonzero(~near)
            for k in range(0, len(unsure), step):
                u = unsure[k : k + step]
                near[u] = np.einsum("ij,ij->i", x[i[u]], y[j[u]]) >= threshold - 1e-9
            yield i[near], j[near]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def join_intervals(x: np.ndarray, zx: np.ndarray, y: np.ndarray, zy: np.ndarray, eps: float, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of near_leaves() at once."""
    found = list(near_leaves(x, zx, y, zy, eps, threshold, same))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: every pair of vectors with a cosine of at
    least threshold, found exactly.

    On unit vectors the cosine bounds the distance by eps = sqrt(2 - 2
    threshold). Cells of side eps on the leading principal directions give the
    epsilon grid order, in which the vectors are range partitioned and sorted;
    blocks of consecutive ones in a partition are joined with those that hold
    a neighbouring cell of the first two directions and whose boxes aren't
    further apart than eps, recursively, skipping halves that are. One task
    joins all such blocks of two partitions, so a block is sent to no more tasks
    than there are partitions, however many blocks are near to it, and passes
    pairs on as it finds them.

    Compared are vectors of one length, all their numbers, however many. A null
    id, a null, empty or zero vector and one with a null, NaN or infinite number
    match nothing. Wholly equal rows are one; an id doesn't match itself, and
    with several vectors it matches by any of them. A cosine that ties with the
    threshold, to 1e-9, is near. An empty table has no pairs; other columns than
    vec_id and embedding aren't read, whatever their names.
    """
    rows, several = _rows(vectors)
    pairs = _found(rows, vectors, threshold, leading, block, pairs_of, "id_a long, id_b long")
    return pairs.distinct() if several else pairs  # two rows meet once, so a pair comes again only by another vector of an id


def _rows(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """(id, v, many): the distinct vectors that can match something, and whether
    their id has several; and whether any has."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = written(rows.where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").distinct(), "vectors")
    several = written(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("many")), "several")
    if several.isEmpty():
        return rows.withColumn("many", F.lit(False)), False
    return written(rows.join(measured(several), "id", "left").withColumn("many", F.coalesce("many", F.lit(False))), "vectors"), True


def _found(rows: DataFrame, vectors: DataFrame, threshold: float, leading: int, block: int, give, schema: str) -> DataFrame:
    """What give makes of the near rows of every two partitions, of each length
    of vectors."""
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    out = vectors.sparkSession.createDataFrame([], schema)
    for dims in lengths:
        out = out.unionByName(_near_of_length(rows.where(F.size("v") == dims), dims, kind, threshold, min(leading, dims), block, give, schema))
    return out


def pairs_of(p: np.ndarray, q: np.ndarray, many: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id_a": np.minimum(p, q), "id_b": np.maximum(p, q)})


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with by edges (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def links_of(p: np.ndarray, q: np.ndarray, many: np.ndarray) -> pd.DataFrame:
    """Near pairs in short: of each id the number of its pairs (v is null), and
    pairs (n is null) that connect the same ids. Pairs of an id with several
    vectors may come again from others, so they are given as they are."""
    ids, at = np.unique(np.concatenate((p, q)), return_inverse=True)
    i, j = at[: len(p)], at[len(p) :]
    root = spanning(i, j, len(ids))
    number = np.bincount(np.concatenate((i[~many], j[~many])), minlength=len(ids))
    some, joined = np.flatnonzero(number), np.flatnonzero(root != np.arange(len(ids)))
    given = np.flatnonzero(many)
    u = np.concatenate((ids[some], ids[joined], np.minimum(p, q)[given]))
    v = [None] * len(some) + ids[root[joined]].tolist() + np.maximum(p, q)[given].tolist()
    n = number[some].tolist() + [None] * len(joined) + [-1] * len(given)
    return pd.DataFrame({"u": u.astype("int64"), "v": pd.array(v, "Int64"), "n": pd.array(n, "Int64")})


def _links(vectors: DataFrame, threshold: float = THRESHOLD, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    rows, _ = _rows(vectors)
    return written(_found(rows, vectors, threshold, leading, block, links_of, "u long, v long, n long"), "links")


def vector_classes(vectors: DataFrame, **params) -> DataFrame:
    """(vec_id, class_id, n_links), one row for each vec_id: the least vec_id of
    its connected group of near ones, and how many others are near to it itself.
    Parameters, and what is near, as of near_vectors(). All its pairs are found
    and counted, but tasks pass on numbers and connections, not the pairs, of
    which n near copies have n (n - 1) / 2. An id that matches nothing is a class
    of its own without links; a null one has no row. An empty table has none."""
    links = _links(vectors, **params)
    once = links.where("n = -1").select("u", "v").distinct()
    each = once.select(F.explode(F.array("u", "v")).alias("u"), F.lit(1).cast("long").alias("n"))
    number = written(links.where("v IS NULL").select("u", "n").unionByName(each).groupBy("u").agg(F.sum("n").alias("n")), "numbers")
    roots = components(links.where("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b")))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    out = ids.join(measured(number.withColumnRenamed("u", "vec_id")), "vec_id", "left").join(measured(roots.withColumnRenamed("id", "vec_id")), "vec_id", "left")
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("class_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"))


#: A block in one row: ids, marks and vectors as bytes, its box in the projection and its cells of the first two directions.
_BLOCK = "block long, ids binary, many binary, v binary, box array<struct<lo double, hi double>>, heads array<array<int>>"
_ARROW = pa.schema(
    [("block", pa.int64()), ("ids", pa.binary()), ("many", pa.binary()), ("v", pa.binary()), ("box", pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64())]))), ("heads", pa.list_(pa.list_(pa.int32())))]
)


def _blocks(block: int):
    """Runs of so many consecutive rows of a partition, each as a row, numbered
    from the partition's number << 32."""

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name: pa.concat_arrays([b.column(name) for b in held])
        rows = sum(b.num_rows for b in held)
        z, cell = (column(name).flatten().to_numpy().reshape(rows, -1) for name in ("z", "cell"))
        box = [{"lo": lo, "hi": hi} for lo, hi in zip(z.min(axis=0), z.max(axis=0))]
        ids, many = column("id").to_numpy(), column("many").to_numpy(zero_copy_only=False)
        row = {"block": number, "ids": ids.tobytes(), "many": many.tobytes(), "v": b"".join(column("v").to_pylist()), "box": box, "heads": np.unique(cell[:, :2], axis=0).tolist()}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    def run(batches):
        from pyspark import TaskContext

        number, held, room = TaskContext.get().partitionId() << 32, [], block
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                room -= held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if not room:
                    yield packed(number, held)
                    number, held, room = number + 1, [], block
        if held:
            yield packed(number, held)

    return run


def drop_near_vectors(vectors: DataFrame, **params) -> DataFrame:
    """vectors without all but one (the least vec_id) of every connected group
    of near ones; columns as given, whatever their names. Rows that match
    nothing stay, rows that repeat a vec_id stay or go together. An empty table
    stays empty. Parameters, and what is near, as of near_vectors()."""
    (gone,) = unused(vectors.columns, "gone")
    pairs = _links(vectors, **params).where("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))
    out = written(components(pairs).select(F.col("id").alias(gone)), "gone")
    return vectors.join(measured(out), F.col("vec_id").cast("long") == F.col(gone), "left_anti")


def _near_of_length(rows: DataFrame, dims: int, kind: type, threshold: float, leading: int, block: int, give, schema: str) -> DataFrame:
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    unit = written(rows.mapInPandas(_packed(dims, kind), "id long, many boolean, v binary"), "unit")
    number, width = unit.count(), dims * np.dtype(kind).itemsize
    block = max(1, min(block, BLOCK_BYTES // width))
    parts = max(1, min(PARTS, -(-number // block)), -(-number * width // PART_BYTES))
    axes = _axes(unit, dims, leading, kind)

    def projected(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(z=list(_unit(pdf["v"], dims, kind) @ axes))

    cells = [F.floor(F.col("z")[k] / eps).cast("int") for k in range(leading)]
    placed = unit.mapInPandas(projected, "id long, many boolean, v binary, z array<double>").withColumn("cell", F.array(*cells))
    order = [F.col("cell")[k] for k in range(leading)] + [F.col("id"), F.col("v")]
    sequence = written(placed, "placed").repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order)
    ordered = written(sequence.mapInArrow(_blocks(block), _BLOCK), "ordered")
    blocks = ordered.select("block", "box", "heads")
    near = [F.array(*(F.col("head")[k] + x for k, x in enumerate(d))) for d in itertools.product((-1, 0, 1), repeat=min(2, leading))]
    left = blocks.select(F.col("block").alias("a"), F.col("box").alias("ba"), F.explode("heads").alias("head")).select("a", "ba", F.explode(F.array(*near)).alias("near")).distinct()
    right = blocks.select(F.col("block").alias("b"), F.col("box").alias("bb"), F.explode("heads").alias("near"))
    gap = F.transform(F.arrays_zip("ba", "bb"), lambda x: F.greatest(F.lit(0.0), x["ba"]["lo"] - x["bb"]["hi"], x["bb"]["lo"] - x["ba"]["hi"]))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) > eps * eps
    pairs = written(left.join(right, "near").where((F.col("a") <= F.col("b")) & ~apart).select("a", "b").distinct(), "pairs")
    of = [F.shiftright(c, 32).alias(c) for c in ("a", "b")]
    second = F.when(F.shiftright("a", 32) == F.shiftright("b", 32), 0).otherwise(1)
    ends = written(pairs.select(*of, F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.select(*of, F.col("b").alias("block"), second.alias("side"))).distinct(), "ends")
    sent = ordered.select("block", "ids", "many", "v").join(measured(ends), "block")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("block")
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        sides = [pdf[pdf.side == k] for k in ((0,) if same else (0, 1))]
        x, y = (_unit(s["v"], dims, kind) for s in (sides[0], sides[-1]))
        ids, ids2 = (np.frombuffer(b"".join(s["ids"]), np.int64) for s in (sides[0], sides[-1]))
        many, many2 = (np.frombuffer(b"".join(s["many"]), bool) for s in (sides[0], sides[-1]))
        held, n = [], 0
        for i, j in itertools.chain(near_leaves(x, x @ axes, y, y @ axes, eps, threshold, same), [(None, None)]):
            if i is not None:
                ok = ids[i] != ids2[j]
                if same:
                    ok &= i < j
                i, j = i[ok], j[ok]
                held.append((ids[i], ids2[j], many[i] | many2[j]))
                n += len(i)
            if n >= PASSED or i is None and n:
                yield give(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0

    return sent.groupBy("a", "b").applyInPandas(match, schema)
