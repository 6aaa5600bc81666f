"""Operator 10, exact dedup against immutable snapshots behind static
binary-fuse filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import given, measured, unused, written

U64 = np.uint64
KEYS_PER_FILTER = 1 << 17
#: Filters of up to so many bytes in all are sent to every task.
FILTER_BYTES = 64 << 20
#: The generation of a row that names none.
LAST = 2**31 - 1


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + U64(seed)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _slots(h: np.ndarray, seg: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in three consecutive segments."""
    first = ((h >> U64(32)) * U64(segments * seg) >> U64(32)).astype(np.int64)
    mask = seg - 1
    one = (first + seg) ^ ((h >> U64(18)).astype(np.int64) & mask)
    two = (first + 2 * seg) ^ (h.astype(np.int64) & mask)
    return first, one, two


def build_filter(keys: np.ndarray) -> bytes:
    """Static binary-fuse filter (three-wise, 8-bit fingerprints) of keys; a
    header of three 64-bit numbers, then the fingerprints."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    seg = 1 << (max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))) if n > 1 else 2)
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) if n > 1 else 0
    segments = max(1, -(-int(room) // seg) - 2)
    for attempt in range(1, 1000):
        seed = (0x9E3779B97F4A7C15 * attempt) & (2**63 - 1)
        size = (segments + 2) * seg
        h = _mix(keys, seed)
        at = np.stack(_slots(h, seg, segments))
        order = _peel(at, size)
        if order is not None:
            break
        if attempt % 20 == 0:
            segments += max(1, segments // 10)
    else:
        raise RuntimeError("no filter found")
    table = np.zeros(size, np.uint8)
    mark = (h ^ (h >> U64(32))).astype(np.uint8)
    for which, slots in reversed(order):
        x, y, z = at[:, which]
        table[slots] = 0
        table[slots] = mark[which] ^ table[x] ^ table[y] ^ table[z]
    return np.array([seed, seg, segments], U64).tobytes() + table.tobytes()


def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Layers of keys that have a slot for themselves once the layers before
    them are gone; None if some keys never do."""
    n = at.shape[1]
    count = np.bincount(at.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    ids = np.arange(n)
    for row in at:
        np.bitwise_xor.at(held, row, ids)
    layers, left = [], n
    single = np.flatnonzero(count == 1)
    while len(single):
        which, first = np.unique(held[single], return_index=True)
        layers.append((which, single[first]))
        left -= len(which)
        touched = at[:, which]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(held, row, which)
        near = np.unique(touched)
        single = near[count[near] == 1]
    return layers if left == 0 else None


def filter_contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for a member."""
    seed, seg, segments = (int(x) for x in np.frombuffer(blob, U64, 3))
    table = np.frombuffer(blob, np.uint8, offset=24)
    h = _mix(keys.astype(U64), seed)
    x, y, z = _slots(h, seg, segments)
    return (h ^ (h >> U64(32))).astype(np.uint8) == table[x] ^ table[y] ^ table[z]


def _shard(digest: Column, shards: Column) -> Column:
    return F.pmod(F.shiftright(digest, 20), shards).cast("int")


def snapshot_filters(digests: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """(gen, shards, shard, filter): of each snapshot gen, one static filter for
    every shard of about so many of its distinct digests h."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        return pd.DataFrame({"gen": [row["gen"]], "shards": [row["shards"]], "shard": [row["shard"]], "filter": [build_filter(pdf["h"].to_numpy().view(U64))]})

    sizes = digests.groupBy("gen").agg(F.ceil(F.count("*") / keys_per_filter).cast("int").alias("shards"))
    keyed = digests.select("gen", "h").join(F.broadcast(sizes), "gen").withColumn("shard", _shard(F.col("h"), F.col("shards")))
    return keyed.groupBy("gen", "shard").applyInPandas(build, "gen int, shards int, shard int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """Of incoming (gen, h), the rows that a filter of an earlier snapshot lets
    through, with that snapshot's number: (gen, h, known).

    filters: a written table. While they take at most limit bytes in all, every
    task has them and nothing is shuffled but, later, the rows that pass; beyond
    it, digests meet their shard's filter by a shuffle. The rows are the same.
    """
    size = filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
    if size <= limit:
        known: dict[int, dict[int, bytes]] = {}
        shards: dict[int, int] = {}
        for r in filters.collect():
            known.setdefault(r["gen"], {})[r["shard"]] = bytes(r["filter"])
            shards[r["gen"]] = r["shards"]
        sent = incoming.sparkSession.sparkContext.broadcast((known, shards))

        def look(batches):
            known, shards = sent.value
            for batch in batches:
                gen, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for g in sorted(known):
                    rows = np.flatnonzero(gen > g)
                    at = (h[rows] >> 20) % shards[g]
                    for shard in np.unique(at).tolist():
                        blob = known[g].get(shard)
                        if blob is not None:
                            mine = rows[at == shard]
                            mine = mine[filter_contains(blob, h[mine].view(U64))]
                            if len(mine):
                                yield pa.RecordBatch.from_arrays([pa.array(gen[mine]), pa.array(h[mine]), pa.array(np.full(len(mine), g, np.int32))], ["gen", "h", "known"])

        return incoming.select("gen", "h").mapInArrow(look, "gen int, h long, known int")

    def meet(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(new):
            return pd.DataFrame({"gen": [], "h": [], "known": []}).astype({"gen": "int32", "h": "int64", "known": "int32"})
        out = new[filter_contains(known["filter"].iloc[0], new["h"].to_numpy().view(U64))]
        return pd.DataFrame({"gen": out["gen"], "h": out["h"], "known": known["gen"].iloc[0]})

    sizes = filters.groupBy(F.col("gen").alias("known")).agg(F.first("shards").alias("shards"))
    left = incoming.select("gen", "h").join(F.broadcast(sizes), F.col("gen") > F.col("known")).withColumn("shard", _shard(F.col("h"), F.col("shards")))
    right = filters.withColumn("known", F.col("gen"))
    return left.groupBy("known", "shard").cogroup(right.groupBy("known", "shard")).applyInPandas(meet, "gen int, h long, known int")


def digest(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def drop_exact_duplicates(docs: DataFrame, generation: Column | None = None, generations: int = 2, keys_per_filter: int = KEYS_PER_FILTER, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs with one row of each distinct text; columns as given, whatever
    their names.

    Documents arrive in generations, in the order of any integer column (by
    default doc_id modulo `generations`); a null comes last. Each generation's
    distinct digests are an immutable snapshot with static filters of its own,
    both written. A generation's digests are screened by the filters of the
    snapshots before it; positives are looked up in these snapshots' exact
    digests, and copies within the generation are grouped apart. Where digests
    agree the texts themselves are compared, whole and of any length. The row
    that stays is of the earliest generation, then of the least doc_id (null
    last); of rows equal in both, the least by lang, source and n_chars as text
    where there are such columns, and any of wholly equal rows.

    A null text is no text: such rows all stay. An empty text is a text. An
    empty table stays empty.
    """
    number = generation if generation is not None else F.abs(F.col("doc_id") % generations)
    gen, h, rank, known = unused(docs.columns, "gen", "digest", "rank", "known")
    keyed = docs.withColumns({h: digest(F.col("text")), gen: F.coalesce(number.cast("int"), F.lit(LAST))})
    held = keyed.where("text IS NOT NULL").groupBy(F.col(gen).alias("gen"), F.col(h).alias("h")).agg(F.count("*").alias("n"))
    digests = written(held, "digests")
    filters = written(snapshot_filters(digests, keys_per_filter), "filters")
    passed = screen(digests, filters, filter_bytes)
    exact = digests.select(F.col("gen").alias("known"), "h")
    twice = digests.where("n > 1").select("h").unionByName(passed.join(exact, ["known", "h"], "left_semi").select("h"))
    marked = measured(written(twice.distinct().select(F.col("h").alias(known)), "twice"))
    alone = keyed.join(marked, F.col("text").isNotNull() & (F.col(h) == F.col(known)), "left_anti")
    alike = keyed.where("text IS NOT NULL").join(marked, F.col(h) == F.col(known), "left_semi")
    return alone.select(*given(docs.columns)).unionByName(_firsts(alike, docs.columns, h, [F.col(gen).asc()], rank))


def _firsts(alike: DataFrame, columns: list[str], h: str, before: list[Column], rank: str) -> DataFrame:
    more = [F.col(c).cast("string").asc_nulls_last() for c in ("lang", "source", "n_chars") if c in columns]
    first = Window.partitionBy(h, F.col("text").cast("string")).orderBy(*before, F.col("doc_id").asc_nulls_last(), *more)
    return alike.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*given(columns))


def append(batch: DataFrame, store: str, keys_per_filter: int = KEYS_PER_FILTER, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of a batch (as of drop_exact_duplicates) whose texts the store
    doesn't hold; they become its next snapshot, an immutable folder of rows,
    digests and filters, which is read only when its _COMPLETE mark is there.

    Only the batch's digests that pass a snapshot's filter are looked up in
    that snapshot, and only texts with a known digest are compared with its
    rows. Rows with a null text are always new. A batch's columns must be those
    of the first one; an empty batch makes an empty snapshot. One batch is
    appended at a time; what a failed append left is overwritten by the next.
    """
    spark = batch.sparkSession
    fs, path = _files(spark, store)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(store))) if fs.exists(path(store)) else []
    done = [x for x in names if x.startswith("snapshot-") and fs.exists(path(f"{store}/{x}/_COMPLETE"))]
    old = [spark.read.parquet(f"{store}/{x}/filters").withColumn("gen", F.lit(k).cast("int")) for k, x in enumerate(done)]
    h, rank, known = unused(batch.columns, "digest", "rank", "known")
    keyed = written(batch.withColumn(h, digest(F.col("text"))), "batch")
    firsts = _firsts(keyed.where("text IS NOT NULL"), batch.columns, h, [], rank).unionByName(keyed.where("text IS NULL").select(*given(batch.columns)))
    fresh = firsts
    if done:
        filters = written(reduce(DataFrame.unionByName, old), "filters")
        coming = keyed.where("text IS NOT NULL").select(F.lit(len(done)).cast("int").alias("gen"), F.col(h).alias("h")).distinct()
        passed = written(screen(coming, filters, filter_bytes), "passed")
        held = []
        for k, x in enumerate(done):
            mine = passed.where(F.col("known") == k).select("h")
            hits = written(spark.read.parquet(f"{store}/{x}/digests").join(measured(mine), "h", "left_semi").select("h"), "hits")
            rows = spark.read.parquet(f"{store}/{x}/rows").where("text IS NOT NULL").select(F.col("text").cast("string").alias(known))
            held.append(rows.join(measured(hits), digest(F.col(known)) == F.col("h"), "left_semi"))
        texts = reduce(DataFrame.unionByName, held).withColumn(h, digest(F.col(known)))
        fresh = firsts.withColumn(rank, digest(F.col("text"))).join(texts, (F.col(rank) == F.col(h)) & (F.col("text").cast("string") == F.col(known)), "left_anti").select(*given(batch.columns))
    name = f"{store}/snapshot-{len(done):06d}"
    fresh.write.mode("overwrite").parquet(f"{name}/rows")
    rows = spark.read.schema(fresh.schema).parquet(f"{name}/rows")
    rows.where("text IS NOT NULL").select(F.lit(0).alias("gen"), digest(F.col("text")).alias("h")).distinct().write.mode("overwrite").parquet(f"{name}/digests")
    snapshot_filters(spark.read.parquet(f"{name}/digests"), keys_per_filter).write.mode("overwrite").parquet(f"{name}/filters")
    fs.create(path(f"{name}/_COMPLETE"), True).close()
    return rows


def _files(spark: SparkSession, store: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
