"""Shared pieces of the corpus operators: durable intermediate tables, joins
whose broadcast side is measured first, names that no column has, and
distributed union-find."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..sources.shared import clear_written, shared_dir, written  # noqa: F401

#: Largest side, in measured bytes, that is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Members of a bucket that one task compares with so many others of it.
SLICE = 1024
#: So many candidates for each row make rounds worthwhile, of which there are so many.
CROWD, ROUNDS = 4, 4


def _bytes(c: Column, kind: DataType) -> Column:
    """Bytes that a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return 16 + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)), F.lit(0))
        return 16 + 8 * F.coalesce(F.size(c), F.lit(0))
    if isinstance(kind, StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + _bytes(c.getField(f.name), f.dataType)
        return total
    return F.lit(8)


def measured(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """side (a written table) with a broadcast hint if its rows fit the limit;
    beyond it a shuffle join is left to the optimizer. Rows are counted from
    footers; only where so many could fit at all are their bytes added up."""
    if side.count() * (16 + 8 * len(side.columns)) > limit:
        return side
    if any(isinstance(f.dataType, (StringType, BinaryType, ArrayType, StructType)) for f in side.schema.fields):
        total = F.lit(16)
        for f in side.schema.fields:
            total = total + _bytes(F.col(quoted(f.name)), f.dataType)
        if (side.agg(F.sum(total.cast("long"))).first()[0] or 0) > limit:
            return side
    return F.broadcast(side)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def given(columns: list[str]) -> list[Column]:
    """The columns as they are, whatever characters their names have."""
    return [F.col(quoted(c)) for c in columns]


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name one like it that isn't among the columns (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def union_partition(batches):
    """Union-find over one partition's edges: emits a star per component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    pairs = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["u", "v"]).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root) for every node
    but the roots; a root is the least id of its component.

    Each partition first contracts its edges to stars; alternating large-star
    and small-star rounds then join the stars until every node has one edge,
    to a node that has none downward. Least neighbours are aggregated before
    the shuffle and joined back, so that a hub's edges needn't meet in a task.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    cur = written(e.mapInPandas(union_partition, "u long, v long").distinct(), "cc")
    while not _stars(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        cur = written(small.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "cc")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _stars(cur: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u."""
    sides = cur.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("s"))
    mixed = sides.groupBy("s.x").agg(F.sum("s.up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR (ups > 0 AND n > ups)")
    return mixed.isEmpty()


def near_components(
    bands: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    same: DataFrame | None = None,
    traits: Callable[[DataFrame], DataFrame] | None = None,
    differ: Callable[[str, str], tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Components of the verified near pairs among rows that share a band.

    bands: (key, id), one row per id and band, a table that can be read twice.
    verify: keeps, of pairs (a, b), those that are near. same: pairs (a, b) that
    are known to be near. Result as of components().
    traits: of rows with an id, one row (id, n, ...) for each id. differ: of the
    structs of two rows' traits, by their names, the number of differences that
    the rows have at least, and the most that near rows can have; a pair beyond
    it isn't near whatever verify says, so it needs no comparison.

    Every pair of ids in one bucket counts as a candidate. First each bucket's
    members are compared with its least id; then, of all pairs in a bucket,
    those whose ends are still in different components. A pair that is left
    out has its ends in one component already, so the components are those of
    all pairs, yet a bucket of n copies costs n - 1 comparisons. A bucket's
    ends are aggregated before the shuffle, its members joined to them, and
    the pairs of a large one are spread over slices of it. Where candidates
    are many, rounds compare each row with the one that differs least first,
    which leaves fewer in different components.
    """
    ends = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")).where("lead <> top").select("key", "lead")
    members = written(bands.join(measured(written(ends, "ends")), "key"), "buckets")
    star = written(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star")
    near = written(verify(star), "near")
    if same is not None:
        near = near.unionByName(same.select("a", "b"))
    comp = components(near)
    labelled = members.select("key", "id").distinct().join(measured(comp), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    labelled = written(labelled, "labelled")
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    mixed = labelled.join(split.select("key", slices.alias("slices")), "key").withColumn("s", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    mixed = written(mixed, "mixed")
    kept, found, far = [], [], F.lit(False)
    if traits is not None:
        known = written(traits(mixed.select("id").distinct()), "traits")
        mixed = mixed.join(measured(known), "id")
        kept = [F.struct(*(c for c in known.columns if c != "id")).alias("t_")]
        score, most = differ("tx", "ty")
        far = score > most
        found = [F.least("rx", "ry").alias("ra"), F.greatest("rx", "ry").alias("rb"), score.cast("int").alias("score")]
    x = mixed.select("key", F.col("id").alias("x"), F.col("root").alias("rx"), *(c.alias("tx") for c in kept), "s", F.explode(F.sequence("s", F.col("slices") - 1)).alias("t"))
    y = mixed.select("key", F.col("id").alias("y"), F.col("root").alias("ry"), *(c.alias("ty") for c in kept), F.col("s").alias("t"), F.explode(F.sequence(F.lit(0), "s")).alias("s"))
    rest = (
        x.join(y, ["key", "s", "t"])
        .where(F.expr("rx <> ry AND (s <> t OR x < y)") & ~far)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *found)
        .distinct()
        .join(measured(star), ["a", "b"], "left_anti")
    )
    rest, more = written(rest, "rest"), []
    for _ in range(ROUNDS if traits is not None else 0):
        if rest.count() <= CROWD * known.count():
            break
        best = rest.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "score").groupBy("id").agg(F.min(F.struct("score", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("m"))
        tried = written(best.select("m.a", "m.b").distinct(), "tried")
        more.append(written(verify(tried), "near"))
        joined = components(rest.join(measured(more[-1]), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        left = rest.join(measured(tried), ["a", "b"], "left_anti")
        for r in ("ra", "rb"):
            to = joined.select(F.col("id").alias(r), F.col("root").alias("to"))
            left = left.join(measured(to), r, "left").withColumn(r, F.coalesce("to", r)).drop("to")
        rest = written(left.where("ra <> rb"), "rest")
    more.append(written(verify(rest.select("a", "b")), "near"))
    more = [m for m in more if not m.isEmpty()]
    for m in more:
        near = near.unionByName(m)
    return components(near) if more else comp
