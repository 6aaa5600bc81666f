"""Operator 2, mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import given, measured, unused, written

TEMPERATURE, EPOCHS, SEED = 0.7, 1.0, "mix-1"


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of key."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Of rates (source, rate), adds cdf, the distribution function of
    Poisson(rate) at 0, 1, 2, ... as far as 40 + rate + 12 sqrt(rate), beyond
    which nothing is left of a double. Probabilities go through logarithms, so
    that no rate underflows, and are added up by a window within a source."""
    last = F.ceil(F.lit(40) + F.col("rate") + 12 * F.sqrt("rate")).cast("int")
    terms = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), F.when(F.col("rate") > 0, last).otherwise(0))).alias("k"))
    upto = Window.partitionBy("source", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto))
    summed = terms.withColumn("p", F.when(F.col("rate") > 0, p).otherwise(1.0)).withColumn("c", F.sum("p").over(upto))
    lists = summed.groupBy("source", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cdf"))
    return lists.select("source", "rate", F.col("cdf.c").alias("cdf"))


def source_rates(docs: DataFrame, weights: DataFrame | None, temperature: float, epochs: float) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its weight.
    Sizes are in characters over all documents. Without weights (source,
    weight), a source weighs its size to the power of temperature. A source
    that weights doesn't name gets none; one of size 0 has rate 1."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        named = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = written(sizes.select("source", "size", "weight"), "sizes")
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(epochs) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    return sizes.crossJoin(F.broadcast(total)).select("source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED, copy_column: str | None = None) -> DataFrame:
    """docs with each row repeated as its source's weight asks, in an order
    that is random over all sources; columns as given, whatever their names,
    and copy_column (0, 1, ...) if it is named (an existing column of that name
    is replaced).

    The count of a row inverts the Poisson distribution of its source's rate at
    a hash of seed and doc_id, so that it is the same wherever and whenever the
    row is read, and sums to the target in expectation. The distribution is
    looked up by a scan of about as many numbers as the row has copies, and at
    most some forty more. Copies move to a partition by a second hash and are
    sorted by it there; neighbouring rows are thus unrelated.

    A null source is a source. A null or empty text has size 0 but is repeated
    at its source's rate; a long one is repeated like any other. A null doc_id
    is replaced by the text in the hash; rows that repeat a doc_id, or are
    wholly equal, get the same count each (a tie at a step of the distribution
    counts as reached). An empty table stays empty.
    """
    known = docs.select(F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    label, cdf, number, copy, at = unused(docs.columns, "label", "cdf", "number", "copy", "at")
    table = written(poisson_table(source_rates(known, weights, temperature, epochs)), "rates").select(F.col("source").alias(label), F.col("cdf").alias(cdf))
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("")))
    joined = docs.join(measured(table), F.col("source").cast("string").eqNullSafe(F.col(label)))
    u = uniform(ident)
    counted = joined.withColumn(number, F.size(F.filter(cdf, lambda c: c <= u)))
    copies = counted.where(F.col(number) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(copy), F.when(F.col("doc_id").isNull(), F.col("text")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = copies.drop(label, cdf, number).withColumn(at, place).repartition(parts, at).sortWithinPartitions(at)
    more = [F.col(copy).alias(copy_column)] if copy_column else []
    return mixed.select(*given([c for c in docs.columns if c != copy_column]), *more)
