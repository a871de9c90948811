"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the mix over its share
of the documents. Every document gets a uniform number from a hash of the seed and its id;
the inverse of the Poisson distribution with its source's rate makes it a count. A
document is repeated that often, and all copies are put in the order of another hash,
a global shuffle that any run repeats exactly.

Only DataFrame functions: no Python on the way. The table of rates has a row for each
source, is aggregated map-side, and is broadcast only up to a checked number of rows.

Null is a source of its own. Sources without a target weight get ``default``; a weight of 0
removes a source. Documents with equal or null ids in one source share their count. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import materialize

from .common import free_name

#: Rates above this are drawn as a sum of several draws, as exp(-rate) must not vanish.
PART = 16
#: Terms of the distribution that are summed for a rate of PART at most; the rest is below 2**-52.
TERMS = 64
#: Sources up to which the table of rates is broadcast; beyond, Spark joins by key and splits skewed ones.
BROADCAST_SOURCES = 50_000


def uniform(seed: str, *keys: Column) -> Column:
    """52 bits of a hash as a number from 0 (inclusive) to 1."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("~")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def inverse_poisson(u: Column, rate: Column) -> Column:
    """The smallest n whose distribution function exceeds ``u``, for rates up to PART."""
    start = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("below"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        below = acc["below"] + acc["p"]
        return F.struct((acc["p"] * rate / k).alias("p"), below.alias("below"), (acc["n"] + F.when(below <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def poisson_count(seed: str, rate: Column, *keys: Column) -> Column:
    """A Poisson number with mean ``rate`` from a hash of the seed and the keys; 0 for a rate of 0 or null."""
    parts = F.ceil(rate / PART).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: inverse_poisson(uniform(seed, *keys, i), rate / parts))
    total = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    return F.when(rate > 0, total).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, power: float | None = None, size: float = 1.0, source: str = "source") -> DataFrame:
    """(source, n, rate) of every source.

    The share of a source in the mix is its weight over the sum of weights of the sources there
    are. With ``power`` given instead of weights, the weight is the number of documents to that
    power. ``size`` is the number of documents of the mix over that of the input.
    """
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if power is not None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.lit(float(default))
        for name, w in sorted((weights or {}).items()):
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighted = n.withColumn("weight", weight)
    # sums in decimals, so that their order makes no difference
    exact = F.col("weight").cast("decimal(38,6)")
    all_weight = weighted.agg(F.sum(exact).cast("double")).scalar()
    all_n = weighted.agg(F.sum("n")).scalar()
    share = F.when(all_weight > 0, exact.cast("double") / all_weight).otherwise(0.0)
    return weighted.select("source", "n", (F.lit(float(size)) * share * all_n / F.col("n")).alias("rate"))


def mix(docs: DataFrame, table: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """``docs`` repeated by count, with rate, copies (the count) and copy_no (from 0), in random order.

    ``table`` is a result of ``rates``. Columns of the three names are replaced.
    """
    made = ("rate", "copies", "copy_no")
    kept = [c for c in docs.columns if c.lower() not in made]
    name, rate = free_name(docs, "__source"), free_name(docs, "__rate")
    own = materialize(table.select(F.col("source").alias(name), F.col("rate").alias(rate)), "rates")
    if own.count() <= BROADCAST_SOURCES:
        own = F.broadcast(own)
    rated = docs.join(own, docs[source].eqNullSafe(own[name]), "left")
    key = F.col(doc_id)
    counted = rated.select(*kept, F.col(rate).alias("rate"), poisson_count(seed, F.col(rate), key).alias("copies")).filter("copies > 0")
    copies = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no"))
    if not shuffle:
        return copies.select(*kept, *made)
    place = free_name(copies, "__place")
    placed = copies.withColumn(place, F.xxhash64(F.lit(seed), F.lit("place"), key, F.col("copy_no")))
    return placed.repartitionByRange(place).sortWithinPartitions(place, key.asc_nulls_first(), "copy_no").select(*kept, *made)
