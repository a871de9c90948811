"""Connected components of a graph of links, as joins and aggregations.

Large-star and small-star steps in turn (Kiveris et al., 2014): every round links nodes to the
smallest node they can see, until each component is a star around its smallest node. Links and the
smallest neighbours stay in tables, so a node with very many links is split by Spark as a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller node at most, and none that has one is another's."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.filter("below > 1 OR below > 0 AND above > 0").isEmpty()


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = scratch.put(least, "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = scratch.put(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _kept(edges: DataFrame, scratch: Scratch, inner: Scratch) -> DataFrame:
    out = scratch.put(edges, "stars")
    inner.clear()
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node with a link, as a table; the label is the smallest node of its component.

    ``links``: two columns of the same type, in any direction; nulls and loops are ignored.
    """
    inner = Scratch(scratch.spark)
    edges = _kept(_small_star(links.toDF("u", "v").filter("u <> v"), inner), scratch, inner)
    while not _are_stars(edges):
        last, edges = edges, _kept(_small_star(inner.put(_large_star(edges, inner), "larger"), inner), scratch, inner)
        scratch.drop(last)
    roots = edges.select("v").distinct()
    out = scratch.put(edges.toDF("node", "label").union(roots.select(F.col("v").alias("node"), F.col("v").alias("label"))), "labels")
    scratch.drop(edges)
    return out
