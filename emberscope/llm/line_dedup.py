"""Line dedup by the number of distinct sites a line is seen on.

One HyperLogLog sketch of sites for each line; sketches merge by aggregation, map-side
first, so a line on a third of all documents costs one sketch in each task. A line whose
estimate is far from the threshold is decided by it; lines near the threshold get an
exact distinct count. Lines on at least ``min_sites`` sites are boilerplate and are
removed wherever they stand.

Only DataFrame functions: no Python on the way.

Lines are split at ``\\n`` and compared after trimming spaces and tabs; empty lines are
kept and never counted. A null text stays null with no lines, an empty text has one
empty line. A null site is no site. Repeated rows count as often as their distinct sites.
Rows with the same or a null document id keep their own texts, as the decision belongs
to the line and not to the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import free_name

LG_K = 10
#: Relative distance from the threshold within which an estimate is not trusted:
#: over six times the sketch's standard error of 1.04 / sqrt(2**LG_K).
MARGIN = 0.25


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line; null for an empty line."""
    bare = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(bare != "", F.md5(bare.cast("binary")))


def spread_lines(docs: DataFrame, min_sites: int, text: str = "text", site: str = "site") -> DataFrame:
    """Boilerplate lines: (line, sites), with the exact or a safe estimated number of sites."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(site).cast("string").alias("site"), F.explode(lines_of(F.col(text))).alias("line"))
    rows = rows.select("site", line_key(F.col("line")).alias("line")).filter(F.col("line").isNotNull() & F.col("site").isNotNull())
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    guess = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    guess = guess.filter(F.col("sites") >= low)
    guess = scratch.put(guess, "guess")
    near = guess.filter(F.col("sites") <= high).select("line")
    pairs = rows.join(near, "line", "left_semi").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    # tables of their own: Spark can split a hot line in the joins with them
    spread = scratch.put(guess.filter(F.col("sites") > high).unionByName(exact), "spread")
    scratch.clear(spread)
    return spread


def remove_lines(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "site", key: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and n_lines and n_removed.

    Columns of these two names are replaced. ``key`` links a document to its
    lines; rows that share a key must not share removed places, so the row's own
    text hash goes with it.
    """
    made = ("n_lines", "n_removed")
    kept = [c for c in docs.columns if c.lower() not in made]
    own, places = free_name(docs, "__row"), free_name(docs, "__places")
    base = docs.select(*kept, F.struct(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("text")).alias(own))
    spread = spread_lines(docs, min_sites, text, site)
    rows = base.select(F.col(own).alias("row"), F.posexplode(lines_of(F.col(text))).alias("place", "line"))
    rows = rows.select("row", "place", line_key(F.col("line")).alias("line")).filter(F.col("line").isNotNull())
    gone = rows.join(spread.select("line"), "line", "left_semi").groupBy("row").agg(F.collect_set("place").alias(places))
    # a null key equals a null key here
    joined = base.join(gone, base[own].eqNullSafe(gone["row"]), "left").drop("row")
    lines, out = lines_of(F.col(text)), F.coalesce(F.col(places), F.array().cast("array<int>"))
    rest = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: ~F.array_contains(out, x["i"]))
    new_text = F.when(F.size(out) == 0, F.col(text)).otherwise(F.array_join(rest["line"], "\n"))
    # counted before the text is replaced
    counted = joined.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.size(out).cast("long")})
    return counted.withColumn(text, new_text).select(*kept, *made)
