"""Class balance, temporal splits and score evaluation as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekeys import HOUR, epoch_seconds
from ..session import Scratch


def class_ratio(df: DataFrame, label: str = "target") -> DataFrame:
    """Negatives, positives and negatives per positive."""
    counted = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    return counted.withColumn("ratio", F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")))


def temporal_split(
    df: DataFrame, ts: str, ranges: Sequence[tuple[str, str, str]], gap_hours: int = 12, name: str = "split"
) -> DataFrame:
    """Add the split a row falls in; ``ranges`` are (name, start, end) and half-open.

    Later entries take precedence where ranges nest (a validation period within
    the training years). The last ``gap_hours`` before the end of a range, and
    before the start of a nested one, get null: their label looks across the
    border.
    """
    at = epoch_seconds(F.col(ts))
    bounds = [(n, _instant(s), _instant(e)) for n, s, e in ranges]
    gap = F.lit(gap_hours * HOUR)
    near = F.lit(False)
    for _, start, end in bounds:
        for edge in (start, end):
            near = near | ((at >= edge - gap) & (at < edge))
    split = F.lit(None).cast("string")
    for n, start, end in bounds:
        split = F.when((at >= start) & (at < end), F.lit(n)).otherwise(split)
    return df.withColumn(name, F.when(~near, split))


def time_folds(df: DataFrame, ts: str, folds: int, block_hours: int, gap_hours: int = 12, name: str = "fold") -> DataFrame:
    """Add the fold a row falls in: blocks of time in turn, so that neighbouring hours, which are much alike, are learned or tested together.

    The last ``gap_hours`` of a block get null, as their label looks into the next; so do rows without a time.
    """
    at, block = epoch_seconds(F.col(ts)), block_hours * HOUR
    fold = F.pmod(F.floor(at / F.lit(block)), F.lit(folds)).cast("int")
    return df.withColumn(name, F.when(F.pmod(at, F.lit(block)) < F.lit(block - gap_hours * HOUR), fold))


def _instant(text: str) -> Column:
    return F.unix_seconds(F.lit(text).cast("timestamp"))


def threshold_sweep(df: DataFrame, score: str, label: str, bins: int = 100) -> DataFrame:
    """Counts and F2 when everything scoring at least ``threshold`` is called positive.

    Rows are counted per score bin first, so the cumulative window sees at most
    ``bins`` rows however large the table. Scores lie in [0, 1]; those below count as 0, those above as 1. Rows with a
    null or NaN score belong to no threshold and are left out; ``score_report`` counts them.
    """
    bin_no = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * F.lit(bins)), F.lit(bins - 1))).cast("int")
    usable = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counted = usable.groupBy(bin_no.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    swept = counted.select(
        (F.col("bin").cast("double") / F.lit(float(bins))).alias("threshold"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(Window.partitionBy()).alias("positives"),
        F.sum("neg").over(Window.partitionBy()).alias("negatives"),
    )
    precision = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double"))
    swept = swept.withColumns({"precision": precision, "recall": recall})
    return swept.withColumn("f2", f2_score(F.col("precision"), F.col("recall")))


def score_report(df: DataFrame, score: str) -> DataFrame:
    """Number of rows by what their score is: usable, below 0, above 1, NaN or null."""
    s = F.col(score).cast("double")
    nan = F.coalesce(F.isnan(s), F.lit(False))
    return df.agg(
        F.count_if((s >= 0) & (s <= 1) & ~nan).alias("usable"),
        F.count_if((s < 0) & ~nan).alias("below"),
        F.count_if((s > 1) & ~nan).alias("above"),
        F.count_if(nan).alias("nan"),
        F.count_if(s.isNull()).alias("missing"),
    )


def f2_score(precision: Column, recall: Column) -> Column:
    """F measure that weighs recall four times as much as precision; 0 when both are 0."""
    value = F.try_divide(F.lit(5.0) * precision * recall, F.lit(4.0) * precision + recall)
    return F.coalesce(value, F.when(precision.isNotNull() & recall.isNotNull(), F.lit(0.0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the greatest F2, the higher one of equals."""
    return sweep.orderBy(F.desc_nulls_last("f2"), F.desc("threshold")).limit(1)


def pr_curve(sweep: DataFrame) -> DataFrame:
    """Points of the precision-recall and ROC curves, from strict to lenient."""
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double"))
    return sweep.select("threshold", "recall", "precision", F.col("recall").alias("tpr"), fpr.alias("fpr")).orderBy(
        F.desc("threshold")
    )


def score_levels(df: DataFrame, score: str, label: str, scratch: Scratch) -> DataFrame:
    """(score, pos, neg, neg_below) for each distinct score: its rows by label, and the negatives with a smaller one.

    Rows are counted by score first. The levels, as many as there are distinct scores, are put in order by ranges, a prefix sum runs inside
    each range, and only one total for each range passes through a single window. Null and NaN scores and other labels are left out.
    """
    value = F.col(score).cast("double")
    usable = df.filter(value.isNotNull() & ~F.isnan(value) & F.col(label).isin(0, 1))
    # -0.0 is 0.0
    levels = usable.groupBy((value + F.lit(0.0)).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # a table: the ranges must not be cut otherwise by a second run
    ranged = scratch.put(levels.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "levels")
    totals = ranged.groupBy("range").agg(F.sum("neg").alias("own"))
    totals = totals.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(F.broadcast(totals), "range").select("score", "pos", "neg", (F.col("before") + F.col("inside")).alias("neg_below"))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "target") -> float | None:
    """Area under the ROC curve over the distinct scores, see ``rank_auc``."""
    return rank_auc(scored, score, label).first()["auc"]


def rank_auc(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """One row (positives, negatives, auc): the share of pairs of a positive and a negative row that the score puts in order, ties counting half.

    Exact: whole numbers up to the last division. Null where one of the classes has no row.
    """
    scratch = Scratch(df.sparkSession)
    levels = score_levels(df, score, label, scratch)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ordered = F.sum(wide("pos") * (wide("neg_below") * 2 + wide("neg")))
    summed = levels.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), ordered.cast("double").alias("ordered"))
    out = scratch.put(summed, "auc")
    scratch.clear(out)
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double") * 2
    return out.select("positives", "negatives", F.try_divide("ordered", pairs).alias("auc"))


def confusion(df: DataFrame, by: Sequence[Column | str], predicted: str, actual: str) -> DataFrame:
    """True and false positives and negatives per group, with recall."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    counted = df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    return counted.withColumn("recall", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
