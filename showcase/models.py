"""Training, scoring and evaluation of models on six-hour blocks of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.operators.evaluation import best_threshold, pr_curve, rank_auc, temporal_split, threshold_sweep, time_folds
from emberscope.operators.modeling import feature_importance, filled, fit_boosted, fit_forest, fit_margin, fold_sweep, score
from emberscope.plans.features import training_table

from .base import complete_gold, plain, query, table, with_sql
from .joins import neighbour_links
from .series import _HORIZON

KEYS = ["grid_id", "last_hour"]
FEATURES = [
    "temperature_2m",
    "precipitation",
    "temperature_2m_delta",
    "temperature_2m_lag_24h",
    "precipitation_sum_96h",
    "temperature_2m_mean_48h",
    "dry_hours",
    "temperature_near",
    "fires_near",
    "hour_sin",
    "hour_cos",
]
RANGES = [("train", "2024-01-01", "2024-01-22"), ("validation", "2024-01-16", "2024-01-22"), ("test", "2024-01-22", "2024-02-01")]
WEIGHTS, FOLDS, FOLD_HOURS = [1.0, 10.0], 3, 96
TREES, DEPTH = 10, 4

# What a model gives is not for SQL to know; which rows it learns and judges, and that it judges all of them, is.
_ROWS = f"""
  SELECT grid_id, timestamp_clima AS last_hour, target_ahead AS target,
         CASE WHEN timestamp_clima >= TIMESTAMP '2024-01-22' AND timestamp_clima < TIMESTAMP '2024-01-31 12:00:00' THEN 'test'
              WHEN timestamp_clima >= TIMESTAMP '2024-01-16' AND timestamp_clima < TIMESTAMP '2024-01-21 12:00:00' THEN 'validation'
              WHEN timestamp_clima >= TIMESTAMP '2024-01-01' AND timestamp_clima < TIMESTAMP '2024-01-15 12:00:00' THEN 'train' END AS split
  FROM (SELECT grid_id, timestamp_clima, {_HORIZON} AS target_ahead FROM complete_gold)
  WHERE hour(timestamp_clima) % 6 = 5 AND target_ahead IS NOT NULL"""


def model_rows(spark, sf_dir):
    """The training table's rows that have a label, with their split by time; ``last_hour`` is a block's last hour."""
    links = neighbour_links(spark, sf_dir)
    built = training_table(complete_gold(spark, sf_dir), links, link_rows=2 * links.count())
    rows = filled(built.filter(F.col("target_ahead").isNotNull()), FEATURES)
    rows = rows.select("grid_id", (F.col("block_start") + F.expr("INTERVAL 5 HOURS")).alias("last_hour"), F.col("target_ahead").alias("target"), *FEATURES)
    return temporal_split(rows, "last_hour", RANGES)


def _parts(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return [rows.filter(F.col("split") == s) for s in ("train", "validation", "test")]


def _judged(column="score"):
    return F.coalesce(F.col(column).between(0, 1), F.lit(False)).alias("judged")


@query(with_sql("complete_gold", "SELECT grid_id, last_hour, target, split FROM rows", rows=_ROWS))
def model_splits(spark, sf_dir):
    """Rows and labels of the model, and the part of the time they fall in."""
    return plain(model_rows(spark, sf_dir).select(*KEYS, "target", "split"))


@query(
    with_sql(
        "complete_gold",
        f"""SELECT grid_id, last_hour, CASE WHEN CAST(epoch(last_hour) AS BIGINT) % {FOLD_HOURS * 3600} < {(FOLD_HOURS - 12) * 3600}
  THEN CAST(CAST(epoch(last_hour) AS BIGINT) // {FOLD_HOURS * 3600} % {FOLDS} AS INTEGER) END AS fold FROM rows""",
        rows=_ROWS,
    )
)
def model_folds(spark, sf_dir):
    """The same rows in blocks of four days, dealt to three folds in turn."""
    return plain(time_folds(model_rows(spark, sf_dir), "last_hour", FOLDS, FOLD_HOURS).select(*KEYS, "fold"))


@query(with_sql("complete_gold", "SELECT grid_id, last_hour, target, true AS judged FROM rows WHERE split = 'test'", rows=_ROWS), name="forest_fit")
def forest_scores(spark, sf_dir):
    """Every row of the test part with a probability from a forest that learned on the train part."""
    train, _, test = _parts(spark, sf_dir)
    model = fit_forest(train, FEATURES, positive_weight=10.0, trees=TREES, depth=DEPTH)
    return plain(score(model, test).select(*KEYS, "target", _judged()))


@query(
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in sorted(FEATURES)) + "]) AS feature, true AS share, CAST(1 AS DOUBLE) AS total FROM (SELECT count(*) AS n FROM events) WHERE n > 0"
)
def forest_importance(spark, sf_dir):
    """Every feature once, with a share from 0 to 1; all shares together are 1."""
    train, _, _ = _parts(spark, sf_dir)
    shares = feature_importance(fit_forest(train, FEATURES, positive_weight=10.0, trees=TREES, depth=DEPTH), spark)
    total = shares.agg(F.round(F.sum("importance"), 9)).scalar()
    return shares.select("feature", F.col("importance").between(0, 1).alias("share"), total.alias("total"))


@query(
    with_sql(
        "complete_gold",
        """SELECT count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 0) AS negatives,
       count(*) AS lowest, true AS falling, true AS area, true AS best FROM rows WHERE split = 'test'""",
        rows=_ROWS,
    )
)
def forest_evaluation(spark, sf_dir):
    """The forest on the test part: every row is above the lowest threshold, counts fall as it rises, the exact area and the best F2 lie in 0 to 1.

    The curve's own area, by trapezoids over its thresholds, is near the exact one.
    """
    train, _, test = _parts(spark, sf_dir)
    scored = score(fit_forest(train, FEATURES, positive_weight=10.0, trees=TREES, depth=DEPTH), test)
    sweep = threshold_sweep(scored, "score", "target")
    points = pr_curve(sweep).collect()  # at most a hundred
    area = sum((b.tpr + a.tpr) / 2 * (b.fpr - a.fpr) for a, b in zip(points, points[1:], strict=False)) + points[0].tpr * points[0].fpr / 2
    lowest = sweep.agg((F.max("tp") + F.max("fp")).alias("n")).scalar()
    best = best_threshold(sweep).select("f2").scalar()
    falling = all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(points, points[1:], strict=False))
    auc = F.col("auc")
    return rank_auc(scored).select(
        "positives",
        "negatives",
        lowest.alias("lowest"),
        F.lit(falling).alias("falling"),
        (auc.between(0, 1) & (F.abs(auc - F.lit(area)) < 0.05)).alias("area"),
        best.between(0, 1).alias("best"),
    )


@query(
    f"""SELECT unnest({WEIGHTS}::DOUBLE[]) AS positive_weight, fold, true AS judged
FROM (SELECT unnest(generate_series(0, {FOLDS - 1}))::INTEGER AS fold FROM (SELECT count(*) AS n FROM events) WHERE n > 0)""",
    name="weight_sweep",
)
def weights(spark, sf_dir):
    """A forest for each weight of the positive class and each fold of the time before the test, with its best threshold."""
    rows = model_rows(spark, sf_dir).filter("split <=> 'train' OR split <=> 'validation'")
    swept = fold_sweep(time_folds(rows, "last_hour", FOLDS, FOLD_HOURS), FEATURES, "target", "fold", WEIGHTS, trees=TREES, depth=DEPTH)
    return swept.select("positive_weight", "fold", _judged("f2"))


@query(
    with_sql(
        "complete_gold",
        "SELECT grid_id, last_hour, unnest(['margin', 'boosted']) AS model, true AS judged FROM rows WHERE split = 'test'",
        rows=_ROWS,
    )
)
def margin_and_boost(spark, sf_dir):
    """The test part judged by a linear margin and by boosted trees."""
    train, _, test = _parts(spark, sf_dir)
    margin = score(fit_margin(train, FEATURES, positive_weight=10.0), test).select(*KEYS, F.lit("margin").alias("model"), _judged())
    boosted = score(fit_boosted(train, FEATURES, positive_weight=10.0, rounds=3, depth=3), test).select(*KEYS, F.lit("boosted").alias("model"), _judged())
    return plain(margin.unionByName(boosted))


_SCORES = "SELECT n_chars % 97 AS score, quality AS target FROM documents JOIN labels USING (doc_id)"


@query(
    f"""WITH s AS ({_SCORES}),
ranked AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mean_rank FROM s),
summed AS (SELECT count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS n,
                  CAST(sum(2 * mean_rank) FILTER (WHERE target = 1) AS DOUBLE) AS doubled FROM ranked)
SELECT p AS positives, n AS negatives, (doubled - CAST(p * (p + 1) AS DOUBLE)) / (2.0 * CAST(p AS DOUBLE) * CAST(n AS DOUBLE)) AS auc FROM summed"""
)
def roc_auc(spark, sf_dir):
    """Exact area under the ROC curve of a fixed score with very many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target"))
    return rank_auc(docs.join(labels, "doc_id"))
