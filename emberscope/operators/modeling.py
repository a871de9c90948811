"""Training and scoring with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import best_threshold, threshold_sweep

WEIGHT, FEATURES = "class_weight", "features"


def with_class_weight(df: DataFrame, label: str, positive_weight: float) -> DataFrame:
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)))


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = "target",
    positive_weight: float = 1.0,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> PipelineModel:
    """Seeded random forest with a weight on the positive class."""
    forest = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, numTrees=trees, maxDepth=depth, seed=seed
    )
    return _fit(with_class_weight(train, label, positive_weight), features, [forest])


def fit_margin(train: DataFrame, features: Sequence[str], label: str = "target", positive_weight: float = 1.0) -> PipelineModel:
    """Linear support-vector machine on standardised features."""
    scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=True, withStd=True)
    svc = LinearSVC(featuresCol="scaled", labelCol=label, weightCol=WEIGHT)
    return _fit(with_class_weight(train, label, positive_weight), features, [scaler, svc])


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    label: str = "target",
    positive_weight: float = 1.0,
    rounds: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Seeded gradient-boosted trees."""
    boosted = GBTClassifier(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, seed=seed)
    return _fit(with_class_weight(train, label, positive_weight), features, [boosted])


def _fit(train: DataFrame, features: Sequence[str], stages: list) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip")
    # a copy has no training summary, which would take the session to the tasks; once an Observation was made, it cannot go
    return Pipeline(stages=[assembler, *stages]).fit(train).copy()


def score(model: PipelineModel, df: DataFrame, name: str = "score", keep_incomplete: bool = False) -> DataFrame:
    """Input columns plus the probability of the positive class.

    A margin classifier has no probability; its margin is squashed to [0, 1]. Rows that lack a feature
    are left out, or have no score with ``keep_incomplete``.
    """
    assembler, last = model.stages[0], model.stages[-1]
    out = model.transform(df, {assembler.handleInvalid: "keep"}) if keep_incomplete else model.transform(df)
    if last.hasParam("probabilityCol"):
        value = vector_to_array(F.col(last.getOrDefault("probabilityCol")))[1]
    else:
        margin = vector_to_array(F.col(last.getOrDefault("rawPredictionCol")))[1]
        value = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    if keep_incomplete:
        whole = F.lit(True)
        for c in assembler.getInputCols():
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        value = F.when(whole, value)
    return out.select(*df.columns, value.alias(name))


def weight_sweep(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    weights: Sequence[float],
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
    bins: int = 100,
) -> DataFrame:
    """Best threshold and F2 on the validation rows for each positive-class weight, best first.

    Both inputs are persisted once for all fits; only one row per weight comes
    back to the driver.
    """
    columns = [*features, label]
    train = train.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    validation = validation.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lines = []
        for weight in weights:
            model = fit_forest(train, features, label, weight, trees, depth, seed)
            best = best_threshold(threshold_sweep(score(model, validation), "score", label, bins)).first()
            if best is not None:
                lines.append((float(weight), best["threshold"], best["precision"], best["recall"], best["f2"]))
    finally:
        train.unpersist()
        validation.unpersist()
    schema = "positive_weight double, threshold double, precision double, recall double, f2 double"
    return train.sparkSession.createDataFrame(lines, schema).orderBy(F.desc_nulls_last("f2"), "positive_weight")


def filled(df: DataFrame, features: Sequence[str], missing: float = -999.0) -> DataFrame:
    """Features as doubles, with a value outside their range where they are null or NaN, which a tree can tell from all others."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(missing)) for c in features})


def fold_sweep(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str,
    weights: Sequence[float],
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
    bins: int = 100,
    parallel: int = 4,
) -> DataFrame:
    """Best threshold and its measures for each positive-class weight and each fold, the fold being tested and all others learned.

    (positive_weight, fold, threshold, precision, recall, f2). Rows without a fold take no part. Fits run side by side, so that Spark
    fills the gaps of one with tasks of the others; one row for each comes to the driver.
    """
    rows = df.select(*features, label, fold).filter(F.col(fold).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)

    def fitted(task: tuple[float, int]) -> tuple | None:
        weight, k = task
        model = fit_forest(rows.filter(F.col(fold) != k), features, label, weight, trees, depth, seed)
        best = best_threshold(threshold_sweep(score(model, rows.filter(F.col(fold) == k)), "score", label, bins)).first()
        return None if best is None else (float(weight), k, best["threshold"], best["precision"], best["recall"], best["f2"])

    try:
        folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
        with ThreadPoolExecutor(parallel) as pool:
            lines = [line for line in pool.map(inheritable_thread_target(df.sparkSession)(fitted), [(w, k) for w in weights for k in folds]) if line]
    finally:
        rows.unpersist()
    schema = "positive_weight double, fold int, threshold double, precision double, recall double, f2 double"
    return df.sparkSession.createDataFrame(lines, schema)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Share of each feature in a tree model, greatest first."""
    names = model.stages[0].getInputCols()
    shares = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(names, shares)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
