"""Supervised assignment of samples to populations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hinge as H
from . import metrics as M
from .catalog import average_over_repeats
from .sampling import SEED, train_test_split

# Default search grids.
COSTS = (0.01, 0.1, 10.0)
BINS, DEPTHS, IMPURITIES = (10, 15, 20), (4, 6, 8), ("entropy", "gini")
FOLDS = 10
PARALLELISM = 4


def evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")


def cross_validate(pipeline: Estimator, df: DataFrame, grid: list, folds: int = FOLDS, cv: bool = True, seed: int = SEED) -> Model:
    """Best model of the grid by cross-validated F1, or a single fit with ``cv=False``."""
    if not cv:
        return pipeline.fit(df)
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator(), numFolds=folds, seed=seed, parallelism=PARALLELISM
    )
    rows = df.persist()
    try:
        return search.fit(rows).bestModel
    finally:
        rows.unpersist()


def label_indexer(df: DataFrame, label: str = "Region") -> StringIndexerModel:
    """Label coding by falling frequency. Fit it on the whole table, so that every split knows every class."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="frequencyDesc").fit(df)


def svm(
    df: DataFrame, label: str = "Region", features: str = "features", cv: bool = True, folds: int = FOLDS, cost: Sequence[float] = COSTS,
    intercept: Sequence[bool] = (False,), tol: Sequence[float] = (0.01,), max_iter: Sequence[int] = (10,),
    indexer: StringIndexerModel | None = None, seed: int = SEED,
) -> Model:
    """Multi-class linear SVM with squared hinge loss, one against the rest (:mod:`.hinge`).

    All classes, costs and folds of a search are fitted together; of equally good settings the first wins.
    """
    indexer = indexer or label_indexer(df, label)
    classes = len(indexer.labels)
    rows, width = H.training_rows(indexer.transform(df), features, "label", folds if cv else 1, seed)
    chosen = _search(rows, width, classes, folds, cv, cost, intercept, tol, max_iter, features)
    rows.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=indexer.labels)
    return PipelineModel(stages=[indexer, chosen, back])


def _search(
    rows: DataFrame, width: int, classes: int, folds: int, cv: bool, cost: Sequence[float], intercept: Sequence[bool], tol: Sequence[float],
    max_iter: Sequence[int], features: str,
) -> H.SquaredHingeModel:
    best, chosen = None, None
    for ones in intercept:
        for stop in tol:
            for most in max_iter:
                held = (-1, *range(folds)) if cv else (-1,)
                fits = H.fit_columns(rows, width, classes, cost if cv else cost[:1], held, ones, stop, most)
                found = H.fold_scores(rows, fits, ones, classes)
                for c in cost if cv else cost[:1]:
                    values = [v for (x, _), v in found.items() if x == c and v == v]  # a fold without rows has no score
                    score = sum(values) / len(values) if values else 0.0
                    if best is None or score > best:
                        best, chosen = score, H.SquaredHingeModel(fits.of(c), ones, features)
    return chosen


def _trees(tree: Estimator, df: DataFrame, label: str, cv: bool, folds: int, bins: Sequence[int], impurity: Sequence[str], depth: Sequence[int], indexer: StringIndexerModel | None) -> Model:
    indexer = indexer or label_indexer(df, label)
    back = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=indexer.labels)
    grid = (
        ParamGridBuilder().addGrid(tree.maxBins, list(bins)).addGrid(tree.maxDepth, list(depth))
        .addGrid(tree.impurity, list(impurity)).build()
    )
    return cross_validate(Pipeline(stages=[indexer, tree, back]), df, grid, folds, cv)


def decision_tree(
    df: DataFrame, label: str = "Region", features: str = "features", cv: bool = True, folds: int = FOLDS,
    bins: Sequence[int] = BINS, impurity: Sequence[str] = IMPURITIES, depth: Sequence[int] = DEPTHS, seed: int = SEED,
    indexer: StringIndexerModel | None = None,
) -> Model:
    tree = DecisionTreeClassifier(labelCol="label", featuresCol=features, seed=seed)
    return _trees(tree, df, label, cv, folds, bins, impurity, depth, indexer)


def random_forest(
    df: DataFrame, label: str = "Region", features: str = "features", cv: bool = True, folds: int = FOLDS,
    bins: Sequence[int] = BINS, impurity: Sequence[str] = IMPURITIES, depth: Sequence[int] = DEPTHS, seed: int = SEED,
    trees: int = 20, indexer: StringIndexerModel | None = None,
) -> Model:
    forest = RandomForestClassifier(labelCol="label", featuresCol=features, seed=seed, numTrees=trees)
    return _trees(forest, df, label, cv, folds, bins, impurity, depth, indexer)


FITS: dict[str, Callable[..., Model]] = {"svm": svm, "dt": decision_tree, "rf": random_forest}


def predict_and_error(model: Model, df: DataFrame) -> tuple[DataFrame, float]:
    """Predictions (features kept) and ``1 - F1``."""
    predicted = model.transform(df)
    return predicted, 1.0 - evaluator().evaluate(predicted)


def prediction_metrics(predicted: DataFrame, split: str, rep: int) -> DataFrame:
    """Weighted-F1 error and per-label precision, recall and F1 of one repeat as long rows."""
    cm = M.confusion_matrix(predicted, "label", "prediction")
    margins = M.class_margins(cm)
    rated = M.per_class_prf(cm, percent=False).join(margins.select("class", "actual"), "class")
    present = rated.filter(F.col("actual") > 0)
    f1 = F.coalesce("f1", F.lit(0.0))
    error = present.agg((1 - F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("value")).select(
        F.lit(None).cast("double").alias("label"), F.lit("error").alias("metric"), "value"
    )
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0.0)).alias("value")) for m in ("precision", "recall", "f1")])
    per_label = present.select(F.col("class").cast("double").alias("label"), F.explode(cells).alias("_c")).select("label", "_c.metric", "_c.value")
    return error.unionByName(per_label).select(F.lit(rep).alias("rep"), F.lit(split).alias("split"), "label", "metric", "value")


def repeat_classification(
    df: DataFrame, method: str = "svm", reps: int = 2, ratio: float = 0.7, label: str = "Region", key: str = "sampleId",
    seed: int = SEED, **options,
) -> DataFrame:
    """Metrics of the training and the test part, averaged over repeats that each split anew."""
    if method not in FITS:
        raise ValueError(f"unknown classifier {method!r}; one of {tuple(FITS)}")
    out = None
    indexer = label_indexer(df, label)
    for rep in range(reps):
        train, test = train_test_split(df, ratio, seed, rep, key)
        model = FITS[method](train, label, indexer=indexer, **options)
        for split, rows in (("train", train), ("test", test)):
            part = prediction_metrics(model.transform(rows), split, rep)
            out = part if out is None else out.unionByName(part)
    return average_over_repeats(out)


def model_description(model: Model) -> str:
    """Readable rules of the tree stage of a fitted pipeline."""
    for stage in model.stages:
        if hasattr(stage, "toDebugString"):
            return stage.toDebugString
    return "\n".join(str(stage) for stage in model.stages)
