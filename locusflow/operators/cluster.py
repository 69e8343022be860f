"""Clustering of samples and choice of the number of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Model, Pipeline
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .sampling import SEED, train_test_split

METHODS = ("kmeans", "kmeans_h2o", "gmm", "bkm")


def kmeans(df: DataFrame, k: int, features: str = "features", label: str = "Region", seed: int = SEED, max_iter: int = 20) -> Model:
    """Label index and k-means in one pipeline; predictions in ``Predict``."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
            KMeans(k=k, featuresCol=features, predictionCol="Predict", seed=seed, maxIter=max_iter),
        ]
    ).fit(df)


def kmeans_standardized(df: DataFrame, k: int, features: str = "features", label: str = "Region", seed: int = SEED, max_iter: int = 20) -> Model:
    """k-means on features scaled to zero mean and unit deviation."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
            StandardScaler(inputCol=features, outputCol="scaledFeatures", withMean=True, withStd=True),
            KMeans(k=k, featuresCol="scaledFeatures", predictionCol="Predict", seed=seed, maxIter=max_iter),
        ]
    ).fit(df)


def gmm(df: DataFrame, k: int, features: str = "features", label: str = "Region", seed: int = SEED, max_iter: int = 10) -> Model:
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
            GaussianMixture(k=k, featuresCol=features, predictionCol="Predict", seed=seed, maxIter=max_iter),
        ]
    ).fit(df)


def bisecting_kmeans(df: DataFrame, k: int, features: str = "features", label: str = "Region", seed: int = SEED, max_iter: int = 10) -> Model:
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
            BisectingKMeans(k=max(k, 1), featuresCol=features, predictionCol="Predict", seed=seed, maxIter=max_iter),
        ]
    ).fit(df)


def single_cluster(df: DataFrame, features: str, label: str) -> DataFrame:
    """Everything in one cluster: what every method gives for k = 1."""
    return df.withColumn("Predict", F.lit(0))


FITS: dict[str, Callable[..., Model]] = {
    "kmeans": kmeans, "kmeans_h2o": kmeans_standardized, "gmm": gmm, "bkm": bisecting_kmeans,
}


def fit_predict(train: DataFrame, rows: DataFrame, method: str, k: int, features: str = "features", label: str = "Region", seed: int = SEED) -> DataFrame:
    """Fit on ``train``, assign ``rows``."""
    if method not in FITS:
        raise ValueError(f"unknown clustering {method!r}; one of {METHODS}")
    if k == 1:
        return single_cluster(rows, features, label)
    return FITS[method](train, k, features, label, seed).transform(rows)


def prediction_purity(predicted: DataFrame, label: str = "Region") -> DataFrame:
    return M.purity(M.confusion_matrix(predicted, label, "Predict"))


def _average_purity(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tune_k(
    df: DataFrame, method: str = "kmeans", ks: Iterable[int] = (1, 2, 3, 4, 5), reps: int = 10, ratio: float = 0.7,
    features: str = "features", label: str = "Region", key: str = "sampleId", seed: int = SEED,
) -> DataFrame:
    """Average purity on the held-out part for every k."""
    parts = []
    for rep in range(reps):
        train, rest = train_test_split(df, ratio, seed, rep, key)
        for k in ks:
            predicted = fit_predict(train, rest, method, k, features, label, seed + rep)
            parts.append(prediction_purity(predicted, label).select(F.lit(k).alias("k"), "purity"))
    return _average_purity(parts).groupBy("k").agg(F.avg("purity").alias("purity"))


def repeat_purity(
    df: DataFrame, method: str = "kmeans", k: int | None = None, reps: int = 5, features: str = "features", label: str = "Region", seed: int = SEED
) -> DataFrame:
    """Average purity over repeated fits; k defaults to the number of populations."""
    if k is None:
        k = df.agg(F.count_distinct(label)).first()[0]
    parts = [
        prediction_purity(fit_predict(df, df, method, k, features, label, seed + rep), label) for rep in range(reps)
    ]
    return _average_purity(parts).agg(F.avg("purity").alias("purity"), F.count(F.lit(1)).alias("repeats"))
