"""Clustering, classification and the jobs built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import catalog as A
from ..operators import classify as K
from ..operators import cluster as C
from ..operators import reduce as R
from ..operators import sampling as Q
from ..plans import jobs as J
from ..sources.params import JobParams
from .base import query, rounded
from .q_reduce import region_vectors


def _clusters(spark, sf, method):
    rows = region_vectors(spark, sf)
    return C.fit_predict(rows, rows, method, 5).select("sampleId", "Region", "Predict")


@query("kmeans")
def _(spark, sf):
    return _clusters(spark, sf, "kmeans")


@query("kmeans_standardized")
def _(spark, sf):
    return _clusters(spark, sf, "kmeans_h2o")


@query("gmm")
def _(spark, sf):
    return _clusters(spark, sf, "gmm")


@query("bisecting_kmeans")
def _(spark, sf):
    return _clusters(spark, sf, "bkm")


@query("tune_k")
def _(spark, sf):
    return rounded(C.tune_k(region_vectors(spark, sf), "kmeans", (1, 2, 3, 4, 5), 1), "purity")


@query("repeat_purity")
def _(spark, sf):
    return rounded(C.repeat_purity(region_vectors(spark, sf), "kmeans", reps=2), "purity")


@query("svm")
def _(spark, sf):
    rows = region_vectors(spark, sf)
    return K.svm(rows).transform(rows).select("sampleId", "Region", "label", "prediction")


@query("decision_tree")
def _(spark, sf):
    rows = region_vectors(spark, sf)
    return K.decision_tree(rows, cv=False).transform(rows).select("sampleId", "Region", "label", "prediction", "predictedLabel")


@query("random_forest")
def _(spark, sf):
    rows = region_vectors(spark, sf)
    return K.random_forest(rows, cv=False).transform(rows).select("sampleId", "Region", "label", "prediction", "predictedLabel")


@query("cross_validate")
def _(spark, sf):
    rows = region_vectors(spark, sf)
    model = K.decision_tree(rows, folds=2, bins=(15,), impurity=("gini",), depth=(4, 6))
    return model.transform(rows).select("sampleId", "Region", "label", "prediction")


@query("predict_and_error")
def _(spark, sf):
    train, test = Q.train_test_split(region_vectors(spark, sf))
    predicted, error = K.predict_and_error(K.decision_tree(train, cv=False), test)
    return predicted.select("sampleId", "Region", "prediction").withColumn("error", F.round(F.lit(error), 6))


@query("repeat_classification")
def _(spark, sf):
    return rounded(K.repeat_classification(region_vectors(spark, sf), "dt", 2, cv=False), "value")


@query("model_description")
def _(spark, sf):
    text = K.model_description(K.decision_tree(region_vectors(spark, sf), cv=False))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


# ---------------------------------------------------------------- jobs


def _signal_panel(spark, sf):
    return X.dense(spark, sf).select("sampleId", "pop", "super_pop").distinct()


@query("stratify_job")
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    params = JobParams(
        "", "", frequencies=True, inf_freq=0.05, sup_freq=0.3, dim_red_method="pcaH2O", clustering=True, clustering_method="kmeans",
        n_repeat_clustering=1, classification=True, classification_method="dt", n_repeat_classification=1, outliers=True,
    )
    catalog = A.variant_catalog(calls, complete=False)
    return rounded(J.stratify(calls, catalog, X.panel(spark, sf), params).metrics(), "value")


@query("stratify_from_features_job")
def _(spark, sf):
    from ..session import scratch_path
    from ..sources.writers import write_csv2
    from ..operators.reshape import pc_columns

    table = pc_columns(region_vectors(spark, sf), ["sampleId", "Region"], 19, "features").withColumnRenamed("sampleId", "SampleId")
    path = write_csv2(table, scratch_path(spark, "components"))
    params = JobParams(
        "", "", clustering=True, clustering_method="gmm", n_repeat_clustering=1, classification=True, classification_method="dt",
        n_repeat_classification=1,
    )
    return rounded(J.stratify_from_features_job(spark, path, params).metrics(), "value")


@query("pca_grid_job")
def _(spark, sf):
    long = X.dense_calls(spark, sf)
    shares = long.groupBy(F.concat_ws(":", "contig", F.col("start").cast("string")).alias("snpIdx")).agg((F.avg("dosage") / 2).alias("frequency"))
    grid = J.pca_grid_job(long, shares, _signal_panel(spark, sf), ld_thresholds=(0, 0.05), mafs=(None,), variances=(0.1, 0.3), low=0.05, high=0.9, missing_rate=None)
    return grid.groupBy("ld", "variance", "Region").agg(F.count(F.lit(1)).alias("samples"), F.max(F.size("pcs")).alias("components"))


@query("stage_report")
def _(spark, sf):
    clock = J.StageClock()
    clock.run("select variants by frequency", lambda: A.freq_dosage(X.gts_raw(spark, sf)).count())
    clock.run("reduce dimensions: PCA", lambda: R.pca_gram(region_vectors(spark, sf), threshold=0.95).count())
    return clock.report(spark)


@query("subpopulation_drilldown")
def _(spark, sf):
    rows = region_vectors(spark, sf)
    clusters = C.fit_predict(rows, rows, "kmeans", 5).select("sampleId", "Predict")
    return J.subpopulation_drilldown(X.dense_calls(spark, sf), clusters, _signal_panel(spark, sf), ld_threshold=0.2)
