"""The squared-hinge solver against dense Newton steps, and its search against separate fits."""

import numpy as np
import pytest
from locusflow.operators import classify as K
from locusflow.operators import hinge as H
from locusflow.operators import reshape as RS
from pyspark.sql import functions as F

COSTS = (0.01, 0.1, 1.0, 10.0)


def newton(x, y, lam):
    """Minimum of lam / 2 |w|^2 + 1/2 sum max(0, 1 - y x'w)^2."""
    w = np.zeros(x.shape[1])

    def value(w):
        return 0.5 * lam * w @ w + 0.5 * (np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    for _ in range(200):
        active = 1 - y * (x @ w) > 0
        gradient = lam * w - x[active].T @ (y[active] * (1 - y[active] * (x[active] @ w)))
        step = np.linalg.solve(lam * np.eye(len(w)) + x[active].T @ x[active], gradient)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-12:
            t /= 2
        w = w - t * step
        if np.abs(step).max() < 1e-13:
            break
    return w


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    label = np.arange(90) % 3
    return rng.normal(0, 0.7, (3, 5))[label] + rng.normal(0, 1.0, (90, 5)), label


@pytest.fixture(scope="module")
def table(spark, data):
    x, label = data
    rows = [(f"s{k:03d}", f"r{c}", [float(v) for v in v]) for k, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "sampleId string, Region string, v array<double>").repartition(3)
    return df.withColumn("features", RS.array_to_vector("v")).drop("v").persist()


@pytest.mark.parametrize("intercept", [False, True])
def test_equals_a_dense_solver(spark, data, intercept):
    x, label = data
    fold = np.arange(90) % 4
    rows = spark.createDataFrame([([float(a) for a in v], int(c), int(f)) for v, c, f in zip(x, label, fold)], "x array<double>, label int, fold int").repartition(3).persist()
    fits = H.fit_columns(rows, 5, 3, COSTS, (-1, 2), intercept, tol=1e-16, max_iter=25)
    full = H.design(x, intercept)
    for left in (-1, 2):
        inside = fold != left
        for cost in COSTS:
            got = fits.of(cost, left)
            for c in range(3):
                want = newton(full[inside], np.where(label[inside] == c, 1.0, -1.0), cost)
                assert got[:, c] == pytest.approx(want, abs=1e-6)


def test_search_and_prediction(table, data):
    x, label = data
    model = K.svm(table, cost=COSTS, folds=3, max_iter=(10,))
    got = model.transform(table).select("sampleId", "label", "prediction", "predictedLabel", "Region").collect()
    weights = model.stages[1].weights
    assert weights.shape == (5, 3)
    index = {r["Region"]: int(r["label"]) for r in got}
    for r in got:
        margins = x[int(r["sampleId"][1:])] @ weights
        assert r["prediction"] == margins.argmax() and index[r["predictedLabel"]] == r["prediction"]
    assert sum(r["label"] == r["prediction"] for r in got) >= 50
    error = K.predict_and_error(model, table)[1]
    counts = np.zeros((3, 3))
    for r in got:
        counts[int(r["label"]), int(r["prediction"])] += 1
    assert error == pytest.approx(1 - H.weighted_f1(counts))


def test_chosen_cost_has_the_best_score(table):
    indexed = K.label_indexer(table).transform(table)
    rows, width = H.training_rows(indexed, "features", "label", 3, 25)
    fits = H.fit_columns(rows, width, 3, COSTS, (-1, 0, 1, 2))
    found = H.fold_scores(rows, fits, False, 3)
    local = rows.toPandas()
    x, label, fold = np.stack(local["x"]), local["label"].to_numpy(), local["fold"].to_numpy()
    for (cost, left), value in found.items():
        inside = fold == left
        counts = np.zeros((3, 3))
        np.add.at(counts, (label[inside], (x[inside] @ fits.of(cost, left)).argmax(axis=1)), 1)
        assert value == pytest.approx(H.weighted_f1(counts))
    mean = [np.mean([found[c, f] for f in range(3)]) for c in COSTS]
    model = K.svm(table, cost=COSTS, folds=3, seed=25)
    assert model.stages[1].weights == pytest.approx(fits.of(COSTS[int(np.argmax(mean))]), abs=1e-9)


def test_odd_tables(spark, table):
    one = table.withColumn("Region", F.lit("only"))
    assert {r["prediction"] for r in K.svm(one, cv=False).transform(one).collect()} == {0.0}
    twice = table.limit(1).unionByName(table.limit(1))
    assert K.svm(twice, folds=2).transform(twice).count() == 2


def test_rows_are_spread_evenly_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, 100, 1, 7).select(RS.array_to_vector(F.array_repeat(F.lit(1.0), 4)).alias("features"), F.lit(0).alias("label"))
    assert H.training_rows(few, "features", "label", 2, 25)[0].rdd.getNumPartitions() == 1
    n = 2 * cores * H.LEAST_CELLS // 64
    many = spark.range(0, n, 1, 1).select(
        RS.array_to_vector(F.array_repeat(F.col("id").cast("double"), 64)).alias("features"), (F.col("id") % 3).alias("label")
    )
    rows, width = H.training_rows(many, "features", "label", 2, 25)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert width == 64 and sum(sizes) == n and len(sizes) == cores and max(sizes) < 1.1 * n / cores


def test_a_pass_works_on_bounded_blocks(spark):
    rows = spark.range(0, 5000, 1, 3).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") % 4).cast("int").alias("label"), F.lit(0).alias("fold"))
    most = 512

    def measure(x, label, fold):
        assert len(x) <= most
        return np.array([x[:, 0].sum(), len(x), label.sum()])

    total = H._pass(rows, measure, 3, H.BLOCK_CELLS // most)
    assert total.tolist() == [5000 * 4999 / 2, 5000, 7500]


def test_vectors_of_different_length_are_refused(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0, 0), ([1.0, 2.0, 3.0, 4.0], 1, 0)], "x array<double>, label int, fold int").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        H._pass(rows, lambda x, label, fold: np.array([x.sum()]), 1, 1)
