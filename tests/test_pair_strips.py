"""Pairs of a distance job are formed from strips, in key order, and rounded like decimal texts."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from locusflow.operators import distance as DI
from locusflow.registry.base import r6
from pyspark.sql import functions as F


def _long(spark, n, width, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, width)).astype(float)
    x[1] = x[0]
    cells = [(f"s{k}", f, float(x[k, f])) for k in range(n) for f in range(width)]
    return {f"s{k}": x[k] for k in range(n)}, spark.createDataFrame(cells, "sampleId string, idx int, w double")


@pytest.mark.parametrize("strip", [16, 1 << 18])
def test_strips_hold_ids_once_and_pairs_are_generated(spark, monkeypatch, strip):
    monkeypatch.setattr(DI, "STRIP_PAIRS", strip)
    x, long = _long(spark, 23, 5, 1)
    pairs = DI.distance_matrix(long.union(long.limit(1).select(F.lit(None).cast("string"), "idx", "w")), "euclidean", value="w")
    assert "posexplode" in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.dist for r in pairs.collect()}
    assert len(got) == 23 * 22 // 2 == pairs.count() and all(i < j for i, j in got)
    assert all(abs(d - np.sqrt(((x[i] - x[j]) ** 2).sum())) < 1e-12 for (i, j), d in got.items())


def test_labels_of_pairs(spark):
    x, long = _long(spark, 12, 3, 2)
    label = F.when(F.substring("sampleId", 2, 9).cast("int") % 3 > 0, (F.substring("sampleId", 2, 9).cast("int") % 3).cast("string"))
    found = DI.labelled_distances(long.withColumn("label", label), "label").collect()
    assert len(found) == 66
    for r in found:
        a, b = int(r.i[1:]) % 3, int(r.j[1:]) % 3
        assert r.same == (None if not (a and b) else a == b)


def test_whole_numbers_too_large_to_be_exact():
    a = np.array([[1e60, 3.0], [1e60, 3.0], [2e60, 5.0]])
    got = DI._power_sums_of(a, a, "euclidean", 2)(0, 3, 3)
    assert np.allclose(got, DI._power_sums(a, a, "euclidean", 2)) and (np.diag(got) == 0).all() and got[0, 1] == 0


def test_rounding_without_texts(spark):
    rng = np.random.default_rng(3)
    values = [*(rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-8, 14, 2000)), 0.1234565, -0.1234565, 2.5e-7, 5e-7, -5e-7, 1e-9, -1e-9, 0.0, -0.0, 1e300, -3.0]
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "k int, v double")
    got = {r.k: r.r for r in df.select("k", r6("v").alias("r")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    for k, v in enumerate(values):
        want = float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(v) < 1e15 else v
        assert got[k] == want and str(got[k]) != "-0.0", (v, got[k], want)
