"""Power sums of tiles, passes over the pairs, and the matrix of squared distances that is not stored."""

import numpy as np
import pytest
from locusflow.operators import distance as DI
from locusflow.operators import reduce as R


@pytest.mark.parametrize("metric, p", [("euclidean", 2), ("manhattan", 1), ("hamming", 1), ("minkowski", 3), ("minkowski", 2.5)])
@pytest.mark.parametrize("kind", ["genotypes", "signal", "far", "odd"])
def test_power_sums(metric, p, kind):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (37, 9)).astype(float), rng.integers(0, 3, (29, 9)).astype(float)
    if kind != "genotypes":
        a, b = rng.normal(size=(37, 9)), rng.normal(size=(29, 9))
    if kind == "far":  # differences that cancel in products of the rows
        a, b = 1e5 + a * 1e-3, 1e5 + b * 1e-3
        b[:5], b[5] = a[:5], a[5] + 1e-7
    if kind == "odd":
        a[3, 2], b[4, 1], b[5, 1], b[6, 0] = np.inf, np.nan, 1e200, -0.0
    with np.errstate(all="ignore"):
        got = DI._power_sums_of(a, b, metric, p)(5, 30, 20)
        want = DI._power_sums(a[5:30], b[:20], metric, p)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12 if kind != "far" else 1e-25)


def signal_table(spark, n, width=5):
    x = np.random.default_rng(8).normal(size=(n, width))
    rows = [(f"s{k:03d}", j, float(x[k, j])) for k in range(n) for j in range(width)]
    return x, spark.createDataFrame(rows, "sampleId string, idx int, w double")


def test_rows_sent_do_not_grow_with_the_samples(spark):
    for n in (200, 400):
        _, long = signal_table(spark, n)
        tiled, tile, count, _ = DI._numbered_rows(DI.sample_rows(long, value="w"), None)
        assert count == n and DI._sent_rows(tiled, tile, n).count() <= n * DI.TILES


def test_strips_of_a_tile_pair(spark, monkeypatch):
    """Many strips: every pair once, with its distance and its ends in order."""
    monkeypatch.setattr(DI, "STRIP_PAIRS", 16)
    x, long = signal_table(spark, 40)
    found = {(r["i"], r["j"]): r["dist"] for r in DI.distance_matrix(long, "manhattan", value="w").collect()}
    assert found == {(f"s{a:03d}", f"s{b:03d}"): pytest.approx(np.abs(x[a] - x[b]).sum()) for b in range(40) for a in range(b)}


def test_mirror_forms_the_pairs_once(spark):
    _, long = signal_table(spark, 12)
    full = DI.mirror(DI.distance_matrix(long, value="w"), long.select("sampleId").distinct())
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    assert full.count() == full.distinct().count() == 144


@pytest.mark.parametrize("metric, p", [("manhattan", 1), ("minkowski", 3)])
def test_centred_matrix_is_not_stored(spark, monkeypatch, metric, p):
    """Products with the matrix equal those with the stored one; no pair of samples becomes a row."""
    monkeypatch.setattr(DI, "STRIP_PAIRS", 16)
    x, long = signal_table(spark, 26)
    power = 1 if metric == "manhattan" else p
    d2 = (np.abs(x[:, None] - x[None]) ** power).sum(-1) ** (2 / power)
    centre = np.eye(26) - 1 / 26
    want = -0.5 * centre @ d2 @ centre
    sums = {r["id"]: r["total"] for r in DI.square_sums(long, metric, p, value="w").collect()}
    assert sums == {f"s{k:03d}": pytest.approx(d2[k].sum()) for k in range(26)}
    matrix = DI.centred_squares(long, metric, p, value="w", edge=7)
    assert matrix.blocks.count() == 10
    place = {r["i"]: r["sidx"] for r in matrix.samples.collect()}
    order = np.argsort([place[f"s{k:03d}"] for k in range(26)])
    vectors = np.zeros((28, 3))
    vectors[:26] = np.random.default_rng(1).normal(size=(26, 3))
    blocks = spark.createDataFrame([(b, [float(v) for v in vectors[b * 7 : b * 7 + 7].ravel()]) for b in range(4)], "b int, q array<double>")
    got = {r["b"]: np.array(r["q"]).reshape(7, 3) for r in matrix.times(blocks, 3).collect()}
    np.testing.assert_allclose(np.vstack([got[b] for b in range(4)])[:26], want[order][:, order] @ vectors[:26], atol=1e-9)
    assert R.mds_classic(long, metric, p, k=2).count() == 26


def _pairs_of(df):
    return sorted(((r["i"], r["j"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tile", [None, 1, 7, 40, 5000])
def test_all_pairs_once_and_in_order(spark, monkeypatch, tile):
    monkeypatch.setattr(DI, "RUN_PAIRS", 24)
    names = [f"S{k}" for k in range(37)] + ["", "s1", "Ä", "S1 "]
    df = spark.createDataFrame([(x,) for x in names + names[:9]], "sampleId string").repartition(3)
    want = sorted(names, key=str.encode)
    assert _pairs_of(DI.all_pairs(df, tile=tile)) == sorted(((a, b) for k, a in enumerate(want) for b in want[k + 1 :]), key=repr)


def test_all_pairs_with_few_or_null_keys(spark):
    for names, want in (([], []), (["a"], []), ([None], []), (["b", None, "a", None], [("a", "a"), ("a", "b"), ("b", "b")])):
        df = spark.createDataFrame([(x,) for x in names], "key string")
        assert _pairs_of(DI.all_pairs(df, key="key")) == want


def test_all_pairs_leaves_no_pair_to_python(spark, capsys):
    df = spark.createDataFrame([(f"S{k}",) for k in range(30)], "sampleId string")
    DI.all_pairs(df).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "InArrow" not in plan and "InPandas" not in plan
