import numpy as np
import pytest
from locusflow.operators import distance as DI
from locusflow.operators import reduce as R
from locusflow.operators import reshape as RS
from locusflow.operators.sampling import frame_split
from locusflow.plans import jobs
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F


def long_from(spark, matrix, name="w"):
    rows = [(f"s{i:03d}", int(j), float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, f"sampleId string, idx int, {name} double")


@pytest.fixture(scope="module")
def signal():
    """60 samples in three groups, 12 features."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (3, 12))
    return centres[np.arange(60) % 3] + rng.normal(0, 0.5, (60, 12))


@pytest.fixture(scope="module")
def long(spark, signal):
    return long_from(spark, signal).persist()


@pytest.fixture(scope="module")
def vectors(spark, long):
    keyed = long.withColumn("Region", F.concat(F.lit("g"), (F.substring("sampleId", 2, 9).cast("int") % 3).cast("string")))
    return RS.compact(RS.feature_vectors(keyed, ["sampleId", "Region"]))


def scores_matrix(df, column="pcs"):
    return np.array([r[column] for r in df.orderBy("sampleId").collect()])


def same_subspace(a, b, tol=1e-4):
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.svd(qa.T @ qb)[1].min() > 1 - tol


METRICS = {
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
    "manhattan": lambda a, b: np.abs(a - b).sum(),
    "hamming": lambda a, b: float((a != b).sum()),
    "minkowski": lambda a, b: (np.abs(a - b) ** 3).sum() ** (1 / 3),
}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("tile, chunk", [(7, 1000), (100, 3)])
def test_distances(spark, metric, tile, chunk):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (23, 8)).astype(float)
    m[5, :6] = 0
    sparse = long_from(spark, m).filter("w <> 0")  # absent cells are zeros
    sparse = sparse.unionByName(long_from(spark, m).filter("idx = 7 AND w = 0"))  # every sample stays present
    got = DI.pair_distances(DI.sample_rows(sparse, value="w", chunk=chunk), metric, 3, tile).collect()
    assert len(got) == 23 * 22 // 2
    for r in got:
        a, b = int(r["i"][1:]), int(r["j"][1:])
        assert a < b
        assert r["dist"] == pytest.approx(METRICS[metric](m[a], m[b]), abs=1e-9)


def test_unknown_metric(long):
    with pytest.raises(ValueError):
        DI.distance_matrix(long, "cosine", value="w")


def test_mirror_and_pairs(spark, long):
    pairs = DI.distance_matrix(long, value="w")
    full = DI.mirror(pairs, long.select("sampleId").distinct())
    assert full.count() == 60 * 60
    assert DI.all_pairs(long, tile=8).distinct().count() == 60 * 59 // 2


def test_array_distance(spark):
    df = spark.createDataFrame([([0, 1, 2], [2, 1, 0])], "x array<int>, y array<int>")
    got = df.select(*[DI.distance_column(F.col("x"), F.col("y"), m).alias(m) for m in ("euclidean", "manhattan", "hamming")]).first()
    assert tuple(got) == pytest.approx((np.sqrt(8), 4, 2))


def test_cluster_indices(spark, signal, long):
    label = np.arange(60) % 4
    tagged = long.withColumn("c", (F.substring("sampleId", 2, 9).cast("int") % 4).cast("string"))
    d = np.sqrt(((signal[:, None] - signal[None]) ** 2).sum(-1))
    iu = np.triu_indices(60, 1)
    dist, same = d[iu], (label[:, None] == label[None])[iu]
    pairs = DI.labelled_distances(tagged, "c")
    assert DI.dunn(pairs).first()[0] == pytest.approx(dist[~same].min() / dist[same].max())
    nw, s = same.sum(), np.sort(dist)
    want = (dist[same].sum() - s[:nw].sum()) / (s[-nw:].sum() - s[:nw].sum())
    assert DI.c_index(pairs).first()[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tile, buckets, chunk", [(4, 3, None), (None, 4096, None), (8, 16, 3)])
def test_indices_from_tiles(spark, monkeypatch, tile, buckets, chunk):
    """Small integers, so many tied distances; one sample without a label; samples of several feature chunks."""
    rng = np.random.default_rng(5)
    x, label = rng.integers(0, 3, (25, 6)).astype(float), rng.integers(0, 3, 25)
    names = [None if k == 7 else f"c{c}" for k, c in enumerate(label)]
    rows = [(f"s{k:02d}", names[k], j, float(x[k, j])) for k in range(25) for j in range(6)]
    long = spark.createDataFrame(rows, "sampleId string, pop string, idx int, w double")
    if chunk:
        monkeypatch.setattr(DI, "sample_rows", lambda *a, own=DI.sample_rows: own(*a, chunk=chunk))
    pairs = [(np.linalg.norm(x[a] - x[b]), names[a] is not None and names[a] == names[b]) for a in range(25) for b in range(a)]
    dist, same = np.array([d for d, _ in pairs]), np.array([m for _, m in pairs])
    nw, s = same.sum(), np.sort(dist)
    got = DI.pair_indices(long.filter("pop IS NOT NULL") if chunk else long, "pop", tile=tile, buckets=buckets).first()
    if chunk:
        known = np.array([a != 7 and b != 7 for a in range(25) for b in range(a)])
        dist, same = dist[known], same[known]
        s = np.sort(dist)
    assert got["dunn"] == pytest.approx(dist[~same].min() / dist[same].max())
    assert got["c_index"] == pytest.approx((dist[same].sum() - s[:nw].sum()) / (s[-nw:].sum() - s[:nw].sum()), abs=1e-9)
    assert tuple(DI.pair_indices(long.limit(0), "pop").first()) == (None, None)


def test_report_with_features(spark):
    """The three indices of the clusters stand in the report, over the Euclidean distances of the features."""
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(24, 3)), np.arange(24) % 3
    x[label == 1] += 2.0
    rows = [(f"s{k}", f"r{label[k]}", f"r{label[k]}", *map(float, x[k])) for k in range(24)]
    frame = spark.createDataFrame(rows, "SampleId string, Region string, prediction string, a double, b double, c double")
    got = {r["metric"]: r["value"] for r in jobs.evaluation_report_job(frame, features=("a", "b", "c")).collect()}
    dist = np.array([np.linalg.norm(x[a] - x[b]) for a in range(24) for b in range(a)])
    same = np.array([label[a] == label[b] for a in range(24) for b in range(a)])
    s, nw = np.sort(dist), same.sum()
    centres = np.array([x[label == c].mean(axis=0) for c in range(3)])
    within, between = ((x - centres[label]) ** 2).sum(), 8 * ((centres - x.mean(axis=0)) ** 2).sum()
    assert got["dunn"] == pytest.approx(dist[~same].min() / dist[same].max())
    assert got["c_index"] == pytest.approx((dist[same].sum() - s[:nw].sum()) / (s[-nw:].sum() - s[:nw].sum()))
    assert got["calinski_harabasz"] == pytest.approx((between / 2) / (within / 21))


def test_sum_of_smallest_with_ties(spark):
    values = [0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 5.0]
    pairs = spark.createDataFrame([(v,) for v in values], "dist double")
    for k in range(len(values) + 1):
        for buckets in (2, 3, 4096):
            assert DI._sum_of_smallest(pairs, k, 0.0, 5.0, buckets) == pytest.approx(sum(values[:k]))


def test_gram_power_randomized_and_low_rank_share_a_subspace(spark, signal, long, vectors):
    u, s, vt = np.linalg.svd(signal, full_matrices=False)
    want = u[:, :3] * s[:3]
    gram = R.pca_gram(vectors, 3, 1.0, train=1.0)
    got = scores_matrix(gram.withColumn("pcs", vector_to_array("pcaFeatures")))
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)
    power = scores_matrix(R.pca_power(long, 3, 1.0, train=1.0, tol=1e-10))
    assert np.abs(power) == pytest.approx(np.abs(want), abs=1e-3)
    assert same_subspace(scores_matrix(R.pca_randomized(long, 3, 1.0, train=1.0)), want)
    assert same_subspace(scores_matrix(R.pca_glrm(long, 3)), want, 1e-2)


def test_pca_keeps_leading_components(spark, vectors):
    reduced = R.pca(vectors, 12, 0.7)
    shares = R.explained_components(reduced, "allPcaFeatures", 12, 0.7).orderBy("component").collect()
    kept = len(reduced.first()["pcaFeatures"])
    assert kept == max(1, sum(r["cumulative"] <= 0.7 for r in shares))
    assert shares[-1]["cumulative"] == pytest.approx(1.0)
    standard = R.explained_components(reduced, "allPcaFeatures", 12, 0.7, mode="standard")
    assert standard.count() == 12
    with pytest.raises(ValueError):
        R.explained_components(reduced, "allPcaFeatures", 12, mode="other")


def test_symmetric_iteration(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(20, 20))
    a = a @ a.T
    rows = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(20) for j in range(20)], "i int, j int, v double")
    found = R.subspace_iteration(rows, 3, 200, 1e-10, symmetric=True)
    assert found.values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3], rel=1e-4)


def relationship(g, missing):
    """Normalised genotypes, missing ones as zeros."""
    z = np.where(missing, np.nan, g)
    n, total = (~np.isnan(z)).sum(axis=0), np.nansum(z, axis=0)
    share = (1 + total) / (2 + 2 * n)
    return np.nan_to_num((z - total / n) / np.sqrt(share * (1 - share)))


@pytest.fixture(scope="module")
def genotypes(spark):
    rng = np.random.default_rng(7)
    freq = rng.uniform(0.2, 0.8, (2, 40))
    g = rng.binomial(2, freq[np.arange(30) % 2]).astype(float)
    missing = np.zeros(g.shape, dtype=bool)
    missing[:4, 3] = True
    rows = long_from(spark, g, "dosage").filter("NOT (idx = 3 AND sampleId < 's004')")
    return rows.persist(), relationship(g, missing)


@pytest.mark.parametrize("turn", [False, True])
@pytest.mark.parametrize("edge, width", [(512, 48), (7, 4)])
def test_relationship_pca_is_the_same_at_every_size(genotypes, turn, edge, width):
    """Blocks and first vectors of any size, more samples than SNPs or fewer: all components, shares and cuts are those of
    the dense matrix."""
    rows, z = genotypes
    if turn:
        z = z[:, :18]
        rows = rows.filter("idx < 18")
    values, vectors = np.linalg.eigh(z @ z.T)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = R.grm_pca(rows, edge=edge, width=width)
    for threshold in (0.0, 0.25):
        got = scores_matrix(found.keep(threshold))
        count = int((np.cumsum(values) / values.sum() <= threshold).sum())
        assert got.shape == (30, count)
        assert np.abs(got) == pytest.approx(np.abs(vectors[:, :count]), abs=1e-6)
    positive = values > values[0] * 1e-10
    assert found.shares == pytest.approx(values[positive] / values.sum(), abs=1e-9)
    u = scores_matrix(found.scores(100))
    assert u.shape[1] == positive.sum()
    residual = z @ (z.T @ u) - u * (found.shares * values.sum())
    assert np.linalg.norm(residual, axis=0).max() <= 1e-6 * values[0]
    assert u.T @ u == pytest.approx(np.eye(u.shape[1]), abs=1e-6)
    assert found.keep(0.0, at_least_one=True).first()["pcs"] != [] and found.keep(0.0).first()["pcs"] == []


def test_unsettled_iteration_raises(genotypes):
    found = R.grm_pca(genotypes[0], width=2)
    found._pairs.max_rounds = 2
    with pytest.raises(RuntimeError):
        found.keep(0.3)


def test_relationship_pca_of_nothing(spark):
    empty = spark.createDataFrame([], "sampleId string, idx int, dosage double")
    assert R.grm_pca(empty).keep(0.5).collect() == []
    constant = long_from(spark, np.ones((4, 3)), "dosage")
    assert R.grm_pca(constant).keep(0.5).collect() == []


def classical(d, k):
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(values)[::-1][:k]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def test_euclidean_mds_is_pca_of_centred_data(spark, signal, long):
    got = scores_matrix(R.mds_classic(long, k=12, threshold=1.0))
    d = np.sqrt(((signal[:, None] - signal[None]) ** 2).sum(-1))
    assert got.shape[1] == 12
    assert np.sqrt(((got[:, None] - got[None]) ** 2).sum(-1)) == pytest.approx(d, abs=1e-6)


def test_mds_of_other_distances(spark, signal, long):
    d = np.abs(signal[:, None] - signal[None]).sum(-1)
    got = scores_matrix(R.mds_classic(long, "manhattan", k=2, threshold=1.0, tol=1e-10))
    assert np.abs(got) == pytest.approx(np.abs(classical(d, 2)), abs=2e-2)


def test_similarities_and_projection(spark, signal, vectors):
    got = {(r["i"], r["j"]): r["similarity"] for r in R.column_similarities(vectors).collect()}
    unit = signal / np.linalg.norm(signal, axis=0)
    want = unit.T @ unit
    assert len(got) == 66
    assert all(v == pytest.approx(want[i, j], abs=1e-9) for (i, j), v in got.items())


@pytest.mark.parametrize("threshold, chunk, tile", [(0.0, 7, 3), (0.3, 7, 3), (0.3, 1 << 14, None)])
def test_similarities_in_tiles(spark, threshold, chunk, tile):
    """Sparse columns over several chunks of rows, one of them all zeros, against the whole product."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 11)) * (rng.random((40, 11)) < 0.4)
    x[:, 5] = 0
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").coalesce(1)
    got = {(r["i"], r["j"]): r["similarity"] for r in R.column_similarities(rows, threshold=threshold, chunk=chunk, tile=tile).collect()}
    norm = np.linalg.norm(x, axis=0)
    want = {(i, j): x[:, i] @ x[:, j] / norm[i] / norm[j] for j in range(11) for i in range(j) if ((x[:, i] != 0) & (x[:, j] != 0)).any()}
    want = {k: v for k, v in want.items() if abs(v) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert R.column_similarities(rows.filter("size(features) = 0")).count() == 0


def test_similarities_skip_tiles_that_cannot_reach_the_threshold(spark):
    """Two sets of columns that live in different chunks of rows: only the pairs of tiles inside a set are formed."""
    rows = [(c, c // 2, (c // 4), 1.0) for c in range(8)]
    unit = spark.createDataFrame(rows, "idx long, tile int, chunk long, square double")
    assert {tuple(r) for r in R.similar_tiles(unit, 0.5).collect()} == {(0, 0), (1, 0), (1, 1), (2, 2), (3, 2), (3, 3)}
    low = unit.withColumn("square", F.expr("CASE WHEN tile = 1 THEN 0.16 ELSE 1.0 END"))
    assert {tuple(r) for r in R.similar_tiles(low, 0.5).collect()} == {(0, 0), (2, 2), (3, 2), (3, 3)}


def test_filled_vectors_put_zeros(spark):
    long = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1)], "sampleId string, variantId string, altCount int")
    rows = {r["sampleId"]: sorted(r["features"].toArray()) for r in R.filled_vectors(long).collect()}
    assert rows == {"a": [1.0, 2.0], "b": [0.0, 1.0]}


def dense_pca(x):
    """Scores of the scaled rows on the components of the centred matrix."""
    sd = x.std(axis=0, ddof=1)
    scaled = np.divide(x, sd, out=np.zeros_like(x), where=sd > 1e-6)
    _, s, vt = np.linalg.svd(scaled - scaled.mean(axis=0), full_matrices=False)
    return scaled @ vt[s > s[0] * 1e-10].T


@pytest.mark.parametrize("n, m, parts", [(40, 9, 11), (9, 40, 1), (21, 21, 3), (2, 5, 2), (5, 1, 1)])
def test_pca_of_any_shape(spark, n, m, parts):
    """Rows and columns in any proportion, folded by few tasks or many, from vectors or from long rows."""
    x = np.random.default_rng(n).normal(size=(n, m)) * np.arange(1, m + 1) + 3
    x[:, m // 2] = 2.0  # a constant column
    if m == 1:
        x = np.arange(5.0)[:, None]
    want = dense_pca(x)
    long = long_from(spark, x).repartition(parts)
    rows = RS.feature_vectors(long.withColumn("Region", F.lit("x")), ["sampleId", "Region"]).repartition(parts)
    reduced = R.pca(rows, min(n, m), 1.0)
    got = scores_matrix(reduced.withColumn("pcs", vector_to_array("allPcaFeatures")))
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)
    table = R.explained_components(reduced, "allPcaFeatures", min(n, m)).orderBy("component").collect()
    values = np.linalg.svd(want, compute_uv=False)
    assert [r["value"] for r in table] == pytest.approx(list(values), abs=1e-9)
    assert table[-1]["cumulative"] == pytest.approx(1.0)
    wide = scores_matrix(R.pca_wide(long, threshold=0.8, feature="idx", value="w"))
    count = max(1, int((np.cumsum(values) / values.sum() <= 0.8 + 1e-12).sum()))
    assert np.abs(wide) == pytest.approx(np.abs(want[:, :count]), abs=1e-8)


@pytest.mark.parametrize("n, m", [(40, 9), (9, 40)])
@pytest.mark.parametrize("train", [1.0, 0.6])
def test_gram_pca_of_any_shape(spark, n, m, train):
    x = np.random.default_rng(m).normal(size=(n, m)) * np.arange(1, m + 1)
    long = long_from(spark, x)
    got = scores_matrix(R.pca_gram_wide(long, 4, 0.7, train=train, feature="idx", value="w"))
    rows = RS.feature_vectors(long.withColumn("Region", F.lit("x")), ["sampleId", "Region"])
    same = scores_matrix(R.pca_gram(rows, 4, 0.7, train=train).withColumn("pcs", vector_to_array("pcaFeatures")))
    part = np.ones(n, dtype=bool)
    if train < 1:
        inside = {r["sampleId"] for r in frame_split(rows, train, key="sampleId")[0].collect()}
        part = np.array([f"s{i:03d}" in inside for i in range(n)])
    _, s, vt = np.linalg.svd(x[part], full_matrices=False)
    count = int((np.cumsum(s**2)[:4] / (s**2).sum() <= 0.7).sum())
    assert 0 < count <= 4
    assert np.abs(got) == pytest.approx(np.abs(x @ vt[:count].T), abs=1e-8)
    assert same == pytest.approx(got, abs=1e-8)


def test_wide_pca_fills_absent_cells_with_zeros(spark):
    rng = np.random.default_rng(17)
    m = rng.binomial(2, 0.4, (15, 30)).astype(float)
    sparse = long_from(spark, m).filter("w <> 0")
    keyed = sparse.withColumn("Region", F.lit("x")).select("sampleId", "idx", "w", "Region")
    vectors = R.filled_vectors(keyed, feature="idx", value="w").withColumn("Region", F.lit("x"))
    want = scores_matrix(R.pca(vectors, 5).withColumn("pcs", vector_to_array("allPcaFeatures")))
    got = scores_matrix(R.pca_wide(sparse, feature="idx", value="w", threshold=1.0))[:, :5]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
def test_mds_is_the_same_at_every_size(spark, signal, long, metric):
    d = np.abs(signal[:, None] - signal[None]).sum(-1) if metric == "manhattan" else np.sqrt(((signal[:, None] - signal[None]) ** 2).sum(-1))
    for edge, width in ((512, 48), (9, 3)):
        got = scores_matrix(R.mds_classic(long, metric, k=4, threshold=1.0, edge=edge, width=width))
        assert np.abs(got) == pytest.approx(np.abs(classical(d, 4)), abs=1e-5)


def test_low_rank_model_scores_samples_outside_the_fit(spark, signal, long):
    got = scores_matrix(R.pca_glrm(long, 3, train=0.5))
    assert len(got) == 60
    u, s, _ = np.linalg.svd(signal, full_matrices=False)
    assert same_subspace(got, u[:, :3] * s[:3], 5e-2)
