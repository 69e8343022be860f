"""Dimensionality reduction and distances."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import distance as DI
from ..operators import reduce as R
from ..operators import reshape as RS
from .base import query, r6, rounded

KEYS = ["sampleId", "Region"]


def region_vectors(spark, sf):
    """Feature table of the signal view, stored for repeated fits."""
    return RS.compact(RS.feature_vectors(X.dense(spark, sf).withColumnRenamed("super_pop", "Region"), KEYS))


def _sizes(scores, column="pcs"):
    """Sign-free description of scores: rows, kept components and their total square."""
    c = F.col(column)
    square = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    return scores.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(c)).alias("components"), r6(F.sum(square), 4).alias("total_square"))


@query(
    "standardize", "dense",
    sql="""SELECT d.sampleId, d.idx, round(d.w / s.sd, 6) + 0.0 AS v FROM dense d
    JOIN (SELECT idx, stddev_samp(w) AS sd FROM dense GROUP BY idx) s ON s.idx = d.idx""",
)
def _(spark, sf):
    scaled = R.standardize(region_vectors(spark, sf)).select("sampleId", vector_to_array("normFeatures").alias("n"))
    return scaled.select("sampleId", F.posexplode("n").alias("idx", "v")).select("sampleId", "idx", r6("v").alias("v"))


def _lengths(scores, column="pcs"):
    """Per sample the number of components and the square of its whole score, which no rotation changes."""
    c = F.col(column)
    return scores.select("sampleId", F.size(c).alias("components"), r6(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x), 4).alias("total_square"))


@query(
    "pca", "dense",
    sql="""SELECT d.sampleId, 64 AS components, round(sum(d.w * d.w / s.v), 4) AS total_square FROM dense d
    JOIN (SELECT idx, var_samp(w) AS v FROM dense GROUP BY idx) s ON s.idx = d.idx GROUP BY d.sampleId""",
)
def _(spark, sf):
    reduced = R.pca(region_vectors(spark, sf), 64)
    return _lengths(reduced.withColumn("pcs", vector_to_array("allPcaFeatures")))


# All components of the scaled data keep its total square, whatever the rotation.
@query(
    "pca_total", "dense",
    sql="""SELECT count(DISTINCT sampleId) AS rows, 64 AS components, round(sum(d.w * d.w / s.v), 4) AS total_square FROM dense d
    JOIN (SELECT idx, var_samp(w) AS v FROM dense GROUP BY idx) s ON s.idx = d.idx""",
)
def _(spark, sf):
    reduced = R.pca(region_vectors(spark, sf), 64)
    return _sizes(reduced.withColumn("pcs", vector_to_array("allPcaFeatures")))


# Shares are of singular values; the squares of all of them add up to those of the matrix.
@query(
    "explained_components", "dense",
    sql="""SELECT 64 AS components, round(sum(d.w * d.w / s.v), 4) AS total_square, 1.0 AS last_share, 1.0 AS shares FROM dense d
    JOIN (SELECT idx, var_samp(w) AS v FROM dense GROUP BY idx) s ON s.idx = d.idx""",
)
def _(spark, sf):
    shares = R.explained_components(R.pca(region_vectors(spark, sf), 64), "allPcaFeatures", 64)
    return shares.agg(
        F.count(F.lit(1)).cast("int").alias("components"), r6(F.sum(F.col("value") * F.col("value")), 4).alias("total_square"),
        r6(F.max("cumulative"), 9).alias("last_share"), r6(F.sum("share"), 9).alias("shares"),
    )


# With all components the score of a sample is as long as the sample itself, also of one outside the training part.
WHOLE = "SELECT sampleId, 64 AS components, round(sum(w * w), 4) AS total_square FROM dense GROUP BY sampleId"


@query("pca_gram", "dense", sql=WHOLE)
def _(spark, sf):
    reduced = R.pca_gram(region_vectors(spark, sf), k=64, threshold=1.0)
    return _lengths(reduced.withColumn("pcs", vector_to_array("pcaFeatures")))


@query("pca_power", "dense", sql=WHOLE)
def _(spark, sf):
    return _lengths(R.pca_power(X.dense(spark, sf), 64, 1.0))


@query("pca_randomized", "dense", sql=WHOLE)
def _(spark, sf):
    return _lengths(R.pca_randomized(X.dense(spark, sf), 64, 1.0))


@query("pca_glrm")
def _(spark, sf):
    return R.component_table(R.pca_glrm(X.dense(spark, sf), 4), ["sampleId"], 4)


# Eigenvectors weighted with their eigenvalues give back the diagonal of the relationship matrix.
@query(
    "grm_pca", "dense",
    sql="""SELECT d.sampleId, (SELECT count(*) FROM (SELECT idx FROM dense GROUP BY idx HAVING min(dosage) < max(dosage)
        AND count(dosage) >= (SELECT count(DISTINCT sampleId) FROM dense) * CAST(0.95 AS DOUBLE))) AS components,
      round(sum((d.dosage - s.m) * (d.dosage - s.m) / (s.p * (1 - s.p))), 4) + 0.0 AS diagonal FROM dense d
    JOIN (SELECT idx, avg(dosage) AS m, (1 + sum(dosage)) / CAST(2 + 2 * count(dosage) AS DOUBLE) AS p FROM dense WHERE dosage IS NOT NULL
      GROUP BY idx HAVING min(dosage) < max(dosage)
        AND count(dosage) >= (SELECT count(DISTINCT sampleId) FROM dense) * CAST(0.95 AS DOUBLE)) s ON s.idx = d.idx
    WHERE d.dosage IS NOT NULL GROUP BY d.sampleId""",
)
def _(spark, sf):
    found = R.grm_pca(X.dense(spark, sf), missing_rate=0.05)
    values = F.array(*[F.lit(float(v)) for v in found.values()])
    weighted = F.zip_with("pcs", values, lambda x, v: x * x * v)
    return found.keep(1.0).select(
        "sampleId", F.size("pcs").cast("long").alias("components"), r6(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x), 4).alias("diagonal")
    )


@query(
    "normalized_genotypes", "dense",
    sql="""SELECT d.sampleId AS i, d.idx AS j, round((d.dosage - s.m) / sqrt(s.p * (1 - s.p)), 6) + 0.0 AS v FROM dense d
    JOIN (SELECT idx, avg(dosage) AS m, (1 + sum(dosage)) / CAST(2 + 2 * count(dosage) AS DOUBLE) AS p FROM dense WHERE dosage IS NOT NULL
      GROUP BY idx HAVING min(dosage) < max(dosage)
        AND count(dosage) >= (SELECT count(DISTINCT sampleId) FROM dense) * CAST(0.95 AS DOUBLE)
        AND least(sum(dosage) / CAST(2 * count(dosage) AS DOUBLE), 1 - sum(dosage) / CAST(2 * count(dosage) AS DOUBLE)) >= 0.4) s ON s.idx = d.idx
    WHERE d.dosage IS NOT NULL""",
)
def _(spark, sf):
    return rounded(R.normalized_genotypes(X.dense(spark, sf), 0.4, 0.05), "v")


@query(
    "snp_pc_correlation", "dense",
    sql="""SELECT d.idx, s.pc, round(corr(d.dosage, s.q), 6) + 0.0 AS correlation FROM dense d
    JOIN (SELECT sampleId, idx + 1 AS pc, w AS q FROM dense WHERE idx < 4) s ON s.sampleId = d.sampleId WHERE d.dosage IS NOT NULL GROUP BY d.idx, s.pc""",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    scores = RS.feature_arrays(long, ["sampleId"], "idx", "w", "pcs")
    return rounded(R.snp_pc_correlation(long, scores, 4), "correlation")


@query(
    "chi_square", "dense",
    sql="""SELECT r.idx, round(sum((coalesce(o.n, 0) - r.n * c.n / CAST(t.n AS DOUBLE)) * (coalesce(o.n, 0) - r.n * c.n / CAST(t.n AS DOUBLE)) / (r.n * c.n / CAST(t.n AS DOUBLE))), 6) AS chi_square
    FROM (SELECT idx, super_pop, count(dosage) AS n FROM dense WHERE dosage IS NOT NULL GROUP BY ALL) r
    JOIN (SELECT idx, dosage, count(*) AS n FROM dense WHERE dosage IS NOT NULL GROUP BY ALL) c ON c.idx = r.idx
    JOIN (SELECT idx, count(dosage) AS n FROM dense GROUP BY ALL) t ON t.idx = r.idx
    LEFT JOIN (SELECT idx, super_pop, dosage, count(*) AS n FROM dense WHERE dosage IS NOT NULL GROUP BY ALL) o
      ON o.idx = r.idx AND o.super_pop = r.super_pop AND o.dosage = c.dosage
    GROUP BY r.idx""",
)
def _(spark, sf):
    return rounded(R.chi_square(X.dense(spark, sf)), "chi_square")


# ---------------------------------------------------------------- distances
# Missing genotypes count as zeros.

FULL = """, full_dense AS (SELECT sampleId, idx, coalesce(dosage, 0) AS dosage FROM dense)"""
DIST = FULL + """
SELECT a.sampleId AS i, b.sampleId AS j, round({e}, 6) AS dist FROM full_dense a JOIN full_dense b ON a.idx = b.idx AND a.sampleId < b.sampleId GROUP BY a.sampleId, b.sampleId"""


@query("dist_minkowski", "dense", sql=DIST.format(e="pow(sum(pow(abs(CAST(a.dosage - b.dosage AS DOUBLE)), 3)), 1 / CAST(3 AS DOUBLE))"))
def _(spark, sf):
    return rounded(DI.distance_matrix(X.dense(spark, sf), "minkowski", 3), "dist")


@query("dist_euclidean", "dense", sql=DIST.format(e="sqrt(CAST(sum((a.dosage - b.dosage) * (a.dosage - b.dosage)) AS DOUBLE))"))
def _(spark, sf):
    return rounded(DI.distance_matrix(X.dense(spark, sf), "euclidean"), "dist")


@query("dist_manhattan", "dense", sql=DIST.format(e="CAST(sum(abs(a.dosage - b.dosage)) AS DOUBLE)"))
def _(spark, sf):
    return rounded(DI.distance_matrix(X.dense(spark, sf), "manhattan"), "dist")


@query("dist_hamming", "dense", sql=DIST.format(e="CAST(count(*) FILTER (WHERE a.dosage <> b.dosage) AS DOUBLE)"))
def _(spark, sf):
    return rounded(DI.distance_matrix(X.dense(spark, sf), "hamming"), "dist")


@query(
    "distance_matrix", "dense",
    sql="""SELECT a.sampleId AS i, b.sampleId AS j, round(sqrt(sum((a.w - b.w) * (a.w - b.w))), 6) AS dist
    FROM dense a JOIN dense b ON a.idx = b.idx GROUP BY a.sampleId, b.sampleId""",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    full = DI.mirror(DI.distance_matrix(long, value="w"), long.select("sampleId").distinct())
    return rounded(full, "dist")


@query(
    "mds_double_centre", "dense",
    sql=FULL + """, d AS (SELECT a.sampleId AS i, b.sampleId AS j, CAST(sum((a.dosage - b.dosage) * (a.dosage - b.dosage)) AS DOUBLE) AS d2
      FROM full_dense a JOIN full_dense b ON a.idx = b.idx GROUP BY a.sampleId, b.sampleId),
    m AS (SELECT i, avg(d2) AS m FROM d GROUP BY i), g AS (SELECT avg(d2) AS g FROM d)
    SELECT d.i, d.j, round(-0.5 * (d2 - a.m - b.m + g), 6) + 0.0 AS b FROM d JOIN m a ON a.i = d.i JOIN m b ON b.i = d.j, g WHERE d.i <= d.j""",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    return rounded(DI.mds_double_centre(DI.distance_matrix(long), DI.square_sums(long)), "b")


# All coordinates together are as long as the sample is far from the centre.
@query(
    "mds_classic", "dense",
    sql="""SELECT d.sampleId, 64 AS components, round(sum((d.w - m.m) * (d.w - m.m)), 4) AS total_square FROM dense d
    JOIN (SELECT idx, avg(w) AS m FROM dense GROUP BY idx) m ON m.idx = d.idx GROUP BY d.sampleId""",
)
def _(spark, sf):
    return _lengths(R.mds_classic(X.dense(spark, sf), k=64, threshold=1.0))


@query("mds_classic_manhattan")
def _(spark, sf):
    scores = R.mds_classic(X.dense(spark, sf), "manhattan", k=4, threshold=0.99)
    return rounded(R.component_table(scores, ["sampleId"], 4), *[f"PC{i + 1}" for i in range(4)])


@query(
    "column_similarities", "dense",
    sql="""SELECT CAST(a.idx AS BIGINT) AS i, CAST(b.idx AS BIGINT) AS j, round(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))), 6) + 0.0 AS similarity
    FROM dense a JOIN dense b ON a.sampleId = b.sampleId AND a.idx < b.idx GROUP BY a.idx, b.idx""",
)
def _(spark, sf):
    return rounded(R.column_similarities(region_vectors(spark, sf)), "similarity")
