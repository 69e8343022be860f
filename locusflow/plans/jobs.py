"""Batch jobs: compositions of the operators, each with one result."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import format_duration
from ..operators import calls as P
from ..operators import catalog as A
from ..operators import classify as K
from ..operators import cluster as C
from ..operators import distance as DI
from ..operators import ld as L
from ..operators import metrics as M
from ..operators import reduce as R
from ..operators import reshape as RS
from ..operators import sampling as Q
from ..operators.halves import half_masks
from ..session import broadcast_if_small, cut_lineage
from ..sources import writers as W
from ..sources.params import JobParams, load_job_params
from ..sources.readers import read_feature_csv, read_genotypes, read_panel, read_variant_catalog


class StageClock:
    """Elapsed time per stage of a job."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, int]] = []

    def run(self, stage: str, work):
        begun = time.monotonic()
        result = work()
        self.stages.append((stage, int((time.monotonic() - begun) * 1000)))
        return result

    def report(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.stages, "stage string, milliseconds bigint")
        return stage_report(rows)


def stage_report(stages: DataFrame) -> DataFrame:
    """``(stage, milliseconds)`` with the elapsed text."""
    return stages.withColumn("elapsed", format_duration("milliseconds"))


# ---------------------------------------------------------------- catalogue and matrices


def build_variant_catalog(calls: DataFrame, strict_biallelic: bool = False) -> DataFrame:
    """Numbered catalogue of the SNPs that every sample has a call for."""
    counted = cut_lineage(A.variant_catalog(calls, complete=True, strict_biallelic=strict_biallelic))
    columns = ["snpIdx", *P.VARIANT, "nonmissing", "frequency", "genotype"]
    return A.attach_genotypes(A.snp_index(counted), calls).select(*columns)


def build_variant_catalog_job(spark: SparkSession, genotype_path: str, out: str, csv: bool = True) -> DataFrame:
    """Genotype source → catalogue as Parquet (and delimited text), read back."""
    calls = P.flatten_calls(read_genotypes(spark, genotype_path))
    W.write_parquet(build_variant_catalog(calls), out)
    stored = read_variant_catalog(spark, out)
    if csv:
        W.write_csv(stored, out + ".csv")
    return stored


def population_matrix_job(
    calls: DataFrame, panel: DataFrame, missing_rate: float = 0.0, low: float = 0.05, high: float = 1.0,
    by: str = "carriers", level: str = "super_pop",
) -> DataFrame:
    """Long sample x variant matrix with regions, filtered by carrier share or by allele counts."""
    if by == "carriers":
        matrix = A.population_matrix(calls, missing_rate, low, high)
    elif by == "alleles":
        kept = A.select_by_allele_counts(
            A.allele_number_and_alt_count(calls), P.sample_total(calls), missing_rate, low, high
        )
        matrix = P.prune_variants(P.sample_variants(calls), kept)
    else:
        raise ValueError(f"unknown filter {by!r}")
    return P.attach_region(matrix, panel, level)


# ---------------------------------------------------------------- stratification


@dataclass
class Stratification:
    """Results of a stratification run; parts that were not asked for, or had no samples, are ``None``."""

    features: DataFrame
    clusters: DataFrame | None = None
    purity: DataFrame | None = None
    chosen_k: int | None = None
    classification: DataFrame | None = None
    outliers: DataFrame | None = None
    clock: StageClock = field(default_factory=StageClock)

    def metrics(self) -> DataFrame:
        """All metrics as ``(part, split, label, metric, value)``."""
        spark = self.features.sparkSession
        schema = "part string, split string, label double, metric string, value double"
        out = spark.createDataFrame([], schema)
        if self.purity is not None:
            row = self.purity.select(
                F.lit("clustering").alias("part"), F.lit("all").alias("split"), F.lit(None).cast("double").alias("label"),
                F.lit("purity").alias("metric"), F.col("purity").alias("value"),
            )
            out = out.unionByName(row)
        if self.classification is not None:
            out = out.unionByName(self.classification.withColumn("part", F.lit("classification")))
        return out


def reduce_features(long: DataFrame, panel: DataFrame, params: JobParams, level: str, k: int = 20) -> DataFrame:
    """``(sampleId, Region, pcaFeatures)`` by the method the parameters name."""
    options = {"feature": "variantId", "value": "altCount"}
    if params.dim_red_method == "MDS":
        scores = R.mds_classic(long, k=k, at_least_one=True, **options)
    elif params.dim_red_method != "pcaH2O":
        scores = R.pca_wide(long, **options)
    elif params.pca_method == "GLRM":
        scores = R.pca_glrm(long, k, train=0.5, **options)
    elif params.pca_method == "Randomized":
        scores = R.pca_randomized(long, k, at_least_one=True, **options)
    elif params.pca_method == "Power":
        scores = R.pca_power(long, k, at_least_one=True, **options)
    else:
        scores = R.pca_gram_wide(long, k, at_least_one=True, **options)
    return P.attach_region(scores, panel, level).select("sampleId", "Region", array_to_vector("pcs").alias("pcaFeatures"))


def assign(features: DataFrame, params: JobParams, result: Stratification, column: str = "pcaFeatures") -> Stratification:
    """Clustering and classification steps shared by both stratification jobs."""
    if features.isEmpty():
        return _assign_nothing(features, params, result, column)
    if params.clustering:
        k = len(params.population_set) or features.agg(F.count_distinct("Region")).first()[0]
        method, reps = params.clustering_method, params.n_repeat_clustering
        if params.cv_clustering:
            best = A.best_k(C.tune_k(features, method, reps=reps, features=column))
            k = result.clock.run("choose k", lambda: best.first()["k"])
        result.chosen_k = k
        result.purity = result.clock.run(
            f"cluster: {method}", lambda: cut_lineage(C.repeat_purity(features, method, k, reps, column))
        )
        result.clusters = C.fit_predict(features, features, method, k, column)
        if params.cluster_df_file:
            W.write_csv(result.clusters, params.cluster_df_file)
    if params.classification:
        method = params.classification_method
        options = {"features": column, "cv": params.cv_classification}
        if method == "svm":
            options |= {"cost": (0.01, 0.1, 1.0, 10.0), "max_iter": (1,)}
        result.classification = result.clock.run(
            f"classify: {method}",
            lambda: cut_lineage(K.repeat_classification(features, method, params.n_repeat_classification, **options)),
        )
        if params.class_train_file or params.class_test_file:
            train, test = Q.train_test_split(features)
            model = K.FITS[method](train, indexer=K.label_indexer(features), **options)
            for rows, path in ((train, params.class_train_file), (test, params.class_test_file)):
                if path:
                    W.write_csv(model.transform(rows).select("Region", "prediction", "label", column), path)
    return result


def _assign_nothing(features: DataFrame, params: JobParams, result: Stratification, column: str) -> Stratification:
    """:func:`assign` without samples: nothing can be fitted, and the tables that were asked for are empty."""
    if params.clustering:
        result.clusters = C.single_cluster(features, column, "Region")
        if params.cluster_df_file:
            W.write_csv(result.clusters, params.cluster_df_file)
    if params.classification:
        labels = [F.lit(0.0).alias("prediction"), F.lit(0.0).alias("label")]
        for path in (params.class_train_file, params.class_test_file):
            if path:
                W.write_csv(features.select("Region", *labels, column), path)
    return result


def stratify(calls: DataFrame, catalog: DataFrame, panel: DataFrame, params: JobParams) -> Stratification:
    """Calls and catalogue → selected variants → outliers → reduction → clusters and classes."""
    level = params.population if params.population in ("pop", "super_pop") else "super_pop"
    if params.population_set:
        panel = P.panel_population_filter(panel, params.population_set, level)
    clock = StageClock()
    long = clock.run(
        "select variants by frequency",
        lambda: cut_lineage(A.sample_variant_dosage(calls, catalog, params.inf_freq, params.sup_freq)),
    )
    result = Stratification(features=long, clock=clock)
    if params.ld_pruning:
        located = _located(long)
        kept = clock.run(
            "prune variants by LD",
            lambda: cut_lineage(
                L.ld_prune(
                    located.withColumn("dosage", F.col("altCount")), params.ld_method, params.ld_threshold,
                    params.ld_max_bp, params.ld_max_n, idx="snpIdx",
                )
            ),
        )
        picked = located.join(kept.withColumnRenamed("idx", "snpIdx"), ["contig", "snpIdx"], "left_semi")
        long = picked.select("sampleId", "variantId", "altCount")
    if params.outliers:
        halves = half_masks(long)
        result.outliers = cut_lineage(Q.find_outliers(long, halves, variant="variantId", value="altCount"))
        long = Q.drop_outliers(long, result.outliers)
    if long.isEmpty():  # no variant in the frequency range: no sample has features
        schema = StructType().add("sampleId", StringType()).add("Region", StringType()).add("pcaFeatures", VectorUDT())
        result.features = long.sparkSession.createDataFrame([], schema)
    elif params.dim_reduction:
        result.features = clock.run(
            f"reduce dimensions: {params.dim_red_method}",
            lambda: RS.compact(reduce_features(long, panel, params, level)),
        )
    else:
        vectors = P.attach_region(R.filled_vectors(long, out="pcaFeatures"), panel, level)
        result.features = RS.compact(vectors)
    return assign(result.features, params, result)


def _located(long: DataFrame) -> DataFrame:
    """The matrix with contig, start and SNP number, taken from the variant ids themselves."""
    site = long.withColumns(
        {
            "contig": F.regexp_extract("variantId", r"^(.*):[^:]*$", 1),
            "start": F.regexp_extract("variantId", r":([^:]*)$", 1).cast("long"),
        }
    )
    sites = site.select("contig", "start").distinct().withColumns({"ref": F.lit(""), "alt": F.lit("")})
    return site.join(broadcast_if_small(A.snp_index(sites).select("contig", "start", "snpIdx")), ["contig", "start"])


def stratify_job(spark: SparkSession, params: JobParams, panel: DataFrame | None = None) -> Stratification:
    """The same from the files the parameters name; the catalogue is cut to the allowed missing rate."""
    if params.dim_reduction and params.dim_red_method == "MDS" and params.mds_method != "classic":
        raise ValueError(f"mds_method: no scaling {params.mds_method!r} here; classic only")
    calls = P.flatten_calls(read_genotypes(spark, params.chr_file))
    if panel is None:
        panel = read_panel(spark, params.panel_file, params.population, params.population_set or None)
    catalog = read_variant_catalog(spark, params.chr_frequencies_file)
    catalog = P.missing_rate_filter(catalog, P.sample_total(calls), params.missing_rate)
    return stratify(calls, catalog, panel, params)


def run_job(spark: SparkSession, params_path: str) -> DataFrame | Stratification:
    """Run what a parameter file asks for.

    Without a frequency file the catalogue is built and written; with ``transformWithR`` the features come from a
    component table; otherwise calls, catalogue and panel are stratified.
    """
    params = load_job_params(spark, params_path)
    if params.chr_frequencies_file is None:
        if params.chr_frequencies_file_output is None:
            raise ValueError("chr_frequencies_file_output: no place for the catalogue")
        return build_variant_catalog_job(spark, params.chr_file, params.chr_frequencies_file_output)
    if params.transform_with_r:
        return stratify_from_features_job(spark, params.chr_file, params)
    return stratify_job(spark, params)


def stratify_from_features(table: DataFrame, params: JobParams) -> Stratification:
    """Component table (``SampleId, Region, PC1..``) → clusters and classes."""
    components = [c for c in table.columns if c not in ("SampleId", "Region")]
    features = table.select(
        F.col("SampleId").alias("sampleId"), "Region", array_to_vector(F.array(*components)).alias("pcaFeatures")
    )
    features = RS.compact(features)
    return assign(features, params, Stratification(features=features))


def stratify_from_features_job(spark: SparkSession, path: str, params: JobParams) -> Stratification:
    return stratify_from_features(read_feature_csv(spark, path), params)


# ---------------------------------------------------------------- PCA grid, report, drill-down


def pca_grid_job(
    calls: DataFrame, frequencies: DataFrame, panel: DataFrame, low: float = 0.05, high: float = 0.5,
    ld_thresholds: Sequence[float] = (0.2,), mafs: Sequence[float | None] = (None,), variances: Sequence[float] = (0.1,),
    missing_rate: float | None = 0.0, out: str | None = None, level: str = "super_pop", method: str = "composite",
    max_bp: int | None = 500_000,
) -> DataFrame:
    """Relationship PCA over a grid of LD, frequency and variance settings.

    ``calls`` is the long dosage table with ``contig, idx, start``; ``frequencies`` holds ``snpIdx``
    (``contig:start``) and ``frequency``. Returns ``(ld, maf, variance, sampleId, Region, pcs)`` and writes
    one ``;`` separated file per grid point when ``out`` is given. A threshold of 0 skips pruning.
    """
    selected = P.frequency_range(frequencies, low, high).select("snpIdx")
    keyed = calls.withColumn("snpIdx", F.concat_ws(":", "contig", F.col("start").cast("string")))
    chosen = cut_lineage(keyed.join(selected, "snpIdx", "left_semi").drop("snpIdx"))
    pruned = None
    if any(t != 0 for t in ld_thresholds):
        pruned = cut_lineage(L.ld_prune_grid(chosen, [t for t in ld_thresholds if t], mafs, method, max_bp))
    result = None
    for threshold in ld_thresholds:
        for maf in mafs:
            rows = chosen
            if threshold:
                same = F.col("maf").isNull() if maf is None else F.col("maf") == maf
                kept = pruned.filter((F.col("threshold") == threshold) & same).select("contig", "idx")
                rows = chosen.join(kept, ["contig", "idx"], "left_semi")
            found = R.grm_pca(rows, maf if not threshold else None, missing_rate)
            for variance in variances:
                part = P.attach_region(found.keep(variance, at_least_one=True), panel, level)
                part = cut_lineage(part)
                if out:
                    width = part.select(F.size("pcs")).first()[0]
                    table = R.component_table(part.withColumnRenamed("sampleId", "SampleId"), ["SampleId", "Region"], width)
                    W.write_csv2(table, W.grid_path(out, threshold, maf, missing_rate, variance))
                part = part.select(
                    F.lit(float(threshold)).alias("ld"), F.lit(maf).cast("double").alias("maf"),
                    F.lit(float(variance)).alias("variance"), "sampleId", "Region", "pcs",
                )
                result = part if result is None else result.unionByName(part)
    return result


def evaluation_report_job(
    predictions: DataFrame, truth: str = "Region", predicted: str = "prediction", features: Sequence[str] = (), key: str = "SampleId"
) -> DataFrame:
    """All metrics of a prediction table; with ``features`` also the distance-based cluster indices."""
    cm = cut_lineage(M.confusion_matrix(predictions, truth, predicted))
    report = M.evaluation_report(cm)
    if features:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.col(c).alias("w")) for i, c in enumerate(features)]))
        long = predictions.select(key, F.col(predicted).alias("cluster"), cells.alias("_c")).select(key, "cluster", "_c.idx", "_c.w")
        long = cut_lineage(long)
        indices = DI.pair_indices(long, "cluster", key)
        for name, table in (
            ("calinski_harabasz", DI.calinski_harabasz(long, "cluster", key)), ("dunn", indices.select("dunn")), ("c_index", indices.select("c_index")),
        ):
            report = report.unionByName(M.as_long(table, name))
    return report


def subpopulation_drilldown(
    calls: DataFrame, clusters: DataFrame, panel: DataFrame, low: float = 0.05, high: float = 1.0, ld_threshold: float = 0.5,
    max_bp: int | None = 500_000, method: str = "composite",
) -> DataFrame:
    """Inside every predicted cluster: new frequency filter, pruning, PCA and k-means by sub-population.

    ``calls`` is the long dosage table; ``clusters`` holds ``sampleId, Predict``. Filtering and pruning cover
    all clusters at once; only the model fits run cluster by cluster.
    """
    members = clusters.select("sampleId", "Predict")
    known = calls.filter(F.col("dosage").isNotNull())
    own = cut_lineage(known.join(broadcast_if_small(members), "sampleId"))
    sizes = own.groupBy("Predict").agg(F.count_distinct("sampleId").alias("n"))
    carriers = own.groupBy("Predict", "contig", "idx").agg(F.count_if(F.col("dosage") > 0).alias("c"))
    share = carriers.join(F.broadcast(sizes), "Predict")  # one row per cluster
    share = share.select("Predict", "contig", "idx", (F.col("c") / F.col("n")).alias("frequency"))
    own = own.join(P.frequency_range(share, low, high), ["Predict", "contig", "idx"], "left_semi")
    # Clusters are pruned in one run: a contig of a cluster is a scan of its own.
    scans = own.withColumn("contig", F.concat_ws("/", F.col("Predict").cast("string"), "contig"))
    kept = L.ld_prune(scans, method, ld_threshold, max_bp)
    scans = cut_lineage(scans.join(kept, ["contig", "idx"], "left_semi"))
    result = None
    # A cluster that keeps no variant has no features; its samples get no row, like any sample without calls.
    for (cluster,) in scans.select("Predict").distinct().orderBy("Predict").collect():
        rows = scans.filter(F.col("Predict") == cluster)
        vectors = P.attach_region(R.filled_vectors(rows, feature="idx", value="dosage"), panel, "pop")
        reduced = RS.compact(R.pca_gram(RS.compact(vectors), train=1.0, at_least_one=True))
        k = reduced.agg(F.count_distinct("Region")).first()[0]
        part = C.fit_predict(reduced, reduced, "kmeans", k, "pcaFeatures").select(
            F.lit(cluster).alias("cluster"), "sampleId", "Region", F.col("Predict").alias("subcluster")
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        kind = clusters.schema["Predict"].dataType.simpleString()
        return calls.sparkSession.createDataFrame([], f"cluster {kind}, sampleId string, Region string, subcluster int")
    return result
