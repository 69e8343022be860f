"""Jobs whose frequency range leaves no variant."""

import pytest
from locusflow.plans import jobs as J
from locusflow.sources.params import JobParams


def tables(spark):
    rows = [(f"s{k}", "1", 1000 * (v + 1), 1000 * (v + 1) + 1, "A", "C", ["Ref", "Alt" if (k + v) % 3 else "Ref"]) for k in range(12) for v in range(5)]
    calls = spark.createDataFrame(rows, "sampleId string, contig string, start long, end long, ref string, alt string, alleles array<string>")
    catalog = calls.select("contig", "start", "ref", "alt").distinct().selectExpr("*", "0.5D AS frequency")
    panel = spark.createDataFrame([(f"s{k}", f"P{k % 2}", f"Q{k % 2}") for k in range(12)], "sampleId string, pop string, super_pop string")
    return calls, catalog, panel


@pytest.mark.parametrize("method", ["pcaH2O", "MDS", "", None])
def test_no_variant_in_range(spark, tmp_path, method):
    calls, catalog, panel = tables(spark)
    files = {k: str(tmp_path / k) for k in ("cluster_df_file", "class_train_file", "class_test_file")}
    params = JobParams(
        "", "", frequencies=True, inf_freq=0.6, sup_freq=0.7, dim_reduction=method is not None, dim_red_method=method or "PCA", clustering=True,
        clustering_method="kmeans", n_repeat_clustering=1, classification=True, classification_method="dt", n_repeat_classification=1,
        outliers=True, ld_pruning=True, **files,
    )
    found = J.stratify(calls, catalog, panel, params)
    assert found.metrics().count() == 0 and found.features.count() == 0
    assert found.clusters.count() == 0 and found.outliers.count() == 0
    for path in files.values():
        assert spark.read.csv(path, header=True).count() == 0


def test_drilldown_without_variants(spark):
    long = spark.createDataFrame([(f"s{k}", "1", v, 1000 * v, k % 3) for k in range(6) for v in range(3)], "sampleId string, contig string, idx int, start long, dosage int")
    clusters = spark.createDataFrame([(f"s{k}", k % 2) for k in range(6)], "sampleId string, Predict int")
    panel = tables(spark)[2]
    assert J.subpopulation_drilldown(long, clusters, panel, low=2.0, high=3.0).count() == 0
