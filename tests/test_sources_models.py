import os
import tempfile

import numpy as np
import pytest
from locusflow.operators import classify as K
from locusflow.operators import cluster as C
from locusflow.plans import jobs as J
from locusflow.session import shared_dir
from locusflow.sources import params as PR
from locusflow.sources import readers as RD
from locusflow.sources import writers as W
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

# A parameter file in the expected form.
PARAMETERS = {
    "chr_file": "calls", "panel_file": "panel", "population": "super_pop", "population_set": "AFR/EUR/AMR/SAS/EAS",
    "transformWithR": "TRUE", "missing_rate": "0", "frequencies": "TRUE", "inf_freq": "0.9", "sup_freq": "1", "ld_pruning": "FALSE",
    "ld_method": "composite", "ld_treshold": "0.2", "ld_max_bp": "500000", "ld_max_n": "500000", "outliers": "FALSE",
    "dim_reduction": "TRUE", "dim_red_method": "PCA", "pca_method": "GramSVD", "mds_method": "Metric", "clustering": "FALSE",
    "clustering_method": "gmm", "cv_clustering": "FALSE", "n_reapeat_clustering": "5", "classification": "TRUE",
    "classification_method": "svm", "cv_classification": "TRUE", "n_reapeat_classification": "2", "cluster_df_file": "null",
    "class_train_file": "null", "class_test_file": "null", "chr_frequencies_file": "f", "chr_frequencies_file_output": "o",
}


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_parameter_file(spark, folder):
    path = os.path.join(folder, "params.csv")
    with open(path, "w") as f:
        f.write("Parameter,Value\n" + "".join(f"{k}, {v}\n" for k, v in PARAMETERS.items()))
    got = PR.load_job_params(spark, path)
    assert got.population_set == ["AFR", "EUR", "AMR", "SAS", "EAS"]
    assert (got.inf_freq, got.sup_freq, got.ld_max_bp, got.n_repeat_clustering) == (0.9, 1.0, 500_000, 5)
    assert got.transform_with_r and got.cv_classification and not got.clustering
    assert got.cluster_df_file is None


@pytest.mark.parametrize(
    "key, value",
    [("missing_rate", "-0.1"), ("missing_rate", "1.5"), ("ld_treshold", "2"), ("ld_max_n", "-1"), ("ld_method", "cosine"), ("pca_method", "Other"), ("clustering", "maybe")],
)
def test_bad_parameters_raise(key, value):
    with pytest.raises(ValueError):
        PR.job_params(PARAMETERS | {key: value})


def test_frequencies_off_opens_the_range():
    got = PR.job_params(PARAMETERS | {"frequencies": "FALSE"})
    assert (got.inf_freq, got.sup_freq) == (0.0, 1.0)


def test_component_file_reads_points_and_commas_and_rejects_text(spark, folder):
    def write(name, cell):
        path = os.path.join(folder, name)
        with open(path, "w") as f:
            f.write(f"SampleId;Region;PC1;PC2\na;X;{cell};2.5\n")
        return RD.read_feature_csv(spark, path, n_pc=2)

    assert tuple(write("a.csv", "1,25").first()) == ("a", "X", 1.25, 2.5)
    with pytest.raises(Exception, match="not a number"):
        write("b.csv", "oops").collect()
    with pytest.raises(ValueError):
        RD.read_feature_csv(spark, os.path.join(folder, "a.csv"), n_pc=19)


def test_single_file(spark, folder):
    path = W.write_single_file(spark.range(5), os.path.join(folder, "out.csv"))
    with open(path) as f:
        assert sorted(f.read().split()) == ["0", "1", "2", "3", "4", "id"]
    assert [n for n in os.listdir(folder) if not n.startswith(".")] == ["out.csv"]


def test_panel_levels(spark, folder):
    path = os.path.join(folder, "panel.tsv")
    with open(path, "w") as f:
        f.write("sample\tpop\tsuper_pop\tgender\nS1\tGBR\tEUR\tmale\nS2\tYRI\tAFR\tfemale\n")
    assert {tuple(r) for r in RD.read_panel(spark, path, "pop").collect()} == {("S1", "GBR"), ("S2", "YRI")}
    assert {tuple(r) for r in RD.read_panel(spark, path, "super_pop", ["AFR"]).collect()} == {("S2", "AFR")}


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = FakeContext(master, folder)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_shared_folder_comes_from_the_session():
    assert shared_dir(FakeSession("spark://host:1", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(FakeSession("spark://host:1", None, "hdfs:///other")) == "hdfs:///other"
    assert shared_dir(FakeSession("local[2]")).startswith("/tmp/locusflow-")
    with pytest.raises(ValueError):
        shared_dir(FakeSession("spark://host:1"))


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(21)
    centres = np.array([[5, 4], [-5, 4], [0, -6]])
    rows = [(f"s{i:03d}", f"g{i % 3}", [float(v) for v in centres[i % 3] + rng.normal(0, 0.4, 2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "sampleId string, Region string, v array<double>")
    return df.select("sampleId", "Region", array_to_vector("v").alias("features")).coalesce(1).persist()


@pytest.mark.parametrize("method", C.METHODS)
def test_clusterings_find_separate_groups(groups, method):
    assert C.repeat_purity(groups, method, reps=1).first()["purity"] > 0.6


def test_k_choice(groups):
    tuned = {r["k"]: r["purity"] for r in C.tune_k(groups, "bkm", (1, 3), 1).collect()}
    assert tuned[3] > tuned[1]
    with pytest.raises(ValueError):
        C.fit_predict(groups, groups, "other", 3)


@pytest.mark.parametrize("method", K.FITS)
def test_classifiers(groups, method):
    metrics = K.repeat_classification(groups, method, 1, cv=False).collect()
    errors = {r["split"]: r["value"] for r in metrics if r["metric"] == "error"}
    assert errors["train"] < 0.1 and errors["test"] < 0.2


def test_error_is_one_minus_weighted_f1(groups):
    model = K.decision_tree(groups, cv=False, depth=(4,))
    predicted, error = K.predict_and_error(model, groups.withColumn("features", F.col("features")))
    ours = K.prediction_metrics(predicted, "all", 0).filter("metric = 'error'").first()["value"]
    assert ours == pytest.approx(error, abs=1e-9)
    assert "If (feature" in K.model_description(model)


def test_svm_search(groups):
    model = K.svm(groups, folds=2, cost=(0.01, 1.0), max_iter=(5,))
    assert K.predict_and_error(model, groups)[1] < 0.1


def test_stage_clock(spark):
    clock = J.StageClock()
    assert clock.run("a", lambda: 5) == 5
    rows = J.stage_report(spark.createDataFrame([("x", 3_723_000), ("y", 999)], "stage string, milliseconds bigint"))
    assert [r["elapsed"] for r in rows.orderBy("stage").collect()] == ["1hrs, 2mins, 3sec", "0sec"]
    assert clock.report(spark).count() == 1


# ---------------------------------------------------------------- jobs from a parameter file


def _parameter_file(folder, **values):
    path = os.path.join(folder, "params.csv")
    base = PARAMETERS | {"population_set": "AFRICA/AMERICA/ASIA/EUROPE/MIDDLE EAST", "transformWithR": "FALSE", "mds_method": "classic"}
    with open(path, "w") as f:
        f.write("".join(f"{k}, {v}\n" for k, v in (base | values).items()))
    return path


@pytest.fixture(scope="module")
def files(spark, sf_dir):
    from locusflow import fixtures as X

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    out = {"chr_file": os.path.join(folder, "calls"), "panel_file": os.path.join(folder, "panel"), "catalog": os.path.join(folder, "catalog")}
    W.write_parquet(X.gts_nested(spark, sf_dir), out["chr_file"])
    W.write_csv(X.panel(spark, sf_dir).withColumnRenamed("sampleId", "sample"), out["panel_file"], sep="\t")
    from locusflow.operators import catalog as A

    W.write_parquet(A.attach_genotypes(A.snp_index(A.variant_catalog(X.gts_raw(spark, sf_dir), complete=False)), X.gts_raw(spark, sf_dir)), out["catalog"])
    return out


def test_run_job_builds_the_catalogue(spark, files, folder):
    path = _parameter_file(folder, chr_file=files["chr_file"], chr_frequencies_file="null", chr_frequencies_file_output=os.path.join(folder, "out"))
    built = J.run_job(spark, path)
    assert built.columns[0] == "snpIdx" and built.count() == RD.read_variant_catalog(spark, os.path.join(folder, "out")).count()


def test_run_job_stratifies_from_files(spark, files, folder):
    path = _parameter_file(
        folder, chr_file=files["chr_file"], panel_file=files["panel_file"], chr_frequencies_file=files["catalog"], missing_rate="1", inf_freq="0.05", sup_freq="0.6",
        clustering="TRUE", clustering_method="kmeans", n_reapeat_clustering="1", classification="FALSE", dim_red_method="pcaH2O", ld_pruning="TRUE", ld_treshold="0.9",
    )
    result = J.run_job(spark, path)
    assert result.features.count() > 0 and {r["Region"] for r in result.features.select("Region").distinct().collect()} <= {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Unknown"}
    assert result.chosen_k == 5 and result.purity is not None


def test_run_job_from_components(spark, folder):
    from pyspark.sql import Row

    rows = [Row(SampleId=f"s{k}", Region="AB"[k % 2], **{f"PC{i}": float(k % 2) * 5 + 0.1 * ((k * i) % 3) for i in range(1, 20)}) for k in range(40)]
    table = W.write_csv2(spark.createDataFrame(rows), os.path.join(folder, "components"))
    path = _parameter_file(folder, chr_file=table, transformWithR="TRUE", classification_method="dt", cv_classification="FALSE", population_set="A/B")
    assert J.run_job(spark, path).metrics().count() > 0


def test_run_job_rejects_what_it_cannot_do(spark, files, folder):
    path = _parameter_file(folder, chr_file=files["chr_file"], panel_file=files["panel_file"], chr_frequencies_file=files["catalog"], dim_red_method="MDS", mds_method="Metric")
    with pytest.raises(ValueError):
        J.run_job(spark, path)
