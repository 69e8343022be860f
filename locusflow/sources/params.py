"""Job parameters: ``key,value`` lines → checked dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Accepted names.
LD_METHODS = ("composite", "corr", "r", "dprime")
PCA_METHODS = ("GramSVD", "GLRM", "Power", "Randomized")
REDUCTIONS = ("PCA", "pcaH2O", "MDS")
MDS_METHODS = ("classic", "Metric")
CLUSTERINGS = ("kmeans_h2o", "kmeans", "gmm", "bkm")
CLASSIFIERS = ("svm", "dt", "rf")


@dataclass
class JobParams:
    chr_file: str
    panel_file: str
    population: str = "super_pop"
    population_set: list[str] = field(default_factory=list)
    transform_with_r: bool = False
    missing_rate: float = 0.0
    frequencies: bool = True
    inf_freq: float = 0.0
    sup_freq: float = 1.0
    ld_pruning: bool = False
    ld_method: str = "composite"
    ld_threshold: float = 0.2
    ld_max_bp: int = 500_000
    ld_max_n: int = 500_000
    outliers: bool = False
    dim_reduction: bool = True
    dim_red_method: str = "PCA"
    pca_method: str = "GramSVD"
    mds_method: str = "classic"
    clustering: bool = False
    clustering_method: str = "kmeans"
    cv_clustering: bool = False
    n_repeat_clustering: int = 5
    classification: bool = False
    classification_method: str = "svm"
    cv_classification: bool = False
    n_repeat_classification: int = 2
    cluster_df_file: str | None = None
    class_train_file: str | None = None
    class_test_file: str | None = None
    chr_frequencies_file: str | None = None
    chr_frequencies_file_output: str | None = None

    def __post_init__(self) -> None:
        if not self.frequencies:
            self.inf_freq, self.sup_freq = 0.0, 1.0
        for name in ("missing_rate", "inf_freq", "sup_freq", "ld_threshold", "ld_max_bp", "ld_max_n"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        for name in ("missing_rate", "ld_threshold"):
            if getattr(self, name) > 1:
                raise ValueError(f"{name} is greater than 1")
        for name, allowed in (
            ("ld_method", LD_METHODS), ("pca_method", PCA_METHODS), ("dim_red_method", REDUCTIONS),
            ("mds_method", MDS_METHODS), ("clustering_method", CLUSTERINGS), ("classification_method", CLASSIFIERS),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: no method {getattr(self, name)!r}; one of {', '.join(allowed)}")


# Parameter names in the file that differ from the field names.
FILE_NAMES = {
    "transformWithR": "transform_with_r",
    "ld_treshold": "ld_threshold",
    "n_reapeat_clustering": "n_repeat_clustering",
    "n_reapeat_classification": "n_repeat_classification",
}


def _typed(text: str, kind: str) -> object:
    if kind == "bool":
        if text.lower() not in ("true", "false"):
            raise ValueError(f"not a boolean: {text}")
        return text.lower() == "true"
    if kind == "float":
        return float(text)
    if kind == "int":
        return int(text)
    if kind.startswith("list"):
        return text.split("/")
    return None if text == "null" else text


def job_params(pairs: dict[str, str]) -> JobParams:
    kinds = {f.name: str(f.type) for f in JobParams.__dataclass_fields__.values()}
    values = {}
    for key, text in pairs.items():
        name = FILE_NAMES.get(key, key)
        if name in kinds:
            values[name] = _typed(text, kinds[name])
    return JobParams(**values)


def load_job_params(spark: SparkSession, path: str) -> JobParams:
    """Read a parameter file (a few dozen lines) and check it."""
    rows = spark.read.schema("key string, value string").csv(path)
    pairs = rows.select(F.trim("key").alias("key"), F.trim("value").alias("value")).collect()
    return job_params({r["key"]: r["value"] for r in pairs if r["key"] != "Parameter"})
