"""Readers: every file is read with a stated schema, nothing is inferred by scanning the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import variant_id2
from ..functions.text import from_decimal_comma
from ..operators.reshape import vector_text_to_columns
from ..schema import GENOTYPE_CALL, VARIANT_CATALOG

#: Components kept from a component file.
COMPONENTS = 19


def read_genotypes(spark: SparkSession, path: str, view: str | None = "gts") -> DataFrame:
    """Nested genotype Parquet, also registered as a temporary view."""
    df = spark.read.schema(GENOTYPE_CALL).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_panel(spark: SparkSession, path: str, level: str = "super_pop", keep: Iterable[str] | None = None) -> DataFrame:
    """Tab-separated panel → ``(sampleId, Region)``.

    ``level="pop"`` takes the second column, anything else the third. A header line disappears because
    its text is not among the kept populations; without ``keep`` it is dropped by its own text.
    """
    raw = spark.read.schema("sample string, pop string, super_pop string").csv(path, sep="\t", header=False)
    picked = raw.select(F.col("sample").alias("sampleId"), F.col("pop" if level == "pop" else "super_pop").alias("Region"))
    if keep is None:
        return picked.filter(F.col("sampleId") != "sample")
    return picked.filter(F.col("Region").isin(list(keep)))


def read_variant_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue written by the catalogue job; its partitioning is left to the scan."""
    return spark.read.schema(VARIANT_CATALOG).parquet(path)


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names from the first line of a delimited file."""
    return spark.read.csv(path, sep=sep, header=True).columns


def read_feature_csv(spark: SparkSession, path: str, sep: str = ";", n_pc: int | None = COMPONENTS) -> DataFrame:
    """``SampleId, Region, PC1..PCn``; decimal points and commas are both read, other text raises."""
    names = _header(spark, path, sep)
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep=sep, header=True, enforceSchema=False)
    features = [n for n in names if n not in ("SampleId", "Region")]
    if n_pc is not None:
        wanted = [f"PC{i}" for i in range(1, n_pc + 1)]
        missing = [c for c in wanted if c not in features]
        if missing:
            raise ValueError(f"{path}: no column {missing[0]}")
        features = wanted
    return raw.select("SampleId", "Region", *[from_decimal_comma(f"`{c}`").alias(c) for c in features])


def read_variant_frequency_csv(spark: SparkSession, path: str) -> DataFrame:
    """``contig:start`` key and frequency from a variant table that may hold more columns."""
    names = _header(spark, path, ",")
    types = {"start": "bigint", "frequency": "double"}
    schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(variant_id2("contigName", "start").alias("snpIdx"), "frequency")


def read_predictions(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Prediction table with its feature text split into ``PC1..PCk``.

    Takes both layouts: ``Region, pcaFeatures, label, prediction`` and
    ``Region, SampleId, features, label, Predict``.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    renamed = {"pcaFeatures": "features", "Predict": "prediction"}
    for old, new in renamed.items():
        if old in raw.columns:
            raw = raw.drop(new).withColumnRenamed(old, new)
    keys = [c for c in ("SampleId", "Region") if c in raw.columns]
    typed = raw.select(*keys, F.col("label").cast("double"), F.col("prediction").cast("double"), "features")
    return vector_text_to_columns(typed, k)
