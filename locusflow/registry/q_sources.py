"""Readers and writers, each over a file that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import calls as P
from ..operators import catalog as A
from ..operators import reshape as RS
from ..plans import jobs as J
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import writers as W
from ..sources.params import load_job_params
from .base import alleles_out, query, rounded
from .q_calls import CALL, DOSE_COUNT, N_RAW
from .q_catalog import CELL_CATALOG, PC64, PC_SQL, flat_catalog
from .q_metrics import CM, _cm

PC19 = [f"PC{i + 1}" for i in range(19)]
PC19_SQL = "SELECT sampleId AS SampleId, super_pop AS Region, " + ", ".join(
    f"round(max(w) FILTER (WHERE idx = {i}), 6) AS PC{i + 1}" for i in range(19)
) + " FROM dense GROUP BY sampleId, super_pop"


def _components(spark, sf):
    vectors = RS.feature_vectors(X.dense(spark, sf).select(F.col("sampleId").alias("SampleId"), F.col("super_pop").alias("Region"), "idx", "w"), ["SampleId", "Region"])
    return RS.pc_columns(vectors, ["SampleId", "Region"], 64, "features")


@query("read_genotypes", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw")
def _(spark, sf):
    path = W.write_parquet(X.gts_nested(spark, sf), scratch_path(spark, "genotypes"))
    RD.read_genotypes(spark, path, "gts")
    return alleles_out(P.flatten_calls(spark.table("gts")))


@query("read_panel", "panel", sql="SELECT sampleId, super_pop AS Region FROM panel WHERE super_pop IN ('AFRICA', 'AMERICA', 'ASIA')")
def _(spark, sf):
    panel = X.panel(spark, sf).withColumnRenamed("sampleId", "sample")
    path = W.write_csv(panel, scratch_path(spark, "panel"), sep="\t")
    return RD.read_panel(spark, path, "super_pop", ["AFRICA", "AMERICA", "ASIA"])


@query("read_variant_catalog", "gts_cell", sql=CELL_CATALOG)
def _(spark, sf):
    path = W.write_parquet(J.build_variant_catalog(X.gts_cell(spark, sf)), scratch_path(spark, "catalog"))
    return flat_catalog(RD.read_variant_catalog(spark, path))


@query("read_feature_csv", "dense", sql=PC19_SQL)
def _(spark, sf):
    path = W.write_csv2(_components(spark, sf), scratch_path(spark, "components"))
    return rounded(RD.read_feature_csv(spark, path), *PC19)


@query(
    "read_variant_frequency_csv", "gts_raw",
    sql=f"""SELECT contig || ':' || CAST(start AS VARCHAR) AS snpIdx, round(alt_total / CAST({N_RAW} AS DOUBLE), 6) AS frequency FROM ({DOSE_COUNT}) c""",
)
def _(spark, sf):
    table = A.freq_dosage(X.gts_raw(spark, sf)).withColumnRenamed("contig", "contigName")
    path = W.write_csv(table, scratch_path(spark, "frequencies"))
    return rounded(RD.read_variant_frequency_csv(spark, path), "frequency")


@query(
    "read_predictions", "dense",
    sql=PC_SQL.replace("SELECT sampleId, super_pop AS Region, ", "SELECT sampleId AS SampleId, super_pop AS Region, CAST(substr(super_pop, 2) AS DOUBLE) AS label, CAST(substr(pop, 2) AS DOUBLE) AS prediction, ").replace(
        "GROUP BY sampleId, super_pop", "GROUP BY sampleId, super_pop, pop"),
)
def _(spark, sf):
    long = X.dense(spark, sf).select(F.col("sampleId").alias("SampleId"), F.col("super_pop").alias("Region"), "pop", "idx", "w")
    table = RS.feature_vectors(long, ["SampleId", "Region", "pop"])
    number = lambda c: F.substring(c, 2, 9).cast("double")
    table = table.select("Region", "SampleId", "features", number("Region").alias("label"), number("pop").alias("Predict"))
    path = W.write_csv(table, scratch_path(spark, "predictions"))
    return rounded(RD.read_predictions(spark, path, 64), *PC64)


@query("write_parquet", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw")
def _(spark, sf):
    path = W.write_parquet(X.gts_raw(spark, sf), scratch_path(spark, "out"))
    return alleles_out(spark.read.parquet(path).select("sampleId", "contig", "start", "end", "ref", "alt", "alleles"))


@query("write_csv", "dense", sql=PC_SQL)
def _(spark, sf):
    vectors = RS.feature_vectors(X.dense(spark, sf).withColumnRenamed("super_pop", "Region"), ["sampleId", "Region"])
    path = W.write_csv(vectors, scratch_path(spark, "out"))
    back = spark.read.schema("sampleId string, Region string, features string").csv(path, header=True, quote='"', escape='"')
    return rounded(RS.vector_text_to_columns(back, 64), *PC64)


@query("write_csv2", "dense", sql=PC_SQL.replace("SELECT sampleId,", "SELECT sampleId AS SampleId,"))
def _(spark, sf):
    path = W.write_csv2(_components(spark, sf), scratch_path(spark, "out"))
    return rounded(RD.read_feature_csv(spark, path, n_pc=None), *PC64)


@query("write_single_file", "pred", sql=CM)
def _(spark, sf):
    path = W.write_single_file(_cm(spark, sf), scratch_path(spark, "report") + ".csv")
    return spark.read.schema("y string, p string, n bigint").csv(path, header=True)


_SETTINGS = """
SELECT 'population_set' AS name, region AS value FROM (SELECT DISTINCT super_pop AS region FROM panel) r
UNION ALL SELECT 'ld_max_bp', CAST(max(start) AS STRING) FROM gts_raw
UNION ALL SELECT 'n_repeat_clustering', CAST(count(DISTINCT sampleId) AS STRING) FROM gts_raw
UNION ALL SELECT 'ld_threshold', '0.25' UNION ALL SELECT 'clustering', 'true' UNION ALL SELECT 'chr_frequencies_file', 'null'
"""


@query("load_job_params", "panel", "gts_raw", sql=_SETTINGS.replace("STRING", "VARCHAR"))
def _(spark, sf):
    """A parameter file written from the tables, read back with its types."""
    calls = X.gts_raw(spark, sf)
    regions = X.panel(spark, sf).agg(F.array_join(F.array_sort(F.collect_set("super_pop")), "/").alias("value"))
    lines = regions.select(F.lit("population_set").alias("key"), "value")
    for key, value in (
        ("ld_max_bp", F.max("start")), ("n_reapeat_clustering", F.count_distinct("sampleId")), ("ld_treshold", F.lit(0.25)), ("clustering", F.lit("TRUE")),
        ("chr_frequencies_file", F.lit("null")), ("chr_file", F.lit("calls")), ("panel_file", F.lit("panel")),
    ):
        lines = lines.unionByName(calls.agg(value.cast("string").alias("value")).select(F.lit(key).alias("key"), "value"))
    path = W.write_csv(lines, scratch_path(spark, "parameters"))
    got = load_job_params(spark, path)
    rows = [("population_set", p) for p in got.population_set]
    rows += [("ld_max_bp", str(got.ld_max_bp)), ("n_repeat_clustering", str(got.n_repeat_clustering)), ("ld_threshold", str(got.ld_threshold))]
    rows += [("clustering", str(got.clustering).lower()), ("chr_frequencies_file", got.chr_frequencies_file or "null")]
    return spark.createDataFrame(rows, "name string, value string")
