"""Genotype-shaped views over the driver tables.

Each view is one SQL text that Spark and the checking engine both understand, so queries and their
SQL checks start from the same rows. ``{table}`` placeholders are filled with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = """
SELECT concat('S', CAST(s_suppkey AS STRING)) AS sampleId, n_name AS pop, r_name AS super_pop
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

GTS_RAW = """
SELECT concat('S', CAST(l_suppkey AS STRING)) AS sampleId,
  CAST(l_partkey % 22 + 1 AS STRING) AS contig, l_partkey * 1000 AS start,
  CASE WHEN p_size % 10 = 0 THEN 'AC' ELSE substr('ACGT', p_size % 4 + 1, 1) END AS ref,
  CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN substr('GTAC', p_size % 4 + 1, 1)
       ELSE substr('CGTA', p_size % 4 + 1, 1) END AS alt,
  CASE l_returnflag WHEN 'A' THEN 'Alt' WHEN 'N' THEN 'Ref'
       ELSE CASE l_linenumber WHEN 1 THEN 'OtherAlt' WHEN 2 THEN 'NoCall' ELSE 'Ref' END END AS a0,
  CASE WHEN l_linestatus = 'O' THEN 'Alt' WHEN l_returnflag = 'R' AND l_linenumber = 1
       THEN 'OtherAlt' ELSE 'Ref' END AS a1
FROM lineitem JOIN part ON l_partkey = p_partkey"""

GTS_CELL = """
SELECT concat('S', CAST(l_suppkey AS STRING)) AS sampleId, replace(p_brand,'Brand#','') AS contig,
  CAST(ascii(substr(p_type,1,1))*1000 + ascii(substr(p_type,2,1))*10 AS BIGINT) AS start,
  CASE WHEN CAST(sum(l_linenumber) AS BIGINT) % 5 IN (0,1) THEN 'Alt'
       WHEN CAST(sum(l_linenumber) AS BIGINT) % 5 = 2 THEN 'OtherAlt' ELSE 'Ref' END AS a0,
  CASE WHEN CAST(floor(CAST(sum(l_linenumber) AS DOUBLE) / 5) AS BIGINT) % 3 = 0
       THEN 'Alt' ELSE 'Ref' END AS a1
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand, p_type"""

_DENSE = """
SELECT concat('V', CAST(vec_id AS STRING)) AS sampleId, concat('G', CAST(label % 5 AS STRING)) AS super_pop,
  concat('R', CAST(label AS STRING)) AS pop, CAST(i AS INT) AS idx,
  CAST(CAST(floor(i / 16.0) AS INT) + 1 AS STRING) AS contig, CAST((i % 16) * 1000 AS BIGINT) AS start,
  v + CAST(0.3 AS DOUBLE) * ((label * (i + 1)) % 5 - 2) AS w,
  CASE WHEN i % 4 = 3 AND (vec_id * 7 + i * 13) % 29 = 0 THEN NULL
       WHEN v < CAST(-0.055 AS DOUBLE) THEN 0 WHEN v < CAST(0.055 AS DOUBLE) THEN 1 ELSE 2 END AS dosage
FROM (@explode@) x"""

DENSE_SPARK = _DENSE.replace(
    "@explode@",
    "SELECT vec_id, label, i, CAST(e AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS i, e",
)
DENSE_SQL = _DENSE.replace(
    "@explode@",
    "SELECT vec_id, label, i, CAST(embedding[i+1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)",
)

DENSE_LD = """
SELECT d.sampleId, d.super_pop, d.pop, d.idx, d.contig, d.start, d.w,
  CASE WHEN d.idx % 2 = 1 AND CAST(substr(d.sampleId, 2) AS BIGINT) % 4 <> 0 THEN p.dosage ELSE d.dosage END AS dosage
FROM dense d LEFT JOIN dense p ON p.sampleId = d.sampleId AND p.idx = d.idx - 1"""

PRED = """
SELECT l_returnflag AS y, CASE WHEN l_linenumber <= 4 THEN l_returnflag WHEN l_linenumber <= 6
  THEN CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END ELSE 'N' END AS p FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, sf_dir: str, *names: str) -> DataFrame:
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PANEL, sf_dir, "supplier", "nation", "region")


def _with_alleles(df: DataFrame) -> DataFrame:
    return df.withColumn("alleles", F.array("a0", "a1")).drop("a0", "a1")


def gts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat calls: sampleId, contig, start, end, ref, alt, alleles."""
    flat = _with_alleles(_sql(spark, GTS_RAW, sf_dir, "lineitem", "part"))
    return flat.withColumn("end", F.col("start") + F.length("ref"))


def gts_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls in the nested layout of the genotype source table."""
    return gts_raw(spark, sf_dir).select(
        "sampleId",
        "alleles",
        F.struct(
            F.struct(F.col("contig").alias("contigName")).alias("contig"),
            F.col("start"),
            F.col("end"),
            F.col("ref").alias("referenceAllele"),
            F.col("alt").alias("alternateAllele"),
        ).alias("variant"),
    )


def gts_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _with_alleles(_sql(spark, GTS_CELL, sf_dir, "lineitem", "part"))
    return flat.select(
        "sampleId", "contig", "start", (F.col("start") + 1).alias("end"),
        F.lit("A").alias("ref"), F.lit("C").alias("alt"), "alleles",
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, DENSE_SPARK, sf_dir, "embeddings")


def dense_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``dense`` with a known dosage."""
    return dense(spark, sf_dir).filter(F.col("dosage").isNotNull())


def dense_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dense`` with odd SNPs copied from their predecessor in three quarters of the samples."""
    emb = table(spark, sf_dir, "embeddings").withColumn(
        "embedding",
        F.transform("embedding", lambda e, i: F.struct(
            e.alias("v"), F.when((i % 2 == 1) & (F.col("vec_id") % 4 != 0), F.col("embedding")[i - 1]).otherwise(e).alias("g"),
            F.when((i % 2 == 1) & (F.col("vec_id") % 4 != 0), i - 1).otherwise(i).alias("src"))),
    )
    text = """
    SELECT concat('V', CAST(vec_id AS STRING)) AS sampleId, concat('G', CAST(label % 5 AS STRING)) AS super_pop,
      concat('R', CAST(label AS STRING)) AS pop, CAST(i AS INT) AS idx,
      CAST(CAST(floor(i / 16.0) AS INT) + 1 AS STRING) AS contig, CAST((i % 16) * 1000 AS BIGINT) AS start,
      CAST(e.v AS DOUBLE) + CAST(0.3 AS DOUBLE) * ((label * (i + 1)) % 5 - 2) AS w,
      CASE WHEN e.src % 4 = 3 AND (vec_id * 7 + e.src * 13) % 29 = 0 THEN NULL
           WHEN CAST(e.g AS DOUBLE) < CAST(-0.055 AS DOUBLE) THEN 0
           WHEN CAST(e.g AS DOUBLE) < CAST(0.055 AS DOUBLE) THEN 1 ELSE 2 END AS dosage
    FROM {emb} LATERAL VIEW posexplode(embedding) t AS i, e"""
    return spark.sql(text, emb=emb)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PRED, sf_dir, "lineitem")


#: View texts for the checking engine, in dependency order.
SQL_VIEWS = {
    "panel": PANEL,
    "gts_raw": f"SELECT *, start + length(ref) AS \"end\" FROM ({GTS_RAW}) r",
    "gts_cell": GTS_CELL,
    "dense": DENSE_SQL,
    "dense_ld": DENSE_LD,
    "pred": PRED,
}
SQL_NEEDS = {"dense_ld": ("dense",)}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix a SQL text with the views it uses; a body may start with its own ``, name AS (..)``."""
    needed: list[str] = []
    for view in views:
        for name in (*SQL_NEEDS.get(view, ()), view):
            if name not in needed:
                needed.append(name)
    head = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body.strip()}"
