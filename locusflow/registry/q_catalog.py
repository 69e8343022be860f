"""Aggregation, numbering and reshaping."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import genotype as G
from ..operators import calls as P
from ..operators import catalog as A
from ..operators import reshape as RS
from ..operators import sampling as Q
from ..operators.halves import half_masks
from ..plans import jobs as J
from .base import DOSE, ID3, NONREF, query, r6, rounded
from .q_calls import CATALOG_SQL, DOSE_COUNT, FEATURES, N_RAW, WIDE_SQL, _wide

N_CELL = "(SELECT count(DISTINCT sampleId) FROM gts_cell)"
SV = f"SELECT DISTINCT sampleId, {ID3} AS variantId, {NONREF} AS altCount FROM gts_raw"
CARRIER = f"""SELECT variantId, count(*) AS size, count(*) FILTER (WHERE altCount > 0) / CAST({N_RAW} AS DOUBLE) AS frequency
  FROM ({SV}) s GROUP BY variantId"""
CELL_CATALOG = f"""SELECT row_number() OVER (ORDER BY contig, start) - 1 AS snpIdx, contig, start, 'A' AS ref, 'C' AS alt, nonmissing,
    round(frequency, 6) AS frequency, genotype FROM (
  SELECT contig, start, count(*) AS nonmissing, sum({DOSE}) / CAST({N_CELL} AS DOUBLE) AS frequency,
    string_agg(DISTINCT sampleId || ':' || CAST({DOSE} AS VARCHAR), ',' ORDER BY sampleId || ':' || CAST({DOSE} AS VARCHAR)) AS genotype
  FROM gts_cell GROUP BY contig, start HAVING count(*) = {N_CELL}) c"""


def flat_catalog(df):
    return rounded(df.withColumn("genotype", F.array_join("genotype", ",")), "frequency")


@query("sample_count", "gts_raw", sql="SELECT count(DISTINCT sampleId) AS sampleCount FROM gts_raw")
def _(spark, sf):
    return P.sample_count(X.gts_raw(spark, sf))


@query("variant_catalog", "gts_cell", sql=CELL_CATALOG)
def _(spark, sf):
    return flat_catalog(J.build_variant_catalog(X.gts_cell(spark, sf)))


@query(
    "variant_catalog_strict", "gts_raw",
    sql=f"""SELECT contig, start, ref, alt, count(*) AS nonmissing, round(sum({DOSE}) / CAST({N_RAW} AS DOUBLE), 6) AS frequency
    FROM gts_raw SEMI JOIN (SELECT contig, start, ref FROM gts_raw WHERE length(ref) = 1 AND length(alt) = 1
      GROUP BY ALL HAVING count(DISTINCT alt) = 1) b USING (contig, start, ref)
    WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY contig, start, ref, alt""",
)
def _(spark, sf):
    return rounded(
        A.variant_catalog(X.gts_raw(spark, sf), complete=False, strict_biallelic=True), "frequency"
    )


@query(
    "freq_dosage", "gts_raw",
    sql=f"SELECT contig, start, ref, alt, nonmissing, round(alt_total / CAST({N_RAW} AS DOUBLE), 6) AS frequency FROM ({DOSE_COUNT}) c",
)
def _(spark, sf):
    return rounded(A.freq_dosage(X.gts_raw(spark, sf)), "frequency")


@query("freq_alt_total", "gts_raw", sql=f"SELECT contig, start, ref, alt, nonmissing, alt_total AS frequency FROM ({DOSE_COUNT}) c")
def _(spark, sf):
    return A.freq_alt_total(X.gts_raw(spark, sf))


@query("freq_carrier", "gts_raw", sql=f"SELECT variantId, size, round(frequency, 6) AS frequency FROM ({CARRIER}) c")
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    return rounded(A.freq_carrier(P.sample_variants(calls), P.sample_total(calls)), "frequency")


@query(
    "allele_number_and_alt_count", "gts_raw",
    sql=f"""SELECT {ID3} AS variantId, CAST(2 * count(*) AS BIGINT) AS variantSize, CAST(sum({NONREF}) AS BIGINT) AS variantFrequency
    FROM gts_raw GROUP BY 1 HAVING 2 * count(*) >= {N_RAW} * 0.5 AND sum({NONREF}) >= {N_RAW} * 0.1 AND sum({NONREF}) <= {N_RAW} * 0.35""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    return A.select_by_allele_counts(A.allele_number_and_alt_count(calls), P.sample_total(calls), 0.5, 0.1, 0.35)


@query(
    "genotype_list", "gts_raw",
    sql=f"""SELECT contig, start, ref, alt, 0 AS chunk, string_agg(sampleId || ':' || CAST(d AS VARCHAR), ',' ORDER BY sampleId, d) AS genotype
    FROM (SELECT DISTINCT contig, start, ref, alt, sampleId, {DOSE} AS d FROM gts_raw) c GROUP BY contig, start, ref, alt""",
)
def _(spark, sf):
    return A.genotype_list(X.gts_raw(spark, sf)).withColumn("genotype", F.array_join("genotype", ","))


@query(
    "sample_variant_dosage", "gts_raw",
    sql=f"""SELECT sampleId, g.contig || ':' || CAST(g.start AS VARCHAR) AS variantId, CAST(sum({DOSE}) AS BIGINT) AS altCount
    FROM gts_raw g, ({CATALOG_SQL}) v
    WHERE v.frequency >= 0.05 AND v.frequency <= 0.3 AND g.contig = v.contig AND g.start = v.start AND (a0 <> 'OtherAlt' OR a1 <> 'OtherAlt')
    GROUP BY sampleId, g.contig, g.start""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    return A.sample_variant_dosage(calls, A.freq_dosage(calls), 0.05, 0.3)


@query(
    "sample_vectors", "gts_raw",
    sql=f"""SELECT sampleId, 0 AS chunk, string_agg(variantId || '=' || CAST(altCount AS VARCHAR), ',' ORDER BY variantId, altCount) AS variants
    FROM ({SV}) s GROUP BY sampleId""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf).select("sampleId", G.variant_id3().alias("variantId"), G.alt_count_nonref().alias("altCount"))
    vectors = A.sample_vectors(calls)
    text = F.transform("variants", lambda v: F.concat(v["variant"], F.lit("="), v["value"].cast("string")))
    return vectors.select("sampleId", "chunk", F.array_join(text, ",").alias("variants"))


@query("region_count", "panel", sql="SELECT count(DISTINCT super_pop) AS regions FROM panel")
def _(spark, sf):
    return A.region_count(X.panel(spark, sf), "super_pop")


@query(
    "column_stats", "dense",
    sql="SELECT contig, idx, round(avg(dosage), 6) AS mean, round(var_samp(dosage), 6) AS variance FROM dense GROUP BY contig, idx",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    stats = A.column_stats(long.withColumn("snp", F.struct("contig", "idx")), "snp", "dosage")
    return rounded(stats.select("snp.contig", "snp.idx", "mean", "variance"), "mean", "variance")


@query(
    "row_stats", "dense",
    sql="SELECT sampleId, round(avg(dosage), 6) AS mean, round(stddev_samp(dosage), 6) AS stddev FROM dense GROUP BY sampleId",
)
def _(spark, sf):
    return rounded(A.row_stats(X.dense(spark, sf)), "mean", "stddev")


@query(
    "row_stats_by_samples", "dense",
    sql="""SELECT d.sampleId, round(max(m.mean), 6) AS mean, round(sqrt(sum((d.dosage - m.mean) * (d.dosage - m.mean)) / (max(m.n) - 1)), 6) AS stddev
    FROM dense d JOIN (SELECT sampleId, sum(dosage) / CAST(n AS DOUBLE) AS mean, n FROM dense, (SELECT count(DISTINCT sampleId) AS n FROM dense) c
      GROUP BY sampleId, n) m USING (sampleId) GROUP BY d.sampleId""",
)
def _(spark, sf):
    return rounded(A.row_stats(X.dense(spark, sf), denominator="samples"), "mean", "stddev")


@query("matrix_dims", "dense", sql="SELECT count(DISTINCT sampleId) AS nRows, count(DISTINCT idx) AS nColumns FROM dense")
def _(spark, sf):
    return A.matrix_dims(X.dense(spark, sf))


@query(
    "average_over_repeats", "dense",
    sql="""SELECT 'all' AS split, CAST(idx AS DOUBLE) AS label, metric, round(avg(value), 6) AS value FROM (
      SELECT pop, idx, 'mean' AS metric, avg(dosage) AS value FROM dense GROUP BY pop, idx
      UNION ALL SELECT pop, idx, 'variance', var_samp(dosage) FROM dense GROUP BY pop, idx) m GROUP BY idx, metric""",
)
def _(spark, sf):
    per_rep = X.dense(spark, sf).groupBy(F.col("pop").alias("rep"), "idx").agg(F.avg("dosage").alias("mean"), F.var_samp("dosage").alias("variance"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mean", "variance")]))
    metrics = per_rep.select("rep", F.lit("all").alias("split"), F.col("idx").cast("double").alias("label"), cells.alias("_c"))
    return rounded(A.average_over_repeats(metrics.select("rep", "split", "label", "_c.metric", "_c.value")), "value")


# ---------------------------------------------------------------- numbering and ordering


@query(
    "snp_index", "gts_raw",
    sql="""SELECT contig, start, ref, alt, row_number() OVER (ORDER BY contig, start, ref, alt) - 1 AS snpIdx
    FROM (SELECT DISTINCT contig, start, ref, alt FROM gts_raw) v""",
)
def _(spark, sf):
    return A.snp_index(X.gts_raw(spark, sf).select(*P.VARIANT).distinct()).select(*P.VARIANT, "snpIdx")


@query(
    "row_index", "panel",
    sql="SELECT sampleId, pop, super_pop, row_number() OVER (ORDER BY sampleId) - 1 AS rowIdx FROM panel",
)
def _(spark, sf):
    return A.row_index(X.panel(spark, sf), "sampleId")


VARIANCES = "SELECT idx AS component, var_samp(w) AS value FROM dense GROUP BY idx"


def _variances(spark, sf):
    return X.dense(spark, sf).groupBy(F.col("idx").alias("component")).agg(F.var_samp("w").alias("value"))


@query(
    "cumulative_share", "dense",
    sql=f"""SELECT component, round(value, 6) AS value, round(value / sum(value) OVER (), 6) AS share,
      round(sum(value) OVER (ORDER BY component) / sum(value) OVER (), 6) AS cumulative FROM ({VARIANCES}) v""",
)
def _(spark, sf):
    return rounded(A.cumulative_share(_variances(spark, sf)), "value", "share", "cumulative")


@query(
    "components_under", "dense",
    sql=f"""SELECT CAST(count(*) FILTER (WHERE c <= 0.7) AS BIGINT) AS components
    FROM (SELECT sum(value) OVER (ORDER BY component) / sum(value) OVER () AS c FROM ({VARIANCES}) v) x""",
)
def _(spark, sf):
    return A.components_under(A.cumulative_share(_variances(spark, sf)), 0.7)


@query(
    "sort_snps", "gts_raw",
    sql="""SELECT contig, start, ref, alt, row_number() OVER (ORDER BY contig, start, ref, alt) - 1 AS snpIdx
    FROM (SELECT DISTINCT contig, start, ref, alt FROM gts_raw) v ORDER BY snpIdx DESC""",
)
def _(spark, sf):
    return A.sort_snps(A.snp_index(X.gts_raw(spark, sf).select(*P.VARIANT).distinct()).select(*P.VARIANT, "snpIdx"))


@query("sort_samples", "panel", sql="SELECT sampleId, pop, super_pop FROM panel ORDER BY sampleId")
def _(spark, sf):
    return A.sort_samples(X.panel(spark, sf))


@query(
    "best_k", "dense",
    sql="SELECT idx AS k, round(avg(dosage), 6) AS purity FROM dense GROUP BY idx ORDER BY avg(dosage) DESC, idx LIMIT 1",
)
def _(spark, sf):
    tuning = X.dense(spark, sf).groupBy(F.col("idx").alias("k")).agg(F.avg("dosage").alias("purity"))
    return rounded(A.best_k(tuning), "purity")


@query(
    "preview", "gts_raw",
    sql=f"SELECT DISTINCT sampleId, {ID3} AS variantId, {NONREF} AS altCount FROM gts_raw ORDER BY sampleId, variantId, altCount LIMIT 20",
)
def _(spark, sf):
    return A.preview(P.sample_variants(X.gts_raw(spark, sf)), "sampleId", "variantId", "altCount")


# ---------------------------------------------------------------- reshaping


@query("pivot_wide", "dense", sql=WIDE_SQL)
def _(spark, sf):
    return rounded(_wide(spark, sf), *FEATURES)


@query(
    "pivot_wide_cells", "gts_cell",
    sql=f"SELECT sampleId, contig, CAST(sum({DOSE}) AS DOUBLE) AS dose FROM gts_cell GROUP BY sampleId, contig",
)
def _(spark, sf):
    """Wide table with names taken from the data, read back in long form."""
    long = X.gts_cell(spark, sf).select("sampleId", "contig", G.dosage("alleles").alias("dose"))
    wide = RS.pivot_wide(long, None, "sampleId", "contig", "dose", fill=None)
    names = [c for c in wide.columns if c != "sampleId"]
    return wide.unpivot("sampleId", [F.col(f"`{c}`") for c in names], "contig", "dose").filter("dose IS NOT NULL")


@query(
    "transpose", "gts_raw",
    sql="""SELECT colIdx, 0 AS chunk, string_agg(CAST(v AS VARCHAR), ',' ORDER BY rowIdx) AS vals FROM (
      SELECT rowIdx, 0 AS colIdx, n AS v FROM s UNION ALL SELECT rowIdx, 1, lo FROM s UNION ALL SELECT rowIdx, 2, hi FROM s) x
    GROUP BY colIdx""".replace(
        "FROM s", """FROM (SELECT row_number() OVER (ORDER BY sampleId) - 1 AS rowIdx, count(*) AS n, min(start) AS lo, max(start) AS hi
      FROM gts_raw GROUP BY sampleId) s"""
    ),
)
def _(spark, sf):
    per_sample = X.gts_raw(spark, sf).groupBy("sampleId").agg(F.array(F.count("*"), F.min("start"), F.max("start")).alias("values"))
    columns = RS.transpose(A.row_index(per_sample, "sampleId"))
    return columns.select("colIdx", "chunk", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


PC64 = [f"PC{i + 1}" for i in range(64)]
PC_SQL = "SELECT sampleId, super_pop AS Region, " + ", ".join(
    f"round(max(w) FILTER (WHERE idx = {i}), 6) AS PC{i + 1}" for i in range(64)
) + " FROM dense GROUP BY sampleId, super_pop"


def _region_vectors(spark, sf):
    return RS.feature_vectors(X.dense(spark, sf).withColumnRenamed("super_pop", "Region"), ["sampleId", "Region"])


@query("pc_columns", "dense", sql=PC_SQL)
def _(spark, sf):
    return rounded(RS.pc_columns(_region_vectors(spark, sf), ["sampleId", "Region"], 64, "features"), *PC64)


@query("vector_text_to_columns", "dense", sql=PC_SQL)
def _(spark, sf):
    from ..functions.text import vector_text

    text = _region_vectors(spark, sf).withColumn("features", vector_text(vector_to_array("features")))
    return rounded(RS.vector_text_to_columns(text, 64), *PC64)


@query("assemble_features", "dense", sql=WIDE_SQL)
def _(spark, sf):
    assembled = RS.assemble_features(_wide(spark, sf)).select("sampleId", vector_to_array("features").alias("f"))
    return assembled.select("sampleId", *[r6(F.col("f")[i]).alias(f"v{i}") for i in range(64)])


RANKED = """SELECT super_pop AS Region, CAST(row_number() OVER (ORDER BY count(*) DESC, super_pop) - 1 AS DOUBLE) AS label FROM panel GROUP BY super_pop"""


@query("index_labels", "panel", sql=f"SELECT sampleId, super_pop AS Region, label FROM panel JOIN ({RANKED}) r ON r.Region = super_pop")
def _(spark, sf):
    panel = X.panel(spark, sf).select("sampleId", F.col("super_pop").alias("Region"))
    return RS.index_labels(panel)[0]


@query("labels_back", "panel", sql="SELECT sampleId, super_pop AS Region, super_pop AS predictedLabel FROM panel")
def _(spark, sf):
    indexed, model = RS.index_labels(X.panel(spark, sf).select("sampleId", F.col("super_pop").alias("Region")))
    return RS.labels_back(indexed, model, "label").drop("label")


@query("label_index", "panel", sql=RANKED)
def _(spark, sf):
    return RS.label_index(X.panel(spark, sf).withColumnRenamed("super_pop", "Region"))


# ---------------------------------------------------------------- jobs on calls


@query("build_variant_catalog_job", "gts_cell", sql=CELL_CATALOG)
def _(spark, sf):
    from ..session import scratch_path
    from ..sources import writers as W

    cells = X.gts_cell(spark, sf)
    nested = cells.select(
        "sampleId", "alleles",
        F.struct(F.struct(F.col("contig").alias("contigName")).alias("contig"), "start", "end",
                 F.col("ref").alias("referenceAllele"), F.col("alt").alias("alternateAllele")).alias("variant"),
    )
    source = W.write_parquet(nested, scratch_path(spark, "calls"))
    return flat_catalog(J.build_variant_catalog_job(spark, source, scratch_path(spark, "catalog"), csv=False))


@query(
    "population_matrix_job", "gts_raw", "panel",
    sql=f"""SELECT s.sampleId, s.variantId, s.altCount, coalesce(p.super_pop, 'Unknown') AS Region
    FROM ({SV}) s JOIN ({CARRIER}) c USING (variantId) LEFT JOIN panel p ON p.sampleId = s.sampleId
    WHERE c.size >= floor({N_RAW} * CAST(0.3 AS DOUBLE)) AND c.frequency BETWEEN 0.1 AND 0.25""",
)
def _(spark, sf):
    return J.population_matrix_job(X.gts_raw(spark, sf), X.panel(spark, sf), 0.7, 0.1, 0.25)


@query(
    "population_matrix_job_alleles", "gts_raw", "panel",
    sql=f"""SELECT s.sampleId, s.variantId, s.altCount, coalesce(p.super_pop, 'Unknown') AS Region
    FROM ({SV}) s LEFT JOIN panel p ON p.sampleId = s.sampleId
    WHERE s.variantId IN (SELECT {ID3} FROM gts_raw GROUP BY contig, start, "end"
      HAVING 2 * count(*) >= {N_RAW} * 0.5 AND sum({NONREF}) >= {N_RAW} * 0.1 AND sum({NONREF}) <= {N_RAW} * 0.25)""",
)
def _(spark, sf):
    return J.population_matrix_job(X.gts_raw(spark, sf), X.panel(spark, sf), 0.5, 0.1, 0.25, by="alleles")


# ---------------------------------------------------------------- subsamples and splits

HALVES = """SELECT rep, sampleId FROM (SELECT rep, sampleId, n,
    row_number() OVER (PARTITION BY rep ORDER BY md5(CAST(rep AS VARCHAR) || ':' || sampleId), sampleId) AS r
  FROM (SELECT DISTINCT sampleId FROM {view}) s, (SELECT count(DISTINCT sampleId) AS n FROM {view}) c, range(1, {reps} + 1) t(rep)) x
  WHERE r <= n // 2"""


@query("half_subsamples", "panel", sql=HALVES.format(view="panel", reps="(SELECT count(*) // 2 FROM panel)"))
def _(spark, sf):
    return Q.half_subsamples(X.panel(spark, sf))


DENSE_HALVES = HALVES.format(view="dense", reps="(SELECT count(DISTINCT sampleId) // 2 FROM dense)")


@query(
    "subsample_column_stats", "dense",
    sql=f"SELECT rep, idx, round(avg(dosage), 6) AS mean, round(var_samp(dosage), 6) AS variance FROM dense JOIN ({DENSE_HALVES}) h USING (sampleId) GROUP BY rep, idx",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    return rounded(Q.subsample_column_stats(long, half_masks(long)), "mean", "variance")


@query(
    "subsample_row_stats", "dense",
    sql=f"""SELECT rep, sampleId, round(avg(dosage), 6) AS mean, round(stddev_samp(dosage), 6) AS stddev
    FROM dense JOIN ({DENSE_HALVES}) h USING (sampleId) GROUP BY rep, sampleId""",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    return rounded(Q.subsample_row_stats(long, half_masks(long)), "mean", "stddev")


OUTLIERS = f"""SELECT m.sampleId, (m.mean - b.centre) / b.spread AS z FROM (SELECT sampleId, avg(dosage) AS mean FROM dense GROUP BY sampleId) m,
  (SELECT avg(m) AS centre, avg(sd) AS spread FROM (SELECT rep, avg(mean) AS m, stddev_samp(mean) AS sd
    FROM ({DENSE_HALVES}) h JOIN (SELECT sampleId, avg(dosage) AS mean FROM dense GROUP BY sampleId) s USING (sampleId) GROUP BY rep) r) b"""


@query("find_outliers", "dense", sql=f"SELECT sampleId, round(z, 6) AS zscore FROM ({OUTLIERS}) o WHERE abs(z) > 2")
def _(spark, sf):
    long = X.dense(spark, sf)
    return rounded(Q.find_outliers(long, half_masks(long), 2.0), "zscore")


@query(
    "drop_outliers", "dense",
    sql=f"SELECT sampleId, idx, round(w, 6) AS w FROM dense WHERE sampleId NOT IN (SELECT sampleId FROM ({OUTLIERS}) o WHERE abs(z) > 2)",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    kept = Q.drop_outliers(long, Q.find_outliers(long, half_masks(long), 2.0))
    return rounded(kept.select("sampleId", "idx", "w"), "w")


SCORE = "CAST(('0x' || substr(md5('{seed}:' || sampleId), 1, 7)) AS BIGINT) / 268435456.0"


def _sides(parts, *columns):
    train, rest = parts
    return train.select(*columns, F.lit("train").alias("side")).unionByName(rest.select(*columns, F.lit("test").alias("side")))


@query(
    "train_test_split", "panel",
    sql=f"SELECT sampleId, CASE WHEN {SCORE.format(seed=1236)} < 0.7 THEN 'train' ELSE 'test' END AS side FROM panel",
)
def _(spark, sf):
    return _sides(Q.train_test_split(X.panel(spark, sf), 0.7, rep=2), "sampleId")


@query(
    "frame_split", "dense",
    sql=f"SELECT sampleId, idx, CASE WHEN {SCORE.format(seed=1234)} < 0.5 THEN 'train' ELSE 'test' END AS side FROM dense",
)
def _(spark, sf):
    return _sides(Q.frame_split(X.dense(spark, sf), 0.5), "sampleId", "idx")
