"""Projections, filters and joins over calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import genotype as G
from ..functions import text as T
from ..operators import calls as P
from ..operators import catalog as A
from ..operators import ld as L
from ..operators import reshape as RS
from ..operators.distance import all_pairs
from .base import DOSE, ID2, ID3, NONREF, alleles_out, query, r6, rounded

CALL = 'sampleId, contig, start, "end", ref, alt, a0, a1'
WANTED = ["S1", "S2", "S3", "S5", "S8", "S13", "S21"]
WANTED_SQL = ", ".join(f"'{s}'" for s in WANTED)
DOSE_COUNT = f"SELECT contig, start, ref, alt, count(*) AS nonmissing, CAST(sum({DOSE}) AS BIGINT) AS alt_total FROM gts_raw GROUP BY ALL"
N_RAW = "(SELECT count(DISTINCT sampleId) FROM gts_raw)"


def _calls(df):
    return alleles_out(df.select("sampleId", "contig", "start", "end", "ref", "alt", "alleles"))


@query("dosage", "gts_raw", sql=f"SELECT sampleId, contig, start, {DOSE} AS dosage FROM gts_raw")
def _(spark, sf):
    return P.with_dosage(X.gts_raw(spark, sf)).select("sampleId", "contig", "start", "dosage")


@query("alt_count_nonref", "gts_raw", sql=f"SELECT sampleId, contig, start, {NONREF} AS altCount FROM gts_raw")
def _(spark, sf):
    return P.with_alt_count(X.gts_raw(spark, sf)).select("sampleId", "contig", "start", "altCount")


@query("genotype_struct", "gts_raw", sql=f"SELECT contig, start, sampleId AS id, {DOSE} AS genotype FROM gts_raw")
def _(spark, sf):
    return P.with_genotype_struct(X.gts_raw(spark, sf)).select("contig", "start", "genotypes.id", "genotypes.genotype")


@query("variant_id3", "gts_raw", sql=f"SELECT sampleId, {ID3} AS variantId FROM gts_raw")
def _(spark, sf):
    return X.gts_raw(spark, sf).select("sampleId", G.variant_id3().alias("variantId"))


@query("variant_id2", "gts_raw", sql=f"SELECT sampleId, {ID2} AS variantId FROM gts_raw")
def _(spark, sf):
    return X.gts_raw(spark, sf).select("sampleId", G.variant_id2().alias("variantId"))


@query("sample_variants", "gts_raw", sql=f"SELECT DISTINCT sampleId, {ID3} AS variantId, {NONREF} AS altCount FROM gts_raw")
def _(spark, sf):
    return P.sample_variants(X.gts_raw(spark, sf))


@query("snp_only", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw WHERE length(ref) = 1 AND length(alt) = 1")
def _(spark, sf):
    return _calls(P.snp_only(X.gts_raw(spark, sf)))


@query("sample_in", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw WHERE sampleId IN ({WANTED_SQL})")
def _(spark, sf):
    return _calls(P.sample_in(X.gts_raw(spark, sf), WANTED))


@query("panel_population_filter", "panel", sql="SELECT sampleId, pop, super_pop FROM panel WHERE super_pop IN ('AFRICA', 'ASIA', 'EUROPE')")
def _(spark, sf):
    return P.panel_population_filter(X.panel(spark, sf), ["AFRICA", "ASIA", "EUROPE"])


@query(
    "frequency_range", "gts_raw",
    sql=f"""SELECT contig, start, ref, alt, nonmissing, round(alt_total / CAST({N_RAW} AS DOUBLE), 6) AS frequency
    FROM ({DOSE_COUNT}) c WHERE alt_total / CAST({N_RAW} AS DOUBLE) BETWEEN 0.1 AND 0.25""",
)
def _(spark, sf):
    return rounded(P.frequency_range(A.freq_dosage(X.gts_raw(spark, sf)), 0.1, 0.25), "frequency")


@query(
    "missing_rate_filter", "gts_cell",
    sql="""SELECT contig, start, ref, alt, count(*) AS nonmissing FROM (SELECT *, 'A' AS ref, 'C' AS alt FROM gts_cell) c
    GROUP BY ALL HAVING count(*) >= (SELECT count(DISTINCT sampleId) FROM gts_cell) * CAST(0.97 AS DOUBLE)""",
)
def _(spark, sf):
    calls = X.gts_cell(spark, sf)
    kept = P.missing_rate_filter(A.variant_counts(calls), P.sample_total(calls), 0.03)
    return kept.drop("altTotal")


@query(
    "missing_rate_filter_alleles", "gts_cell",
    sql="""SELECT contig || ':' || start || ':' || (start + 1) AS variantId, CAST(2 * count(*) AS BIGINT) AS variantSize
    FROM gts_cell GROUP BY contig, start
    HAVING 2 * count(*) >= floor((SELECT count(DISTINCT sampleId) FROM gts_cell) * CAST(0.9 AS DOUBLE))""",
)
def _(spark, sf):
    calls = X.gts_cell(spark, sf)
    counted = A.allele_number_and_alt_count(calls)
    return P.missing_rate_filter(counted, P.sample_total(calls), 0.1, "variantSize", truncate=True).drop("variantFrequency")


@query(
    "complete_calls_only", "gts_cell",
    sql="""SELECT contig, start, count(*) AS nonmissing FROM gts_cell GROUP BY contig, start
    HAVING count(*) = (SELECT count(DISTINCT sampleId) FROM gts_cell)""",
)
def _(spark, sf):
    calls = X.gts_cell(spark, sf)
    return P.complete_calls_only(A.variant_counts(calls), P.sample_total(calls)).select("contig", "start", "nonmissing")


@query("drop_double_other_alt", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw WHERE a0 <> 'OtherAlt' OR a1 <> 'OtherAlt'")
def _(spark, sf):
    return _calls(P.drop_double_other_alt(X.gts_raw(spark, sf)))


@query(
    "biallelic", "gts_raw",
    sql=f"""SELECT {CALL} FROM gts_raw WHERE (contig, start, ref, alt) IN
    (SELECT (contig, start, ref, alt) FROM gts_raw GROUP BY contig, start, ref, alt HAVING count(DISTINCT alt) = 1)""",
)
def _(spark, sf):
    return _calls(P.biallelic(X.gts_raw(spark, sf)))


@query(
    "biallelic_strict", "gts_raw",
    sql=f"""SELECT {CALL} FROM gts_raw SEMI JOIN
    (SELECT contig, start, ref FROM gts_raw GROUP BY ALL HAVING count(DISTINCT alt) = 1) b USING (contig, start, ref)""",
)
def _(spark, sf):
    return _calls(P.biallelic(X.gts_raw(spark, sf), strict=True))


@query(
    "prune_variants", "gts_raw",
    sql=f"""SELECT sampleId, variantId, altCount FROM (SELECT DISTINCT sampleId, {ID3} AS variantId, {NONREF} AS altCount FROM gts_raw) v
    WHERE variantId IN (SELECT {ID3} FROM gts_raw GROUP BY contig, start, "end" HAVING sum({NONREF}) >= 32)""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    kept = A.allele_number_and_alt_count(calls).filter("variantFrequency >= 32")
    return P.prune_variants(P.sample_variants(calls), kept)


@query("locus_range", "gts_raw", sql=f"SELECT {CALL} FROM gts_raw WHERE start >= 250000 AND \"end\" <= 1250000")
def _(spark, sf):
    return _calls(P.locus_range(X.gts_raw(spark, sf), 250_000, 1_250_000))


@query(
    "split_by", "gts_raw",
    sql=f"SELECT {CALL}, CASE WHEN a0 = 'Alt' THEN 'passes' ELSE 'fails' END AS side FROM gts_raw",
)
def _(spark, sf):
    passes, fails = P.split_by(X.gts_raw(spark, sf), F.col("alleles")[0] == "Alt")
    both = passes.withColumn("side", F.lit("passes")).unionByName(fails.withColumn("side", F.lit("fails")))
    return alleles_out(both.select("sampleId", "contig", "start", "end", "ref", "alt", "alleles", "side"))


@query(
    "maf_filter", "gts_raw",
    sql=f"""SELECT contig, start, ref, alt, nonmissing, round(f, 6) AS alleleFrequency
    FROM (SELECT *, alt_total / (2.0 * nonmissing) AS f FROM ({DOSE_COUNT}) c) d WHERE least(f, 1 - f) >= 0.3""",
)
def _(spark, sf):
    return rounded(P.maf_filter(A.allele_frequency(X.gts_raw(spark, sf)), 0.3), "alleleFrequency")


FEATURES = [f"v{i}" for i in range(64)]
WIDE_SQL = "SELECT sampleId, " + ", ".join(
    f"round(max(w) FILTER (WHERE idx = {i}), 6) AS v{i}" for i in range(64)
) + " FROM dense GROUP BY sampleId"


def _wide(spark, sf):
    long = X.dense(spark, sf).withColumn("name", F.concat(F.lit("v"), "idx"))
    return RS.pivot_wide(long, FEATURES, "sampleId", "name", "w")


@query("feature_columns", "dense", sql=WIDE_SQL.replace("SELECT sampleId, ", "SELECT "))
def _(spark, sf):
    return rounded(P.drop_keys(_wide(spark, sf)), *FEATURES)


@query(
    "vector_slice", "dense",
    sql="SELECT sampleId, " + ", ".join(f"round(max(w) FILTER (WHERE idx = {i}), 6) AS PC{i + 1}" for i in range(5)) + " FROM dense GROUP BY sampleId",
)
def _(spark, sf):
    arrays = RS.feature_arrays(X.dense(spark, sf), ["sampleId"], "idx", "w", "values")
    cut = P.vector_slice(arrays, 5)
    return rounded(RS.pc_columns(cut, ["sampleId"], 5, "values", vector=False), *[f"PC{i + 1}" for i in range(5)])


# ---------------------------------------------------------------- joins

CATALOG_SQL = f"""SELECT contig, start, ref, alt, alt_total / CAST({N_RAW} AS DOUBLE) AS frequency FROM ({DOSE_COUNT}) c"""


@query(
    "calls_join_catalog", "gts_raw",
    sql=f"""SELECT g.sampleId, g.contig, g.start, g.a0, g.a1, v.alt AS catalogAlt, round(v.frequency, 6) AS frequency
    FROM gts_raw g, ({CATALOG_SQL}) v
    WHERE v.frequency BETWEEN 0.1 AND 0.3 AND g.contig = v.contig AND g.start = v.start""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    joined = P.calls_join_catalog(calls, A.freq_dosage(calls), 0.1, 0.3)
    return rounded(alleles_out(joined.select("sampleId", "contig", "start", "alleles", "catalogAlt", "frequency")), "frequency")


@query(
    "attach_region", "gts_raw", "panel",
    sql="""SELECT g.sampleId, g.contig, g.start, coalesce(p.super_pop, 'Unknown') AS Region
    FROM gts_raw g LEFT JOIN (SELECT * FROM panel WHERE super_pop <> 'ASIA') p ON p.sampleId = g.sampleId""",
)
def _(spark, sf):
    panel = X.panel(spark, sf).filter("super_pop <> 'ASIA'")
    return P.attach_region(X.gts_raw(spark, sf).select("sampleId", "contig", "start"), panel)


@query(
    "panel_semi_join", "gts_raw", "panel",
    sql=f"SELECT {CALL} FROM gts_raw WHERE sampleId IN (SELECT sampleId FROM panel WHERE super_pop <> 'ASIA')",
)
def _(spark, sf):
    return _calls(P.panel_semi_join(X.gts_raw(spark, sf), X.panel(spark, sf).filter("super_pop <> 'ASIA'")))


@query(
    "variant_semi_join", "gts_raw",
    sql=f"""SELECT {CALL}, {ID3} AS variantId FROM gts_raw WHERE {ID3} IN
    (SELECT {ID3} FROM gts_raw GROUP BY contig, start, "end" HAVING sum({NONREF}) BETWEEN 20 AND 30)""",
)
def _(spark, sf):
    calls = X.gts_raw(spark, sf)
    kept = A.allele_number_and_alt_count(calls).filter("variantFrequency BETWEEN 20 AND 30")
    joined = P.variant_semi_join(calls, kept)
    return alleles_out(joined.select("variantId", "sampleId", "contig", "start", "end", "ref", "alt", "alleles"))


@query(
    "variant_size_freq_join", "gts_raw",
    sql=f"""SELECT s.variantId, s.variantSize, f.variantFrequency
    FROM (SELECT {ID3} AS variantId, CAST(sum(2) AS BIGINT) AS variantSize FROM gts_raw GROUP BY 1) s
    JOIN (SELECT {ID3} AS variantId, CAST(sum({NONREF}) AS BIGINT) AS variantFrequency FROM gts_raw GROUP BY 1) f USING (variantId)""",
)
def _(spark, sf):
    return A.allele_number_and_alt_count(X.gts_raw(spark, sf))


@query(
    "attach_prediction", "dense",
    sql="""SELECT sampleId, super_pop AS Region, CASE WHEN s > 0 THEN 1 ELSE 0 END AS Predict, round(s, 6) AS total
    FROM (SELECT sampleId, super_pop, sum(w) AS s FROM dense GROUP BY ALL) d""",
)
def _(spark, sf):
    sums = X.dense(spark, sf).groupBy("sampleId", F.col("super_pop").alias("Region")).agg(F.sum("w").alias("total"))
    predicted = sums.select("sampleId", F.when(F.col("total") > 0, 1).otherwise(0).alias("Predict"))
    return rounded(P.attach_prediction(sums, predicted), "total")


@query(
    "all_pairs", "panel",
    sql="SELECT a.sampleId AS i, b.sampleId AS j FROM panel a JOIN panel b ON a.sampleId < b.sampleId",
)
def _(spark, sf):
    return all_pairs(X.panel(spark, sf))


@query(
    "positional_zip", "dense",
    sql="""SELECT sampleId, min(super_pop) AS Region, round(avg(w), 6) AS mean, round(max(w), 6) AS top FROM dense GROUP BY sampleId""",
)
def _(spark, sf):
    long = X.dense(spark, sf)
    ids = long.groupBy("sampleId").agg(F.min("super_pop").alias("Region"))
    values = long.groupBy("sampleId").agg(r6(F.avg("w")).alias("mean"), r6(F.max("w")).alias("top"))
    return P.keyed_zip(ids, values)


@query(
    "window_pair_join", "gts_raw",
    sql="""SELECT a.contig, a.idx AS i, b.idx AS j, a.start AS pos_i, b.start AS pos_j
    FROM (SELECT DISTINCT contig, start, start // 1000 AS idx FROM gts_raw) a
    JOIN (SELECT DISTINCT contig, start, start // 1000 AS idx FROM gts_raw) b
      ON a.contig = b.contig AND b.idx < a.idx AND a.start - b.start <= 300000 AND a.idx - b.idx <= 250""",
)
def _(spark, sf):
    sites = X.gts_raw(spark, sf).select("contig", "start", F.floor(F.col("start") / 1000).alias("idx")).distinct()
    return L.window_pair_join(sites, 300_000, 250)


# ---------------------------------------------------------------- functions


@query(
    "scalar_functions", "gts_raw",
    sql="""SELECT sampleId, length(ref) AS ref_length, contig || ':' || CAST(start AS VARCHAR) AS site,
      CAST(contig AS INTEGER) AS contig_number, CASE WHEN a0 = a1 THEN 'hom' ELSE 'het' END AS zygosity FROM gts_raw""",
)
def _(spark, sf):
    a = F.col("alleles")
    return X.gts_raw(spark, sf).select(
        "sampleId", F.length("ref").alias("ref_length"), G.variant_id2().alias("site"), F.col("contig").cast("int").alias("contig_number"),
        F.when(a[0] == a[1], "hom").otherwise("het").alias("zygosity"),
    )


@query("array_element", "gts_raw", sql="SELECT sampleId, a0 AS first_allele, a1 AS second_allele, CAST(NULL AS VARCHAR) AS third_allele FROM gts_raw")
def _(spark, sf):
    return X.gts_raw(spark, sf).select(
        "sampleId", *[G.allele_at("alleles", k).alias(n) for k, n in enumerate(("first_allele", "second_allele", "third_allele"))]
    )


@query("nested_field", "gts_raw", sql='SELECT sampleId, contig, start, "end", ref, alt, a0, a1 FROM gts_raw')
def _(spark, sf):
    return _calls(P.flatten_calls(X.gts_nested(spark, sf)))


@query(
    "parse_genotype_text", "gts_cell",
    sql=f"""SELECT contig, start, string_agg(CAST(d AS VARCHAR), ',' ORDER BY sampleId) AS dosages
    FROM (SELECT DISTINCT contig, start, sampleId, {DOSE} AS d FROM gts_cell) c GROUP BY contig, start""",
)
def _(spark, sf):
    lists = A.genotype_list(X.gts_cell(spark, sf))
    parsed = G.parse_genotype_text("genotype")
    return lists.select("contig", "start", F.array_join(parsed.cast("array<string>"), ",").alias("dosages"))


@query(
    "math_functions", "dense",
    sql="""SELECT sampleId, idx, round(sqrt(abs(w)), 6) AS root, round(least(w, 0.5) + 0.0, 6) + 0.0 AS low, round(greatest(w, -0.5), 6) + 0.0 AS high,
      round(ln(abs(w) + pow(2.0, -52)), 6) + 0.0 AS log_value FROM dense""",
)
def _(spark, sf):
    w = F.col("w")
    return X.dense(spark, sf).select(
        "sampleId", "idx", r6(F.sqrt(F.abs(w))).alias("root"), r6(F.least(w, F.lit(0.5))).alias("low"),
        r6(F.greatest(w, F.lit(-0.5))).alias("high"), r6(F.log(F.abs(w) + F.lit(2.0**-52))).alias("log_value"),
    )


@query(
    "format_duration",
    sql="""SELECT l_orderkey, l_linenumber, ms, CASE WHEN s // 3600 <> 0 THEN CAST(s // 3600 AS VARCHAR) || 'hrs, ' ELSE '' END
      || CASE WHEN (s % 3600) // 60 <> 0 THEN CAST((s % 3600) // 60 AS VARCHAR) || 'mins, ' ELSE '' END
      || CAST(s % 60 AS VARCHAR) || 'sec' AS elapsed
    FROM (SELECT *, ms // 1000 AS s FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) * l_linenumber * 997 AS ms FROM lineitem) a) b""",
)
def _(spark, sf):
    items = X.table(spark, sf, "lineitem")
    ms = items.select("l_orderkey", "l_linenumber", (F.col("l_partkey").cast("bigint") * F.col("l_linenumber") * 997).alias("ms"))
    return ms.withColumn("elapsed", T.format_duration("ms"))


@query(
    "parse_vector_text", "gts_raw",
    sql="""SELECT sampleId, contig, start, CAST(start AS DOUBLE) AS x, CAST("end" AS DOUBLE) AS y FROM gts_raw""",
)
def _(spark, sf):
    text = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]"))
    parsed = X.gts_raw(spark, sf).select("sampleId", "contig", "start", T.parse_vector_text(text).alias("v"))
    return parsed.select("sampleId", "contig", "start", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
