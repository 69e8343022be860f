"""Linkage disequilibrium and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import ld as LDF
from ..operators import calls as P
from ..operators import ld as L
from ..session import cut_lineage
from .base import query, r6, rounded

PAIR = """FROM dense a JOIN dense b ON a.sampleId = b.sampleId AND a.contig = b.contig AND b.idx < a.idx AND a.start - b.start <= {bp}
  WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY a.contig, a.idx, b.idx"""
CELLS = "SELECT a.contig, CAST(a.idx AS BIGINT) AS i, CAST(b.idx AS BIGINT) AS j, " + ", ".join(
    f"count(*) FILTER (WHERE a.dosage = {x} AND b.dosage = {y}) AS c{x}{y}" for x in range(3) for y in range(3)
)


def _counts(spark, sf, max_bp=500_000):
    return L.pair_counts(L.snp_vectors(X.dense(spark, sf)), max_bp)


@query("pair_counts", "dense", sql=f"{CELLS} {PAIR.format(bp=500000)}")
def _(spark, sf):
    return _counts(spark, sf)


@query(
    "pair_sums", "dense",
    sql=f"""SELECT a.contig, CAST(a.idx AS BIGINT) AS i, CAST(b.idx AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a.dosage) AS DOUBLE) AS sx,
    CAST(sum(b.dosage) AS DOUBLE) AS sy, CAST(sum(a.dosage * a.dosage) AS DOUBLE) AS sxx, CAST(sum(b.dosage * b.dosage) AS DOUBLE) AS syy,
    CAST(sum(a.dosage * b.dosage) AS DOUBLE) AS sxy {PAIR.format(bp=5000)}""",
)
def _(spark, sf):
    return _counts(spark, sf, 5000).select("contig", "i", "j", *[c.alias(n) for n, c in LDF.pair_sums().items()])


CORR = f"SELECT a.contig, CAST(a.idx AS BIGINT) AS i, CAST(b.idx AS BIGINT) AS j, round(corr(a.dosage, b.dosage), 6) + 0.0 AS ld {PAIR}"
COMPOSITE = f""", c AS ({CELLS} {PAIR.format(bp=500000)}),
m AS (SELECT *, CAST(c00+c01+c02+c10+c11+c12+c20+c21+c22 AS DOUBLE) AS n, c00+c01+c02 AS naa, c10+c11+c12 AS nah, c20+c21+c22 AS n2a,
  c00+c10+c20 AS nbb, c01+c11+c21 AS nbh, c02+c12+c22 AS n2b FROM c),
f AS (SELECT *, (2*naa+nah)/(2*n) AS pa, (2*nbb+nbh)/(2*n) AS pb,
  (c22+c00-c02-c20)/(2*n) - (naa-n2a)*(nbb-n2b)/(2*n*n) AS delta FROM m),
g AS (SELECT *, (1-pa)*pa + n2a/n - (1-pa)*(1-pa) AS va, (1-pb)*pb + n2b/n - (1-pb)*(1-pb) AS vb FROM f)
SELECT contig, i, j, CASE WHEN va * vb > 0 THEN round(delta / sqrt(va * vb), 6) + 0.0 END AS ld FROM g"""


@query("ld_composite", "dense", sql=COMPOSITE)
def _(spark, sf):
    return rounded(L.ld_matrix(X.dense(spark, sf), "composite"), "ld")


@query("ld_corr", "dense", sql=CORR.format(bp=500000))
def _(spark, sf):
    return rounded(L.ld_matrix(X.dense(spark, sf), "corr"), "ld")


@query("ld_matrix", "dense", sql=CORR.format(bp=6000) + " HAVING a.idx - b.idx <= 4")
def _(spark, sf):
    return rounded(L.ld_matrix(X.dense(spark, sf), "corr", 6000, 4), "ld")


# Haplotype estimation as a recursive query: one row per pair and round until the pair settles.
EM = f""", c AS ({CELLS} {PAIR.format(bp=500000)}),
h AS (SELECT contig, i, j, 2.0*c22+c21+c12 AS naa, 2.0*c20+c21+c10 AS nab, 2.0*c02+c12+c01 AS nba, 2.0*c00+c01+c10 AS nbb, CAST(c11 AS DOUBLE) AS het FROM c),
s AS (SELECT *, naa + nab + nba + nbb AS known, naa + nab + nba + nbb + 2 * het AS total FROM h),
z AS (SELECT *, CASE WHEN het > 0 THEN (naa + 0.01) / (known + 0.04) ELSE naa / total END AS paa, CASE WHEN het > 0 THEN (nab + 0.01) / (known + 0.04) ELSE nab / total END AS pab,
  CASE WHEN het > 0 THEN (nba + 0.01) / (known + 0.04) ELSE nba / total END AS pba, CASE WHEN het > 0 THEN (nbb + 0.01) / (known + 0.04) ELSE nbb / total END AS pbb FROM s),
l AS (SELECT *, naa*ln(paa+pow(2.0,-52)) + nab*ln(pab+pow(2.0,-52)) + nba*ln(pba+pow(2.0,-52)) + nbb*ln(pbb+pow(2.0,-52)) AS ll FROM z),
em AS (
  SELECT contig, i, j, naa, nab, nba, nbb, het, total, paa, pab, pba, pbb, ll, greatest(pow(2.0,-26) * abs(ll), pow(2.0,-52)) AS tol, 0 AS it, het = 0 AS done FROM l
  UNION ALL
  SELECT contig, i, j, naa, nab, nba, nbb, het, total, qaa, qab, qba, qbb, nll, tol, it + 1, abs(ll - nll) <= tol FROM (
    SELECT *, naa*ln(qaa+pow(2.0,-52)) + nab*ln(qab+pow(2.0,-52)) + nba*ln(qba+pow(2.0,-52)) + nbb*ln(qbb+pow(2.0,-52)) AS nll FROM (
      SELECT *, (naa + het * (1 - trans)) / total AS qaa, (nab + het * trans) / total AS qab, (nba + het * trans) / total AS qba, (nbb + het * (1 - trans)) / total AS qbb FROM (
        SELECT *, pab * pba / (paa * pbb + pab * pba) AS trans FROM em WHERE NOT done AND it < 999) a) b) d),
p AS (SELECT contig, i, j, paa, pab, pba, pbb FROM em WHERE done OR it = 999),
f AS (SELECT *, (paa+pab) AS a, (paa+pba) AS a2, (pbb+pba) AS b, (pbb+pab) AS b2, paa - (paa+pab)*(paa+pba) AS d FROM p)
"""


@query("haplotype_em", "dense", recursive=True,
       sql=EM + "SELECT contig, i, j, round(paa, 6) AS pAA, round(pab, 6) AS pAB, round(pba, 6) AS pBA, round(pbb, 6) AS pBB FROM p")
def _(spark, sf):
    found = L.haplotypes(_counts(spark, sf))
    return found.select("contig", "i", "j", *[r6(F.col("hap")[p]).alias(p) for p in ("pAA", "pAB", "pBA", "pBB")])


@query("ld_r", "dense", recursive=True, sql=EM + "SELECT contig, i, j, CASE WHEN a*a2*b*b2 > 0 THEN round(d / sqrt(a*a2*b*b2), 6) + 0.0 END AS ld FROM f")
def _(spark, sf):
    return rounded(L.ld_matrix(X.dense(spark, sf), "r"), "ld")


@query(
    "ld_dprime", "dense", recursive=True,
    sql=EM + """SELECT contig, i, j, CASE WHEN bound <> 0 THEN round(d / bound, 6) + 0.0 END AS ld FROM (
      SELECT *, CASE WHEN d >= 0 THEN least(a*b2, b*a2) ELSE greatest(-a*a2, -b*b2) END AS bound FROM f) x""",
)
def _(spark, sf):
    return rounded(L.ld_matrix(X.dense(spark, sf), "dprime"), "ld")


# Without heterozygous calls the haplotype proportions have a closed form.
@query(
    "ld_r_homozygotes", "dense",
    sql=f""", c AS ({CELLS} {PAIR.format(bp=500000).replace("WHERE", "WHERE a.dosage <> 1 AND b.dosage <> 1 AND")}),
    p AS (SELECT contig, i, j, 1.0*c22/(c22+c20+c02+c00) AS aa, 1.0*c20/(c22+c20+c02+c00) AS ab, 1.0*c02/(c22+c20+c02+c00) AS ba, 1.0*c00/(c22+c20+c02+c00) AS bb FROM c)
    SELECT contig, i, j, CASE WHEN (aa+ab)*(aa+ba)*(bb+ba)*(bb+ab) > 0
      THEN round((aa - (aa+ab)*(aa+ba)) / sqrt((aa+ab)*(aa+ba)*(bb+ba)*(bb+ab)), 6) + 0.0 END AS ld FROM p""",
)
def _(spark, sf):
    homozygous = F.when(F.col("dosage") != 1, F.col("dosage"))
    return rounded(L.ld_matrix(X.dense(spark, sf).withColumn("dosage", homozygous), "r"), "ld")


def greedy_sql(view: str, threshold: float, order: str = "idx", group: str = "0") -> str:
    """Greedy scan per contig in the given order as a recursive query."""
    return f""", bad AS (
      SELECT a.contig, a.idx AS i, b.idx AS j FROM {view} a JOIN {view} b
        ON a.sampleId = b.sampleId AND a.contig = b.contig AND a.idx <> b.idx AND abs(a.start - b.start) <= 500000
      GROUP BY 1, 2, 3
      HAVING NOT coalesce(abs(corr(a.dosage, b.dosage)) <= {threshold} AND NOT isnan(corr(a.dosage, b.dosage)), false)),
    snp AS (SELECT DISTINCT contig, idx, {group} AS grp, {order} AS ord FROM {view}),
    bl AS (
      SELECT s.contig, s.grp, s.idx, coalesce(list(e.idx) FILTER (e.idx IS NOT NULL), []) AS nb,
             row_number() OVER (PARTITION BY s.contig, s.grp ORDER BY s.ord) AS rn
      FROM snp s LEFT JOIN bad ON bad.contig = s.contig AND bad.i = s.idx
        LEFT JOIN snp e ON e.contig = s.contig AND e.grp = s.grp AND e.idx = bad.j AND e.ord < s.ord
      GROUP BY s.contig, s.grp, s.idx, s.ord),
    g AS (
      SELECT contig, grp, rn, CAST([idx] AS INTEGER[]) AS kept FROM bl WHERE rn = 1
      UNION ALL
      SELECT bl.contig, bl.grp, bl.rn, CASE WHEN len(list_intersect(g.kept, bl.nb)) = 0 THEN list_append(g.kept, bl.idx) ELSE g.kept END
      FROM g JOIN bl ON bl.contig = g.contig AND bl.grp = g.grp AND bl.rn = g.rn + 1)
    SELECT contig, CAST(unnest(kept) AS BIGINT) AS idx FROM g
    WHERE rn = (SELECT max(rn) FROM bl b WHERE b.contig = g.contig AND b.grp = g.grp)"""


@query("ld_prune", "dense", sql=greedy_sql("dense", 0.05), recursive=True)
def _(spark, sf):
    return L.ld_prune(X.dense(spark, sf), "composite", 0.05)


@query("ld_prune_blocks", "dense_ld", sql=greedy_sql("dense_ld", 0.2), recursive=True)
def _(spark, sf):
    return L.ld_prune(X.dense_ld(spark, sf), "corr", 0.2)


@query(
    "ld_prune_from_start", "dense", recursive=True,
    sql=greedy_sql("dense", 0.05, "CASE WHEN idx >= 37 THEN idx ELSE -idx END", "CASE WHEN idx >= 37 THEN 1 ELSE 0 END"),
)
def _(spark, sf):
    return L.ld_prune(X.dense(spark, sf), "corr", 0.05, start=37)


@query(
    "union_picks", "dense_ld", recursive=True,
    sql=greedy_sql("dense_ld", 0.15, "CASE WHEN idx >= 21 THEN idx ELSE -idx END", "CASE WHEN idx >= 21 THEN 1 ELSE 0 END"),
)
def _(spark, sf):
    vectors = cut_lineage(L.snp_vectors(X.dense_ld(spark, sf)))
    pairs = cut_lineage(L.ld_value(L.pair_counts(vectors), "corr").select("contig", "i", "j", "ld"))
    snps = vectors.select("contig", "idx").distinct()
    forward = L.prune_from_pairs(snps.filter("idx >= 21"), pairs.filter("j >= 21"), 0.15)
    backward = L.prune_from_pairs(snps.filter("idx < 21"), pairs.filter("i < 21"), 0.15, start=21)
    return P.union_picks(forward, backward)


GRID = """, grid AS (SELECT t.threshold, m.maf FROM (VALUES (CAST(0.1 AS DOUBLE)), (0.2), (0.5)) t(threshold), (VALUES (CAST(NULL AS DOUBLE)), (0.45)) m(maf)),
freq AS (SELECT contig, idx, sum(dosage) / CAST(2 * count(dosage) AS DOUBLE) AS f FROM dense_ld GROUP BY contig, idx),
snp AS (SELECT contig, idx, threshold, maf, threshold || '/' || coalesce(maf, -1) || '/' || contig AS scan FROM freq, grid WHERE maf IS NULL OR least(f, 1 - f) >= maf),
ld AS (SELECT a.contig, a.idx AS i, b.idx AS j, corr(a.dosage, b.dosage) AS r FROM dense_ld a JOIN dense_ld b
  ON a.sampleId = b.sampleId AND a.contig = b.contig AND b.idx < a.idx AND a.start - b.start <= 500000 GROUP BY 1, 2, 3),
bl AS (
  SELECT s.scan, s.contig, s.threshold, s.maf, s.idx, coalesce(list(e.idx) FILTER (e.idx IS NOT NULL), []) AS nb,
         row_number() OVER (PARTITION BY s.scan ORDER BY s.idx) AS rn
  FROM snp s LEFT JOIN ld ON ld.contig = s.contig AND ld.i = s.idx AND NOT coalesce(abs(ld.r) <= s.threshold AND NOT isnan(ld.r), false)
    LEFT JOIN snp e ON e.scan = s.scan AND e.idx = ld.j
  GROUP BY s.scan, s.contig, s.threshold, s.maf, s.idx),
g AS (
  SELECT scan, rn, CAST([idx] AS INTEGER[]) AS kept FROM bl WHERE rn = 1
  UNION ALL
  SELECT bl.scan, bl.rn, CASE WHEN len(list_intersect(g.kept, bl.nb)) = 0 THEN list_append(g.kept, bl.idx) ELSE g.kept END
  FROM g JOIN bl ON bl.scan = g.scan AND bl.rn = g.rn + 1),
k AS (SELECT scan, unnest(kept) AS idx FROM g WHERE rn = (SELECT max(rn) FROM bl b WHERE b.scan = g.scan))
SELECT s.contig, CAST(s.idx AS BIGINT) AS idx, s.threshold, s.maf FROM k JOIN snp s ON s.scan = k.scan AND s.idx = k.idx"""


@query("ld_prune_grid", "dense_ld", sql=GRID, recursive=True)
def _(spark, sf):
    return L.ld_prune_grid(X.dense_ld(spark, sf), (0.1, 0.2, 0.5), (None, 0.45))
