"""Quality metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import distance as DI
from ..operators import metrics as M
from ..plans import jobs as J
from .base import query, r6, rounded

CM = "SELECT y, p, count(*) AS n FROM pred GROUP BY y, p"
N = "(SELECT count(*) FROM pred)"
MARGINS = f"""SELECT c.class, coalesce(a.n, 0) AS actual, coalesce(q.n, 0) AS predicted, coalesce(t.n, 0) AS tp
  FROM (SELECT y AS class FROM pred UNION SELECT p FROM pred) c
  LEFT JOIN (SELECT y AS class, count(*) AS n FROM pred GROUP BY y) a USING (class)
  LEFT JOIN (SELECT p AS class, count(*) AS n FROM pred GROUP BY p) q USING (class)
  LEFT JOIN (SELECT y AS class, count(*) AS n FROM pred WHERE y = p GROUP BY y) t USING (class)"""
PRF = f"""SELECT class, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN actual > 0 THEN tp / CAST(actual AS DOUBLE) END AS recall,
  CASE WHEN predicted > 0 AND actual > 0 THEN 2.0 * (tp / CAST(predicted AS DOUBLE)) * (tp / CAST(actual AS DOUBLE)) / (tp / CAST(predicted AS DOUBLE) + tp / CAST(actual AS DOUBLE)) END AS f1
  FROM ({MARGINS}) m"""
OVA = f"""SELECT class, CAST(tp AS BIGINT) AS tp, CAST(actual - tp AS BIGINT) AS fn, CAST(predicted - tp AS BIGINT) AS fp,
  CAST({N} - actual - predicted + tp AS BIGINT) AS tn FROM ({MARGINS}) m"""
SHARES = "SELECT y AS class, count(*) / CAST((SELECT count(*) FROM pred) AS DOUBLE) AS share, count(*) AS n FROM pred GROUP BY y"
PAIRS = f"""SELECT *, t - yy - yn - ny AS nn FROM (SELECT yy, a - yy AS yn, b - yy AS ny, t FROM
  (SELECT CAST(sum(n * (n - 1) / 2.0) AS DOUBLE) AS yy FROM ({CM}) c),
  (SELECT CAST(sum(n * (n - 1) / 2.0) AS DOUBLE) AS a FROM (SELECT count(*) AS n FROM pred GROUP BY y) c),
  (SELECT CAST(sum(n * (n - 1) / 2.0) AS DOUBLE) AS b FROM (SELECT count(*) AS n FROM pred GROUP BY p) c),
  (SELECT CAST(count(*) * (count(*) - 1) / 2.0 AS DOUBLE) AS t FROM pred)) x"""
INDICES = {
    "czekanowski_dice": "2 * yy / (2 * yy + yn + ny)",
    "folkes_mallows": "yy / sqrt((yy + yn) * (yy + ny))",
    "hubert": "(t * yy - (yy + yn) * (yy + ny)) / sqrt((yy + yn) * (yy + ny) * (nn + yn) * (nn + ny))",
    "jaccard": "yy / (yy + yn + ny)",
    "kulczynski": "0.5 * (yy / (yy + ny) + yy / (yy + yn))",
    "mcnemar": "(yn - ny) / sqrt(yn + ny)",
    "phi": "(yy * nn - yn * ny) / ((yy + yn) * (yy + ny) * (yn + nn) * (ny + nn))",
    "precision": "yy / (yy + ny)",
    "rand": "(yy + nn) / t",
    "recall": "yy / (yy + yn)",
    "rogers_tanimoto": "(yy + nn) / (yy + nn + 2 * (yn + ny))",
    "russel_rao": "yy / t",
    "sokal_sneath1": "yy / (yy + 2 * (yn + ny))",
    "sokal_sneath2": "(yy + nn) / (yy + nn + 0.5 * (yn + ny))",
}
PURITY = f"SELECT sum(best) / CAST(sum(n) AS DOUBLE) AS purity FROM (SELECT p, max(n) AS best, sum(n) AS n FROM ({CM}) c GROUP BY p) b"
KAPPA = f"SELECT sum(tp) / CAST({N} AS DOUBLE) AS acc, sum(actual / CAST({N} AS DOUBLE) * (predicted / CAST({N} AS DOUBLE))) AS chance FROM ({MARGINS}) m"
MICRO = f"SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn FROM ({OVA}) o"
MAJORITY = f"SELECT class, share, row_number() OVER (ORDER BY n DESC, class) = 1 AS top FROM ({SHARES}) s"


def _cm(spark, sf):
    return M.confusion_matrix(X.pred(spark, sf))


@query("purity", "pred", sql=f"SELECT round(purity, 6) AS purity FROM ({PURITY}) p")
def _(spark, sf):
    return rounded(M.purity(_cm(spark, sf)), "purity")


@query("confusion_matrix", "pred", sql=CM)
def _(spark, sf):
    return _cm(spark, sf)


@query(
    "confusion_matrix_complete", "pred",
    sql=f"""SELECT y, p, coalesce(n, 0) AS n FROM (SELECT DISTINCT y FROM pred) a CROSS JOIN (SELECT DISTINCT p FROM pred) b
    LEFT JOIN ({CM}) c USING (y, p)""",
)
def _(spark, sf):
    return M.confusion_matrix(X.pred(spark, sf), complete=True)


@query(
    "confusion_matrix_wide", "pred",
    sql="SELECT y, " + ", ".join(f"count(*) FILTER (WHERE p = '{v}') AS {v}" for v in "ANR") + " FROM pred GROUP BY y",
)
def _(spark, sf):
    return M.wide_confusion(_cm(spark, sf), ["A", "N", "R"])


@query("accuracy", "pred", sql=f"SELECT round(100.0 * count(*) FILTER (WHERE y = p) / CAST(count(*) AS DOUBLE), 2) AS accuracy FROM pred")
def _(spark, sf):
    return M.accuracy(_cm(spark, sf))


@query("per_class_prf", "pred", sql=f"SELECT class, round(precision * 100, 2) AS precision, round(recall * 100, 2) AS recall, round(f1 * 100, 2) AS f1 FROM ({PRF}) x")
def _(spark, sf):
    return M.per_class_prf(_cm(spark, sf))


@query(
    "macro_prf", "pred",
    sql=f"SELECT round(avg(precision) * 100, 2) AS macro_precision, round(avg(recall) * 100, 2) AS macro_recall, round(avg(f1) * 100, 2) AS macro_f1 FROM ({PRF}) x",
)
def _(spark, sf):
    return M.macro_prf(_cm(spark, sf))


@query("one_vs_all", "pred", sql=OVA)
def _(spark, sf):
    return M.one_vs_all(_cm(spark, sf))


@query("average_accuracy", "pred", sql=f"SELECT round(100.0 * (tp + tn) / CAST(tp + tn + fn + fp AS DOUBLE), 2) AS average_accuracy FROM ({MICRO}) m")
def _(spark, sf):
    return M.average_accuracy(_cm(spark, sf))


@query("micro_prf", "pred", sql=f"SELECT round(100.0 * tp / CAST(tp + fn AS DOUBLE), 2) AS micro_prf FROM ({MICRO}) m")
def _(spark, sf):
    return M.micro_prf(_cm(spark, sf))


@query(
    "majority_class_baseline", "pred",
    sql=f"""SELECT class, CASE WHEN top THEN 100.0 ELSE 0.0 END AS recall, CASE WHEN top THEN round(100 * share, 2) ELSE 0.0 END AS precision,
      CASE WHEN top THEN round(100 * 2 * share / (share + 1), 2) ELSE 0.0 END AS f1 FROM ({MAJORITY}) m""",
)
def _(spark, sf):
    return rounded(M.majority_class_baseline(_cm(spark, sf)), "recall", "precision", "f1")


@query("majority_class_accuracy", "pred", sql=f"SELECT round(max(share), 6) AS majority_accuracy FROM ({SHARES}) s")
def _(spark, sf):
    return rounded(M.majority_class_accuracy(_cm(spark, sf)), "majority_accuracy")


@query(
    "random_guess_baseline", "pred",
    sql=f"""SELECT class, round(100.0 / nc, 2) AS accuracy, round(100.0 / nc, 2) AS recall, round(100 * share, 2) AS precision,
      round(100 * 2 * share / (nc * share + 1), 2) AS f1 FROM (SELECT *, count(*) OVER () AS nc FROM ({SHARES}) s) x""",
)
def _(spark, sf):
    return M.random_guess_baseline(_cm(spark, sf))


@query("kappa", "pred", sql=f"SELECT round((acc - chance) / (1 - chance), 2) AS kappa FROM ({KAPPA}) k")
def _(spark, sf):
    return M.kappa(_cm(spark, sf))


@query("kappa_parity", "pred", sql=f"SELECT round((round(acc * 100, 2) - chance) / (1 - chance), 2) AS kappa FROM ({KAPPA}) k")
def _(spark, sf):
    return M.kappa(_cm(spark, sf), parity=True)


@query("rand_index", "pred", sql=f"SELECT round((yy + nn) / t, 6) AS rand_index FROM ({PAIRS}) p")
def _(spark, sf):
    return rounded(M.rand_index(_cm(spark, sf)), "rand_index")


@query("external_indices", "pred", sql="SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in INDICES.items()) + f" FROM ({PAIRS}) p")
def _(spark, sf):
    return rounded(M.external_indices(_cm(spark, sf)), *INDICES)


@query("label_mapping", "pred", sql="SELECT DISTINCT y AS Region, CASE y WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM pred")
def _(spark, sf):
    labelled = X.pred(spark, sf).select(F.col("y").alias("Region"), F.when(F.col("y") == "A", 0).when(F.col("y") == "N", 1).otherwise(2).alias("label"))
    return M.label_mapping(labelled)


@query(
    "summary", "dense",
    sql="""SELECT 'count' AS summary, CAST(count(w) AS DOUBLE) AS w, CAST(count(dosage) AS DOUBLE) AS dosage FROM dense
    UNION ALL SELECT 'mean', round(avg(w), 6), round(avg(dosage), 6) FROM dense
    UNION ALL SELECT 'stddev', round(stddev_samp(w), 6), round(stddev_samp(dosage), 6) FROM dense
    UNION ALL SELECT 'min', round(min(w), 6), min(dosage) FROM dense
    UNION ALL SELECT 'max', round(max(w), 6), max(dosage) FROM dense""",
)
def _(spark, sf):
    table = M.summary(X.dense(spark, sf).select("w", "dosage"), "count", "mean", "stddev", "min", "max")
    return table.select("summary", r6("w").alias("w"), r6("dosage").alias("dosage"))


# ---------------------------------------------------------------- distance-based indices

DIST = """SELECT a.sampleId AS i, b.sampleId AS j, min(a.pop) AS li, min(b.pop) AS lj, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS dist
  FROM dense a JOIN dense b ON a.idx = b.idx AND a.sampleId < b.sampleId GROUP BY a.sampleId, b.sampleId"""


@query(
    "calinski_harabasz", "dense",
    sql="""SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM (
      SELECT sum(nk * (ck - c) * (ck - c)) AS b FROM (SELECT pop, idx, count(*) AS nk, avg(w) AS ck FROM dense GROUP BY pop, idx) x
        JOIN (SELECT idx, avg(w) AS c FROM dense GROUP BY idx) y USING (idx)) bt,
      (SELECT sum((d.w - ck) * (d.w - ck)) AS w FROM dense d JOIN (SELECT pop, idx, avg(w) AS ck FROM dense GROUP BY pop, idx) x
        ON x.pop = d.pop AND x.idx = d.idx) wt,
      (SELECT count(DISTINCT pop) AS k, count(DISTINCT sampleId) AS n FROM dense) s""",
)
def _(spark, sf):
    return rounded(DI.calinski_harabasz(X.dense(spark, sf), "pop"), "calinski_harabasz")


@query("dunn", "dense", sql=f"SELECT round(min(dist) FILTER (WHERE li <> lj) / max(dist) FILTER (WHERE li = lj), 6) AS dunn FROM ({DIST}) d")
def _(spark, sf):
    return rounded(DI.pair_indices(X.dense(spark, sf), "pop").select("dunn"), "dunn")


@query(
    "c_index", "dense",
    sql=f""", d AS (SELECT dist, li = lj AS same, row_number() OVER (ORDER BY dist) AS r, count(*) OVER () AS n,
        count(*) FILTER (WHERE li = lj) OVER () AS nw FROM ({DIST}) x)
    SELECT round((s - lo) / (hi - lo), 6) AS c_index FROM (SELECT sum(dist) FILTER (WHERE same) AS s, sum(dist) FILTER (WHERE r <= nw) AS lo,
      sum(dist) FILTER (WHERE r > n - nw) AS hi FROM d) t""",
)
def _(spark, sf):
    return rounded(DI.pair_indices(X.dense(spark, sf), "pop").select("c_index"), "c_index")


def _long(metric: str, table: str, names: list[str], key: str = "CAST(NULL AS VARCHAR)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, '{n}' AS name, {key} AS class, CAST({n} AS DOUBLE) AS value FROM ({table}) t" for n in names
    )


REPORT = " UNION ALL ".join(
    [
        _long("purity", f"SELECT round(purity * 100, 6) AS purity FROM ({PURITY}) p", ["purity"]),
        _long("rand_index", f"SELECT round((yy + nn) / t, 6) AS rand_index FROM ({PAIRS}) p", ["rand_index"]),
        _long("external_indices", "SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in INDICES.items()) + f" FROM ({PAIRS}) p", list(INDICES)),
        _long("accuracy", "SELECT round(100.0 * count(*) FILTER (WHERE y = p) / CAST(count(*) AS DOUBLE), 2) AS accuracy FROM pred", ["accuracy"]),
        _long("per_class_prf", f"SELECT class, round(precision * 100, 2) AS precision, round(recall * 100, 2) AS recall, round(f1 * 100, 2) AS f1 FROM ({PRF}) x", ["precision", "recall", "f1"], "class"),
        _long("macro_prf", f"SELECT round(avg(precision) * 100, 2) AS macro_precision, round(avg(recall) * 100, 2) AS macro_recall, round(avg(f1) * 100, 2) AS macro_f1 FROM ({PRF}) x", ["macro_precision", "macro_recall", "macro_f1"]),
        _long("one_vs_all", OVA, ["tp", "fn", "fp", "tn"], "class"),
        _long("average_accuracy", f"SELECT round(100.0 * (tp + tn) / CAST(tp + tn + fn + fp AS DOUBLE), 2) AS average_accuracy FROM ({MICRO}) m", ["average_accuracy"]),
        _long("micro_prf", f"SELECT round(100.0 * tp / CAST(tp + fn AS DOUBLE), 2) AS micro_prf FROM ({MICRO}) m", ["micro_prf"]),
        _long("majority_class_baseline", f"SELECT class, CASE WHEN top THEN 100.0 ELSE 0.0 END AS recall, CASE WHEN top THEN round(100 * share, 2) ELSE 0.0 END AS precision, CASE WHEN top THEN round(100 * 2 * share / (share + 1), 2) ELSE 0.0 END AS f1 FROM ({MAJORITY}) m", ["recall", "precision", "f1"], "class"),
        _long("random_guess_baseline", f"SELECT class, round(100.0 / nc, 2) AS accuracy, round(100.0 / nc, 2) AS recall, round(100 * share, 2) AS precision, round(100 * 2 * share / (nc * share + 1), 2) AS f1 FROM (SELECT *, count(*) OVER () AS nc FROM ({SHARES}) s) x", ["accuracy", "recall", "precision", "f1"], "class"),
        _long("kappa", f"SELECT round((acc - chance) / (1 - chance), 2) AS kappa FROM ({KAPPA}) k", ["kappa"]),
    ]
)


@query("evaluation_report_job", "pred", sql=REPORT)
def _(spark, sf):
    return rounded(J.evaluation_report_job(X.pred(spark, sf), "y", "p"), "value")
