"""Quality metrics of a labelling. Everything starts from one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, truth: str = "y", predicted: str = "p", complete: bool = False) -> DataFrame:
    """``(y, p, n)``; ``complete`` adds the empty cells."""
    counts = df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    if not complete:
        return counts
    sides = counts.agg(F.collect_set("y").alias("ys"), F.collect_set("p").alias("ps"))  # one row of class names
    grid = sides.select(F.explode("ys").alias("y"), "ps").select("y", F.explode("ps").alias("p"))
    return grid.join(counts, ["y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wide_confusion(cm: DataFrame, predicted_values: list) -> DataFrame:
    """One column per prediction value."""
    return cm.groupBy("y").pivot("p", predicted_values).agg(F.sum("n")).na.fill(0)


def purity(cm: DataFrame, percent: bool = False) -> DataFrame:
    """Share of rows in the majority class of their cluster."""
    best = cm.groupBy("p").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    scale = 100.0 if percent else 1.0
    return best.agg((F.lit(scale) * F.sum("best") / F.sum("n")).alias("purity"))


def accuracy(cm: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    return cm.agg(F.round(100.0 * hit / F.sum("n"), 2).alias("accuracy"))


def class_margins(cm: DataFrame) -> DataFrame:
    """Per class: rows (``actual``), predictions (``predicted``) and hits (``tp``)."""
    sides = cm.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("q"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("t")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("q"),
                         F.lit(0).cast("bigint").alias("t")),
            )
        ).alias("s")
    ).select("s.*")
    return sides.groupBy("class").agg(
        F.sum("a").alias("actual"), F.sum("q").alias("predicted"), F.sum("t").alias("tp")
    )


def per_class_prf(cm: DataFrame, percent: bool = True) -> DataFrame:
    """Precision, recall and F1 per class; percent at two decimals, or plain fractions."""
    precision = F.try_divide(F.col("tp"), F.col("predicted"))
    recall = F.try_divide(F.col("tp"), F.col("actual"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("actual"))
    rated = class_margins(cm).select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    if not percent:
        return rated
    return rated.select("class", *[F.round(F.col(c) * 100, 2).alias(c) for c in ("precision", "recall", "f1")])


def macro_prf(cm: DataFrame) -> DataFrame:
    rated = per_class_prf(cm, percent=False)
    return rated.agg(*[F.round(F.avg(c) * 100, 2).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def one_vs_all(cm: DataFrame) -> DataFrame:
    """Per class the 2x2 table against the rest."""
    n = F.sum("actual").over(W.partitionBy())  # one row per class
    return class_margins(cm).select(
        "class", "tp", (F.col("actual") - F.col("tp")).alias("fn"), (F.col("predicted") - F.col("tp")).alias("fp"),
        (n - F.col("actual") - F.col("predicted") + F.col("tp")).alias("tn"),
    )


def one_vs_all_total(cm: DataFrame) -> DataFrame:
    return one_vs_all(cm).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])


def average_accuracy(cm: DataFrame) -> DataFrame:
    t = one_vs_all_total(cm)
    hit = F.col("tp") + F.col("tn")
    return t.select(F.round(100.0 * hit / (hit + F.col("fn") + F.col("fp")), 2).alias("average_accuracy"))


def micro_prf(cm: DataFrame) -> DataFrame:
    t = one_vs_all_total(cm)
    return t.select(F.round(100.0 * F.col("tp") / (F.col("tp") + F.col("fn")), 2).alias("micro_prf"))


def _class_shares(cm: DataFrame) -> DataFrame:
    per_class = cm.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("n"))
    return per_class.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def majority_class_baseline(cm: DataFrame) -> DataFrame:
    """Metrics of always predicting the largest class (first name on a tie)."""
    order = W.orderBy(F.col("n").desc(), F.col("class"))
    ranked = _class_shares(cm).withColumn("top", F.row_number().over(order) == 1)
    p = F.when(F.col("top"), F.col("share")).otherwise(0.0)
    return ranked.select(
        "class",
        F.round(100 * F.when(F.col("top"), 1.0).otherwise(0.0), 2).alias("recall"),
        F.round(100 * p, 2).alias("precision"),
        F.round(100 * 2 * p / (p + 1), 2).alias("f1"),
    )


def majority_class_accuracy(cm: DataFrame) -> DataFrame:
    return _class_shares(cm).agg(F.max("share").alias("majority_accuracy"))


def random_guess_baseline(cm: DataFrame) -> DataFrame:
    """Metrics of guessing every class with the same chance."""
    shares = _class_shares(cm).withColumn("nc", F.count(F.lit(1)).over(W.partitionBy()))
    p, nc = F.col("share"), F.col("nc")
    return shares.select(
        "class", F.round(100 / nc, 2).alias("accuracy"), F.round(100 / nc, 2).alias("recall"),
        F.round(100 * p, 2).alias("precision"), F.round(100 * 2 * p / (nc * p + 1), 2).alias("f1"),
    )


def kappa(cm: DataFrame, parity: bool = False) -> DataFrame:
    """Agreement beyond chance. ``parity`` puts the accuracy in as a percentage at two decimals."""
    n = F.sum("actual").cast("double")
    both = F.sum(F.col("actual").cast("double") * F.col("predicted"))
    m = class_margins(cm).agg((F.sum("tp") / n).alias("acc"), (both / (n * n)).alias("chance"))
    acc = F.round(F.col("acc") * 100, 2) if parity else F.col("acc")
    return m.select(F.round((acc - F.col("chance")) / (1 - F.col("chance")), 2).alias("kappa"))


# ---------------------------------------------------------------- pair-count indices


def pair_agreement(cm: DataFrame) -> DataFrame:
    """yy, yn, ny, nn and their total from the contingency table, as doubles; no pair is formed."""

    def pairs(c: str | Column) -> Column:
        x = (F.col(c) if isinstance(c, str) else c).cast("double")
        return x * (x - 1) / 2

    # Margins of both labellings and the cell pairs in one regrouping of the contingency table.
    sides = cm.select(
        F.explode(
            F.array(
                F.struct(F.lit("y").alias("side"), F.col("y").cast("string").alias("key"), "n", pairs("n").alias("yy")),
                F.struct(F.lit("p").alias("side"), F.col("p").cast("string").alias("key"), "n", F.lit(0.0).alias("yy")),
            )
        ).alias("s")
    ).select("s.*")
    margins = sides.groupBy("side", "key").agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"))
    first = F.col("side") == "y"
    sums = margins.agg(
        F.sum("yy").alias("yy"), F.sum(F.when(first, pairs("n"))).alias("a"), F.sum(F.when(~first, pairs("n"))).alias("b"),
        pairs(F.sum(F.when(first, F.col("n")))).alias("t"),
    )
    out = sums.select("yy", (F.col("a") - F.col("yy")).alias("yn"), (F.col("b") - F.col("yy")).alias("ny"), "t")
    return out.withColumn("nn", F.col("t") - F.col("yy") - F.col("yn") - F.col("ny"))


def rand_index(cm: DataFrame) -> DataFrame:
    return pair_agreement(cm).select(((F.col("yy") + F.col("nn")) / F.col("t")).alias("rand_index"))


def external_indices(cm: DataFrame) -> DataFrame:
    """Comparison indices of two labellings as one row; McNemar is ``(yn - ny) / sqrt(yn + ny)``."""
    yy, yn, ny, nn, t = (F.col(c) for c in ("yy", "yn", "ny", "nn", "t"))
    div = F.try_divide
    same_1, same_2 = yy + yn, yy + ny
    off_1, off_2 = nn + yn, nn + ny
    indices = {
        "czekanowski_dice": div(2 * yy, 2 * yy + yn + ny),
        "folkes_mallows": div(yy, F.sqrt(same_1 * same_2)),
        "hubert": div(t * yy - same_1 * same_2, F.sqrt(same_1 * same_2 * off_1 * off_2)),
        "jaccard": div(yy, yy + yn + ny),
        "kulczynski": (div(yy, same_2) + div(yy, same_1)) / 2,
        "mcnemar": div(yn - ny, F.sqrt(yn + ny)),
        "phi": div(yy * nn - yn * ny, same_1 * same_2 * off_1 * off_2),
        "precision": div(yy, same_2),
        "rand": div(yy + nn, t),
        "recall": div(yy, same_1),
        "rogers_tanimoto": div(yy + nn, yy + nn + 2 * (yn + ny)),
        "russel_rao": div(yy, t),
        "sokal_sneath1": div(yy, yy + 2 * (yn + ny)),
        "sokal_sneath2": div(yy + nn, yy + nn + (yn + ny) / 2),
    }
    return pair_agreement(cm).select(*[c.alias(name) for name, c in indices.items()])


def label_mapping(df: DataFrame, region: str = "Region", label: str = "label") -> DataFrame:
    return df.select(region, label).distinct()


def summary(df: DataFrame, *statistics: str) -> DataFrame:
    return df.summary(*statistics)


def as_long(df: DataFrame, metric: str, key: str | None = None) -> DataFrame:
    """Metric table → ``(metric, name, class, value)`` rows."""
    values = [c for c in df.columns if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in values]))
    owner = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(F.lit(metric).alias("metric"), owner.alias("class"), pairs.alias("_v")).select(
        "metric", F.col("_v.name").alias("name"), "class", F.col("_v.value").alias("value")
    )


def evaluation_report(cm: DataFrame) -> DataFrame:
    """All label metrics as one long table."""
    parts = [
        as_long(purity(cm, percent=True), "purity"),
        as_long(rand_index(cm), "rand_index"),
        as_long(external_indices(cm), "external_indices"),
        as_long(accuracy(cm), "accuracy"),
        as_long(per_class_prf(cm), "per_class_prf", "class"),
        as_long(macro_prf(cm), "macro_prf"),
        as_long(one_vs_all(cm), "one_vs_all", "class"),
        as_long(average_accuracy(cm), "average_accuracy"),
        as_long(micro_prf(cm), "micro_prf"),
        as_long(majority_class_baseline(cm), "majority_class_baseline", "class"),
        as_long(random_guess_baseline(cm), "random_guess_baseline", "class"),
        as_long(kappa(cm), "kappa"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
