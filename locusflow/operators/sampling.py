"""Subsamples, outliers and train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, one_value
from . import halves as H
from .catalog import row_stats

SEED = 1234


def half_subsamples(samples: DataFrame, reps: int | None = None, key: str = "sampleId") -> DataFrame:
    """``reps`` random halves of the samples (default: half as many as there are samples), one row per member.

    A subset takes the samples with the smallest hash of (repeat, id), so it is repeatable and needs no
    random state. Statistics over the subsets take :func:`halves.half_masks` and form no such rows.
    """
    return H.members(H.half_masks(samples, reps, key))


def _variance(n: str = "n", s: str = "s", q: str = "q") -> Column:
    n, s, q = F.col(n), F.col(s), F.col(q)
    return F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))


def subsample_column_stats(
    long: DataFrame, masks: DataFrame, sample_col: str = "sampleId", variant: str = "idx", value: str = "dosage"
) -> DataFrame:
    """Mean and sample variance per variant in each subset; ``masks`` from :func:`halves.half_masks`."""
    sums = H.column_sums(long, masks, sample_col, variant, value)
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return sums.select("rep", variant, mean.alias("mean"), _variance().alias("variance"))


def subsample_row_stats(
    long: DataFrame, masks: DataFrame, sample_col: str = "sampleId", value: str = "dosage"
) -> DataFrame:
    """Mean and deviation per sample in each subset.

    A row does not depend on which subset it is in, so the rows are summed once; only the result repeats them.
    """
    stats = row_stats(long, sample_col, value)
    return H.members(masks.join(stats, sample_col)).select("rep", sample_col, "mean", "stddev")


def find_outliers(
    long: DataFrame, masks: DataFrame, z: float = 3.0, sample_col: str = "sampleId", variant: str = "idx", value: str = "dosage"
) -> DataFrame:
    """Samples whose mean lies more than ``z`` standard deviations from the subset average.

    The centre and spread are those of the sample means inside the subsets, averaged over the subsets.
    """
    means = cut_lineage(row_stats(long, sample_col, value).select(sample_col, "mean"))
    # Sums are taken about the overall mean, so that squares lose no digits.
    shift = one_value(means.agg(F.avg("mean")))
    sums = H.value_sums(masks.join(means.select(sample_col, (F.col("mean") - shift).alias("_m")), sample_col), "_m")
    per_rep = sums.select((F.col("s") / F.col("n")).alias("m"), F.sqrt(_variance()).alias("sd"))
    found = cut_lineage(per_rep.agg(F.avg("m").alias("m"), F.avg("sd").alias("sd")))  # one row
    scored = means.withColumn("zscore", (F.col("mean") - shift - one_value(found.select("m"))) / one_value(found.select("sd")))
    return scored.filter(F.abs("zscore") > z).select(sample_col, "zscore")


def drop_outliers(long: DataFrame, outliers: DataFrame, sample_col: str = "sampleId") -> DataFrame:
    return long.join(outliers.select(sample_col), sample_col, "left_anti")


def split_score(key: Column | str, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) from the first 28 bits of a hash of the key."""
    k = F.col(key) if isinstance(key, str) else key
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k)), 1, 7)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 28))


def train_test_split(
    df: DataFrame, ratio: float = 0.7, seed: int = SEED, rep: int = 0, key: str = "sampleId"
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows whatever the partitioning, another split per repeat."""
    score = split_score(key, seed + rep)
    return df.filter(score < ratio), df.filter(score >= ratio)


def frame_split(df: DataFrame, ratio: float = 0.7, seed: int = SEED, key: str = "sampleId") -> tuple[DataFrame, DataFrame]:
    """(training, validation) for the reductions that fit on a part."""
    return train_test_split(df, ratio, seed, 0, key)
