"""Projections and filters over calls, catalogues and wide matrices."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..session import broadcast_if_small, one_value

SITE = ["contig", "start"]
VARIANT = ["contig", "start", "ref", "alt"]
KEY_COLUMNS = ("sampleId", "SampleId", "Region")


# Fixed value: region of samples that the panel does not list.
UNKNOWN_REGION = "Unknown"


def flatten_calls(nested: DataFrame) -> DataFrame:
    """Nested genotype rows → flat columns; only the fields used later are read from the source."""
    return nested.select(
        "sampleId",
        F.col("variant.contig.contigName").alias("contig"),
        F.col("variant.start").alias("start"),
        F.col("variant.end").alias("end"),
        F.col("variant.referenceAllele").alias("ref"),
        F.col("variant.alternateAllele").alias("alt"),
        "alleles",
    )


def with_dosage(calls: DataFrame) -> DataFrame:
    return calls.withColumn("dosage", G.dosage("alleles"))


def with_alt_count(calls: DataFrame) -> DataFrame:
    return calls.withColumn("altCount", G.alt_count_nonref("alleles"))


def with_genotype_struct(calls: DataFrame) -> DataFrame:
    return calls.withColumn("genotypes", G.genotype_struct("sampleId", "alleles"))


def sample_variants(calls: DataFrame) -> DataFrame:
    """Distinct ``(sampleId, variantId, altCount)``."""
    return calls.select(
        "sampleId", G.variant_id3().alias("variantId"), G.alt_count_nonref("alleles").alias("altCount")
    ).distinct()


def snp_only(calls: DataFrame) -> DataFrame:
    return calls.filter(G.is_snp())


def sample_in(calls: DataFrame, samples: Iterable[str], sample_col: str = "sampleId") -> DataFrame:
    """Calls of the listed samples; a long list becomes a semi-join instead of a literal list."""
    wanted = list(dict.fromkeys(samples))
    if len(wanted) <= 1000:
        return calls.filter(F.col(sample_col).isin(wanted))
    listed = calls.sparkSession.createDataFrame([(s,) for s in wanted], f"{sample_col} string")
    return calls.join(listed, sample_col, "left_semi")


def panel_level(panel: DataFrame, level: str) -> str:
    """Name of the panel's population column."""
    return "Region" if level not in panel.columns and "Region" in panel.columns else level


def panel_population_filter(panel: DataFrame, keep: Iterable[str], level: str = "super_pop") -> DataFrame:
    return panel.filter(F.col(panel_level(panel, level)).isin(list(keep)))


def frequency_range(
    df: DataFrame, low: float, high: float, column: str = "frequency", skip_full_range: bool = False
) -> DataFrame:
    """Inclusive range; with ``skip_full_range`` the range ``[0, 1]`` means "no test"."""
    if skip_full_range and low == 0.0 and high == 1.0:
        return df
    return df.filter(F.col(column).between(low, high))


def missing_rate_filter(
    variants: DataFrame,
    sample_total: Column,
    rate: float,
    count_col: str = "nonmissing",
    truncate: bool = False,
) -> DataFrame:
    """Keep variants with ``count >= N * (1 - rate)``.

    ``count_col`` picks the unit (calls or alleles); ``truncate`` cuts the bound to an integer.
    """
    bound = sample_total * F.lit(1.0 - rate)
    if truncate:
        bound = F.floor(bound)
    return variants.filter(F.col(count_col) >= bound)


def complete_calls_only(variants: DataFrame, sample_total: Column, count_col: str = "nonmissing") -> DataFrame:
    return variants.filter(F.col(count_col) == sample_total)


def drop_double_other_alt(calls: DataFrame) -> DataFrame:
    return calls.filter(G.not_double_other_alt("alleles"))


def biallelic(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Calls at sites with one alternate allele.

    The non-strict form groups by the alternate allele itself and therefore keeps every call. The
    strict form compares the smallest and largest allele of a site: one partial aggregation, no
    distinct count.
    """
    if not strict:
        return calls
    site = ["contig", "start", "ref"]
    single = (
        calls.groupBy(*site)
        .agg(F.min("alt").alias("lo"), F.max("alt").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
        .select(*site)
    )
    return calls.join(single, site, "left_semi")


def prune_variants(df: DataFrame, keep: DataFrame, on: str | list[str] = "variantId") -> DataFrame:
    """Rows of the kept variants only."""
    keys = [on] if isinstance(on, str) else on
    return df.join(keep.select(*keys), keys, "left_semi")


def prune_columns(wide: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Wide form: key columns and the kept variant columns."""
    keys = [c for c in wide.columns if c in KEY_COLUMNS]
    return wide.select(*[F.col(f"`{c}`") for c in [*keys, *keep]])


def locus_range(calls: DataFrame, start: int, end: int) -> DataFrame:
    return calls.filter((F.col("start") >= start) & (F.col("end") <= end))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(passes, fails); rows with a NULL predicate fail."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def maf_filter(variants: DataFrame, maf: float | None, freq_col: str = "alleleFrequency") -> DataFrame:
    """Minor-allele frequency bound; ``None`` or NaN switches it off."""
    if maf is None or maf != maf:
        return variants
    p = F.col(freq_col)
    return variants.filter(F.least(p, 1 - p) >= maf)


def feature_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in KEY_COLUMNS]


def drop_keys(wide: DataFrame) -> DataFrame:
    return wide.select(*[F.col(f"`{c}`") for c in feature_columns(wide)])


def vector_slice(df: DataFrame, n: int, column: str = "values", out: str | None = None) -> DataFrame:
    """First ``n`` components of an array column."""
    return df.withColumn(out or column, F.slice(F.col(column), 1, n))


def sample_count(calls: DataFrame) -> DataFrame:
    """Distinct samples, as a one-row table."""
    return calls.agg(F.count_distinct("sampleId").alias("sampleCount"))


def sample_total(calls: DataFrame) -> Column:
    """The same number as a scalar subquery, for use inside other operators."""
    return one_value(sample_count(calls))


# ---------------------------------------------------------------- joins


def calls_join_catalog(
    calls: DataFrame,
    catalog: DataFrame,
    low: float = 0.0,
    high: float = float("inf"),
    on_alleles: bool = False,
) -> DataFrame:
    """Calls at catalogued sites whose frequency is in range.

    By default the join ignores the alleles, so a site with several catalogue rows repeats its calls.
    """
    keys = VARIANT if on_alleles else SITE
    picked = catalog.filter(F.col("frequency").between(low, high))
    if on_alleles:
        picked = picked.select(*VARIANT, "frequency")
    else:
        picked = picked.select(*SITE, F.col("alt").alias("catalogAlt"), "frequency")
    return calls.join(picked, keys, "inner")


def attach_region(
    df: DataFrame, panel: DataFrame, level: str = "super_pop", sample_col: str = "sampleId", default: str = UNKNOWN_REGION
) -> DataFrame:
    """Panel lookup; samples outside the panel get ``default``.

    A panel that was read at one level already holds it as ``Region``.
    """
    lookup = panel.select(F.col("sampleId").alias(sample_col), F.col(panel_level(panel, level)).alias("Region"))
    return df.join(broadcast_if_small(lookup), sample_col, "left").withColumn(
        "Region", F.coalesce("Region", F.lit(default))
    )


def panel_semi_join(calls: DataFrame, panel: DataFrame) -> DataFrame:
    return calls.join(broadcast_if_small(panel.select("sampleId")), "sampleId", "left_semi")


def variant_semi_join(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """Calls whose ``contig:start:end`` is among the kept variants."""
    return calls.withColumn("variantId", G.variant_id3()).join(
        variants.select("variantId"), "variantId", "left_semi"
    )


def attach_prediction(features: DataFrame, predictions: DataFrame, key: str = "sampleId") -> DataFrame:
    """Predictions kept in another table, joined back by key."""
    return features.join(predictions, key, "inner")


def keyed_zip(left: DataFrame, right: DataFrame, key: str = "sampleId") -> DataFrame:
    """Two tables about the same samples side by side; replaces zipping by position."""
    return left.join(right, key, "inner")


def union_picks(forward: DataFrame, backward: DataFrame) -> DataFrame:
    return forward.unionByName(backward)
