"""Per-variant and per-sample aggregation, numbering and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..session import broadcast_if_rows, broadcast_if_small, cut_lineage, one_value
from .calls import (
    SITE,
    VARIANT,
    complete_calls_only,
    frequency_range,
    sample_total,
    sample_variants,
    snp_only,
)

#: Positions per numbering bucket. A bucket holds at most this many sites per allele pair.
NUMBERING_SPAN = 1 << 16
#: Entries per chunk of a genotype list or a sample vector.
LIST_CHUNK = 1 << 16


def variant_counts(calls: DataFrame) -> DataFrame:
    """Calls and alternate copies per variant."""
    return calls.groupBy(*VARIANT).agg(
        F.count(F.lit(1)).alias("nonmissing"), F.sum(G.dosage("alleles")).cast("bigint").alias("altTotal")
    )


def freq_dosage(calls: DataFrame) -> DataFrame:
    """``sum(dosage) / N`` per variant, a value between 0 and 2."""
    return (
        variant_counts(calls)
        .withColumn("frequency", F.col("altTotal") / sample_total(calls))
        .drop("altTotal")
    )


def freq_alt_total(calls: DataFrame) -> DataFrame:
    """Plain ``sum(dosage)`` per variant."""
    return variant_counts(calls).select(*VARIANT, "nonmissing", F.col("altTotal").alias("frequency"))


def allele_frequency(calls: DataFrame) -> DataFrame:
    """``sum(dosage) / 2n`` over the called samples of a variant."""
    return variant_counts(calls).select(
        *VARIANT, "nonmissing", (F.col("altTotal") / (2 * F.col("nonmissing"))).alias("alleleFrequency")
    )


def freq_carrier(distinct_variants: DataFrame, total: Column | None = None) -> DataFrame:
    """From distinct sample variants: group size and share of samples carrying an alternate allele.

    ``total`` is the sample count when it is cheaper to take from the calls.
    """
    if total is None:
        total = one_value(distinct_variants.agg(F.count_distinct("sampleId")))
    counted = distinct_variants.groupBy("variantId").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("altCount") > 0).alias("carriers")
    )
    return counted.select("variantId", "size", (F.col("carriers") / total).alias("frequency"))


def allele_number_and_alt_count(calls: DataFrame) -> DataFrame:
    """Alleles read and non-reference alleles per variant, in one aggregation (no self-join)."""
    return calls.groupBy(G.variant_id3().alias("variantId")).agg(
        F.sum(F.size("alleles")).cast("bigint").alias("variantSize"),
        F.sum(G.alt_count_nonref("alleles")).cast("bigint").alias("variantFrequency"),
    )


def select_by_allele_counts(
    counted: DataFrame, total: Column, missing_rate: float, low: float, high: float
) -> DataFrame:
    """The matching filter: bounds are multiples of the sample count."""
    return counted.filter(
        (F.col("variantSize") >= total * F.lit(1.0 - missing_rate))
        & (F.col("variantFrequency") >= total * F.lit(low))
        & (F.col("variantFrequency") <= total * F.lit(high))
    )


def _ordered_chunks(entries: DataFrame, by: list[str], key: str, chunk: int, out: str) -> DataFrame:
    """Sorted distinct entries ``e`` per group, cut into consecutive chunks of ``chunk`` entries; the last may be shorter.

    Keys are numbered in their order and cut into buckets. A group's list is gathered per bucket, and the running sizes of its
    buckets say which chunks an entry falls into. So chunks put together give one list whatever ``chunk`` is, and no task
    holds more of a group than a bucket or a chunk. With a single bucket, its list is cut in place.
    """
    keys = cut_lineage(entries.select(F.col("e")[key].alias("_key")).distinct())
    total = keys.count()
    gather = F.array_sort(F.collect_set("e")).alias("_l")
    if total <= chunk:
        lists = entries.groupBy(*by).agg(gather).withColumn("_o", F.lit(0).cast("bigint"))
    else:
        buckets = row_index(keys, "_key", out="_n").select("_key", F.floor(F.col("_n") / chunk).alias("_b"))
        placed = entries.join(broadcast_if_rows(buckets, total), F.col("e")[key].eqNullSafe(F.col("_key")))
        lists = placed.groupBy(*by, "_b").agg(gather)
        lists = lists.withColumn("_o", F.sum(F.size("_l")).over(W.partitionBy(*by).orderBy("_b")) - F.size("_l"))
    first, last = (F.floor(c / chunk).cast("int") for c in (F.col("_o"), F.col("_o") + F.size("_l") - 1))
    cut = lists.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * F.lit(chunk).cast("bigint") - F.col("_o"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * F.lit(chunk).cast("bigint") - F.col("_o"), F.size("_l")).cast("int")
    cut = cut.select(*by, "chunk", "_o", F.slice("_l", begin + 1, end - begin).alias(out))
    if total <= chunk:
        return cut.drop("_o")
    parts = F.array_sort(F.collect_list(F.struct("_o", out)))
    return cut.groupBy(*by, "chunk").agg(F.flatten(F.transform(parts, lambda p: p[out])).alias(out))


def genotype_list(calls: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Sorted ``id:dosage`` lists per variant, in consecutive chunks of ``chunk`` entries.

    Gathering into sets folds repeated calls before the shuffle, so no row or task ever holds an unbounded group.
    """
    entry = F.struct(F.col("sampleId").alias("id"), G.dosage("alleles").alias("dosage"))
    lists = _ordered_chunks(calls.select(*VARIANT, entry.alias("e")), VARIANT, "id", chunk, "_e")
    return lists.select(*VARIANT, "chunk", F.transform("_e", lambda e: G.genotype_text(e["id"], e["dosage"])).alias("genotype"))


def attach_genotypes(catalog: DataFrame, calls: DataFrame) -> DataFrame:
    """Catalogue rows with their sorted genotype list.

    Meant for catalogues of completely called variants, where a list has one entry per sample;
    :func:`genotype_list` splits longer ones.
    """
    lists = (
        calls.join(catalog.select(*VARIANT), VARIANT, "left_semi")
        .groupBy(*VARIANT)
        .agg(F.array_sort(F.collect_set(G.genotype_text("sampleId", G.dosage("alleles")))).alias("genotype"))
    )
    return catalog.join(lists, VARIANT)


def snp_index(variants: DataFrame, span: int = NUMBERING_SPAN, first: int = 0) -> DataFrame:
    """Dense numbers in (contig, start, ref, alt) order.

    Rows are numbered inside position buckets and shifted by the running bucket sizes, so no window
    covers a whole contig. ``variants`` must hold distinct variants.
    """
    bucketed = variants.withColumn("_b", F.floor(F.col("start") / span))
    sizes = bucketed.groupBy("contig", "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_contig = W.partitionBy("contig").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(in_contig), F.lit(0)))
    contigs = sizes.groupBy("contig").agg(F.sum("_n").alias("_c"))
    # One row per contig: the only ordering over the whole table is over contig names.
    ahead = W.orderBy("contig").rowsBetween(W.unboundedPreceding, -1)
    contigs = contigs.withColumn("_ahead", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c")
    shift = offsets.join(contigs, "contig").select(
        "contig", "_b", (F.col("_before") + F.col("_ahead") + F.lit(first - 1)).alias("_shift")
    )
    inside = W.partitionBy("contig", "_b").orderBy("start", "ref", "alt")
    return (
        bucketed.withColumn("_r", F.row_number().over(inside))
        .join(shift, ["contig", "_b"])
        .withColumn("snpIdx", (F.col("_r") + F.col("_shift")).cast("bigint"))
        .drop("_b", "_r", "_shift")
    )


def variant_catalog(calls: DataFrame, complete: bool = True, strict_biallelic: bool = False) -> DataFrame:
    """SNP catalogue: calls and dosage frequency per variant (lists: :func:`attach_genotypes`)."""
    snps = snp_only(calls)
    counted = variant_counts(snps)
    total = sample_total(calls)
    if complete:
        counted = complete_calls_only(counted, total)
    if strict_biallelic:
        site = ["contig", "start", "ref"]
        single = (
            snps.groupBy(*site).agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).filter("lo = hi").select(*site)
        )
        counted = counted.join(single, site, "left_semi")
    return counted.select(*VARIANT, "nonmissing", (F.col("altTotal") / total).alias("frequency"))


def sample_variant_dosage(
    calls: DataFrame, catalog: DataFrame, low: float = 0.0, high: float = float("inf")
) -> DataFrame:
    """Dosage per (sample, site) over the catalogued sites.

    Catalogue rows in the frequency range are counted per site first; calls at other sites are gone
    before anything is shuffled when that list is small enough to be sent along, and before the sums
    otherwise. Multiplying by the number of catalogue rows gives the same sums as joining every call
    with every row.
    """
    rows = (
        catalog.filter(F.col("frequency").between(low, high))
        .groupBy(*SITE)
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    chosen = calls.filter(G.not_double_other_alt("alleles")).join(broadcast_if_small(rows), SITE)
    return (
        chosen.groupBy("sampleId", *SITE, "_k")
        .agg(F.sum(G.dosage("alleles")).cast("bigint").alias("_d"))
        .select("sampleId", G.variant_id2().alias("variantId"), (F.col("_d") * F.col("_k")).alias("altCount"))
    )


def sample_vectors(
    long: DataFrame, variant_col: str = "variantId", value_col: str = "altCount", chunk: int = LIST_CHUNK
) -> DataFrame:
    """Per sample the variants in order with their values, in consecutive chunks of ``chunk`` entries.

    Repeated rows fold into one entry before the shuffle.
    """
    entry = F.struct(F.col(variant_col).alias("variant"), F.col(value_col).alias("value"))
    return _ordered_chunks(long.select("sampleId", entry.alias("e")), ["sampleId"], "variant", chunk, "variants")


def region_count(df: DataFrame, column: str = "Region") -> DataFrame:
    return df.agg(F.count_distinct(column).alias("regions"))


def column_stats(long: DataFrame, key: str = "idx", value: str = "dosage") -> DataFrame:
    """Mean and sample variance per variant."""
    return long.groupBy(key).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def row_stats(
    long: DataFrame,
    sample_col: str = "sampleId",
    value: str = "dosage",
    denominator: str = "row",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Mean and standard deviation per sample.

    ``denominator="row"`` divides by the row length; ``"samples"`` by the number of samples, with the
    deviations taken from that mean. Both come from three running sums, in one pass.
    """
    keys = [*by, sample_col]
    x = F.col(value).cast("double")
    sums = long.groupBy(*keys).agg(F.count(value).alias("_m"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    if denominator == "row":
        n: Column = F.col("_m")
    elif denominator == "samples":
        n = one_value(long.agg(F.count_distinct(sample_col)))
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    mean = F.col("_s") / n
    squares = F.greatest(F.col("_q") - 2 * mean * F.col("_s") + F.col("_m") * mean * mean, F.lit(0.0))
    deviation = F.when(n > 1, F.sqrt(squares / (n - 1)))
    return sums.select(*keys, mean.alias("mean"), deviation.alias("stddev"))


def matrix_dims(long: DataFrame, row: str = "sampleId", column: str = "idx") -> DataFrame:
    return long.agg(F.count_distinct(row).alias("nRows"), F.count_distinct(column).alias("nColumns"))


def average_over_repeats(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Mean of each metric per split and label over the repeats."""
    return metrics.groupBy("split", "label", "metric").agg(F.avg(value).alias(value))


# ---------------------------------------------------------------- numbering and running sums


def sample_index(df: DataFrame, key: str = "sampleId", out: str = "sidx", buckets: int = 64) -> DataFrame:
    """Dense numbers for distinct keys in a repeatable order, without a global sort.

    Keys are numbered inside hash buckets and shifted by the running bucket sizes (a table of
    ``buckets`` rows).
    """
    keys = df.select(key).distinct().withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_b").orderBy(key)
    return (
        keys.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(shift), "_b")  # at most `buckets` rows
        .select(key, (F.col("_r") + F.col("_shift") - 1).cast("int").alias(out))
    )


def row_index(df: DataFrame, *order: str, out: str = "rowIdx") -> DataFrame:
    """Position of each row in key order: its place in its range partition plus the rows of the earlier ones."""
    ordered = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_p", F.shiftright("_m", 33))
    before = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = before.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_shift"))
    place = F.col("_m") - F.shiftleft("_p", 33) + F.col("_shift")
    return ordered.join(F.broadcast(before), "_p").withColumn(out, place).drop("_m", "_p", "_shift")


def cumulative_share(values: DataFrame, position: str = "component", value: str = "value") -> DataFrame:
    """Share of the total and running share, in order of ``position`` (one row per component)."""
    total = one_value(values.agg(F.sum(value)))
    running = W.orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return values.withColumn("share", F.col(value) / total).withColumn("cumulative", F.sum("share").over(running))


def components_under(shares: DataFrame, threshold: float, at_least_one: bool = False) -> DataFrame:
    """Number of leading components whose running share stays at or below the threshold."""
    n = F.count_if(F.col("cumulative") <= threshold)
    return shares.agg((F.greatest(n, F.lit(1)) if at_least_one else n).cast("bigint").alias("components"))


def sort_snps(variants: DataFrame, descending: bool = True) -> DataFrame:
    order = F.col("snpIdx").desc() if descending else F.col("snpIdx").asc()
    return variants.orderBy(order)


def sort_samples(df: DataFrame, sample_col: str = "sampleId") -> DataFrame:
    return df.orderBy(sample_col)


def best_k(tuning: DataFrame, k: str = "k", score: str = "purity") -> DataFrame:
    """The k with the highest average score; the smaller k on a tie."""
    return tuning.orderBy(F.col(score).desc(), F.col(k)).limit(1)


def preview(df: DataFrame, *order: str, n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def population_matrix(
    calls: DataFrame, missing_rate: float = 0.0, low: float = 0.05, high: float = 1.0
) -> DataFrame:
    """Distinct sample variants of the variants that pass the carrier-frequency and missingness tests."""
    distinct_variants = sample_variants(calls)
    total = sample_total(calls)
    counted = freq_carrier(distinct_variants, total)
    kept = counted.filter(F.col("size") >= F.floor(total * F.lit(1.0 - missing_rate)))
    kept = frequency_range(kept, low, high, skip_full_range=True)
    return distinct_variants.join(kept.select("variantId"), "variantId", "left_semi")
