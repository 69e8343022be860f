"""Column expressions over genotype calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allele codes of a call.
REF, ALT, OTHER_ALT, NO_CALL = "Ref", "Alt", "OtherAlt", "NoCall"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def allele_at(alleles: Column | str, position: int) -> Column:
    """Allele by position; NULL when the call is shorter (haploid calls)."""
    return F.get(_col(alleles), F.lit(position))


def dosage(alleles: Column | str = "alleles") -> Column:
    """Copies of the alternate allele among the first two alleles: 0, 1 or 2."""
    copies = [F.coalesce((allele_at(alleles, k) == ALT).cast("int"), F.lit(0)) for k in (0, 1)]
    return copies[0] + copies[1]


def alt_count_nonref(alleles: Column | str = "alleles") -> Column:
    """Number of alleles that differ from the reference, whatever their code or ploidy."""
    return F.size(F.filter(_col(alleles), lambda a: a != REF))


def genotype_struct(sample: Column | str = "sampleId", alleles: Column | str = "alleles") -> Column:
    return F.struct(_col(sample).alias("id"), dosage(alleles).alias("genotype"))


def variant_id2(contig: Column | str = "contig", start: Column | str = "start") -> Column:
    return F.concat_ws(":", _col(contig), _col(start).cast("string"))


def variant_id3(
    contig: Column | str = "contig", start: Column | str = "start", end: Column | str = "end"
) -> Column:
    return F.concat_ws(":", _col(contig), _col(start).cast("string"), _col(end).cast("string"))


def is_snp(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    return (F.length(_col(ref)) == 1) & (F.length(_col(alt)) == 1)


def not_double_other_alt(alleles: Column | str = "alleles") -> Column:
    """False (or NULL) when both alleles are ``OtherAlt``."""
    return (allele_at(alleles, 0) != OTHER_ALT) | (allele_at(alleles, 1) != OTHER_ALT)


def genotype_text(sample: Column | str, dose: Column | str) -> Column:
    """``id:dosage`` text form of one genotype."""
    return F.concat_ws(":", _col(sample), _col(dose).cast("string"))


def parse_genotype_text(texts: Column | str) -> Column:
    """``["id:dosage", ..]`` → dosages ordered by sample id."""
    pairs = F.transform(
        _col(texts),
        lambda t: F.struct(
            F.substring_index(t, ":", 1).alias("id"),
            F.substring_index(t, ":", -1).cast("int").alias("dosage"),
        ),
    )
    return F.transform(F.array_sort(pairs), lambda p: p["dosage"])
