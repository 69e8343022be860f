"""Linkage-disequilibrium measures as columns over the 3x3 genotype counts of a SNP pair.

``c{x}{y}`` is the number of samples with dosage ``x`` at the first and ``y`` at the second SNP, both
known. The counts add up over sample chunks, so every measure can be computed after any split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = [f"c{x}{y}" for x in range(3) for y in range(3)]
METHODS = ("composite", "corr", "r", "dprime")

# Fixed values of the haplotype estimation: start offset and round limit.
EM_OFFSET = 0.01
EM_ROUNDS = 999
EPS = 2.0**-52

HAPLOTYPES = T.StructType([T.StructField(p, T.DoubleType()) for p in ("pAA", "pAB", "pBA", "pBB")])


def _c(x: int, y: int) -> Column:
    return F.col(f"c{x}{y}").cast("double")


def _total(*cells: Column) -> Column:
    out = cells[0]
    for cell in cells[1:]:
        out = out + cell
    return out


def pair_total() -> Column:
    return _total(*[_c(x, y) for x in range(3) for y in range(3)])


def first_count(x: int) -> Column:
    return _total(*[_c(x, y) for y in range(3)])


def second_count(y: int) -> Column:
    return _total(*[_c(x, y) for x in range(3)])


def pair_sums() -> dict[str, Column]:
    """n, sums, squares and cross product of the two dosages."""
    return {
        "n": pair_total(),
        "sx": first_count(1) + 2 * first_count(2),
        "sy": second_count(1) + 2 * second_count(2),
        "sxx": first_count(1) + 4 * first_count(2),
        "syy": second_count(1) + 4 * second_count(2),
        "sxy": _c(1, 1) + 2 * (_c(1, 2) + _c(2, 1)) + 4 * _c(2, 2),
    }


def _ratio(value: Column, radicand: Column, n: Column) -> Column:
    return F.when((n > 0) & (radicand > 0), value / F.sqrt(radicand)).otherwise(F.lit(float("nan")))


def composite() -> Column:
    """Composite LD: Burrows' delta over the two within-SNP variances."""
    n = pair_total()
    size = F.greatest(n, F.lit(1.0))
    gap_a = first_count(0) - first_count(2)
    gap_b = second_count(0) - second_count(2)
    delta = (_c(2, 2) + _c(0, 0) - _c(0, 2) - _c(2, 0)) / (2 * size) - gap_a * gap_b / (2 * size * size)

    def spread(two: Column, one: Column) -> Column:
        p = (2 * two + one) / (2 * size)
        return p * (1 - p) + (two / size - p * p)

    radicand = spread(first_count(2), first_count(1)) * spread(second_count(2), second_count(1))
    return _ratio(delta, radicand, n)


def corr() -> Column:
    """Pearson correlation of the dosages over complete pairs."""
    s = pair_sums()
    size = F.greatest(s["n"], F.lit(1.0))
    radicand = (s["sxx"] - s["sx"] * s["sx"] / size) * (s["syy"] - s["sy"] * s["sy"] / size)
    return _ratio(s["sxy"] - s["sx"] * s["sy"] / size, radicand, s["n"])


def haplotype_counts() -> dict[str, Column]:
    """Haplotypes that are certain from the genotypes; ``nDH2`` is twice the double heterozygotes."""
    return {
        "nAA": 2 * _c(2, 2) + _c(2, 1) + _c(1, 2),
        "nAB": 2 * _c(2, 0) + _c(2, 1) + _c(1, 0),
        "nBA": 2 * _c(0, 2) + _c(1, 2) + _c(0, 1),
        "nBB": 2 * _c(0, 0) + _c(0, 1) + _c(1, 0),
        "nDH2": 2 * _c(1, 1),
    }


def em_proportions(known: np.ndarray, double_het2: np.ndarray) -> np.ndarray:
    """Haplotype proportions of many pairs at once by expectation maximisation.

    ``known`` is (pairs, 4) in the order AA, AB, BA, BB. Pairs stop one by one when the change of the
    log-likelihood of the four known counts falls under the square root of the machine precision,
    relative to its first value.
    """
    total = known.sum(axis=1) + double_het2
    with np.errstate(divide="ignore", invalid="ignore"):
        p = known / total[:, None]
    todo = np.flatnonzero(double_het2 > 0)
    if todo.size == 0:
        return p
    n = known[todo]
    het = double_het2[todo] / 2.0
    q = (n + EM_OFFSET) / (n.sum(axis=1, keepdims=True) + 4 * EM_OFFSET)

    def likelihood(counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        return (counts * np.log(prob + EPS)).sum(axis=1)

    level = likelihood(n, q)
    tolerance = np.maximum(np.sqrt(EPS) * np.abs(level), EPS)
    live = np.arange(todo.size)
    for _ in range(EM_ROUNDS):
        cis = q[live, 0] * q[live, 3]
        trans = q[live, 1] * q[live, 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            to_cis = cis / (cis + trans) * het[live]
            to_trans = trans / (cis + trans) * het[live]
        share = np.stack([to_cis, to_trans, to_trans, to_cis], axis=1)
        q[live] = (n[live] + share) / total[todo][live, None]
        updated = likelihood(n[live], q[live])
        going = ~(np.abs(level[live] - updated) <= tolerance[live])
        level[live] = updated
        live = live[going]
        if live.size == 0:
            break
    p[todo] = q
    return p


@F.pandas_udf(HAPLOTYPES)
def haplotype_em(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for aa, ab, ba, bb, dh2 in batches:
        known = np.stack([s.to_numpy(dtype=float) for s in (aa, ab, ba, bb)], axis=1)
        yield pd.DataFrame(em_proportions(known, dh2.to_numpy(dtype=float)), columns=["pAA", "pAB", "pBA", "pBB"])


def _frequencies(h: Column) -> tuple[Column, Column, Column, Column, Column]:
    a, a_ = h["pAA"] + h["pAB"], h["pAA"] + h["pBA"]
    b, b_ = h["pBB"] + h["pBA"], h["pBB"] + h["pAB"]
    return a, a_, b, b_, h["pAA"] - a * a_


def r_from_haplotypes(h: Column) -> Column:
    a, a_, b, b_, d = _frequencies(h)
    return _quotient(d, F.sqrt(a * a_ * b * b_))


def dprime_from_haplotypes(h: Column) -> Column:
    a, a_, b, b_, d = _frequencies(h)
    bound = F.when(d >= 0, F.least(a * b_, b * a_)).otherwise(F.greatest(-a * a_, -b * b_))
    return _quotient(d, bound)


def _quotient(top: Column, bottom: Column) -> Column:
    """Floating-point division: NaN for 0/0 and for unknown proportions instead of an error or NULL."""
    return F.coalesce(F.when(bottom != 0, top / bottom), F.lit(float("nan")))


def is_conflict(ld: Column, threshold: float) -> Column:
    """True unless the absolute value is a number at or below the threshold."""
    return ~F.coalesce((F.abs(ld) <= threshold) & ~F.isnan(ld), F.lit(False))
