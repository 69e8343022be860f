"""Plans of the lazy queries: no cross join, no row-at-a-time Python, pruned scans."""

import contextlib
import io

import __spark_entry__ as entry_module
import pytest
from locusflow import fixtures as X
from locusflow.operators import calls as P
from locusflow.operators import catalog as A
from locusflow.session import scratch_path
from locusflow.sources import readers as RD
from locusflow.sources import writers as W

QUERIES = entry_module.queries()
LAZY = [
    "dosage", "sample_variants", "biallelic_strict", "prune_variants", "calls_join_catalog", "attach_region", "variant_semi_join",
    "window_pair_join", "freq_dosage", "freq_carrier", "genotype_list", "sample_variant_dosage", "sample_vectors", "snp_index",
    "population_matrix_job", "subsample_column_stats", "find_outliers", "chi_square", "normalized_genotypes", "kappa",
    "external_indices", "calinski_harabasz", "confusion_matrix_complete", "half_subsamples", "row_stats_by_samples",
]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text


def test_nested_source_is_pruned(spark, sf_dir):
    path = W.write_parquet(X.gts_nested(spark, sf_dir), scratch_path(spark, "genotypes"))
    calls = P.flatten_calls(RD.read_genotypes(spark, path, None))
    text = plan(A.freq_alt_total(P.locus_range(calls, 5, 10)))
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "sampleId" not in schema
    assert "GreaterThanOrEqual(variant.start,5)" in text


def test_one_shuffle_for_counts(spark, sf_dir):
    text = plan(QUERIES["allele_number_and_alt_count"](spark, sf_dir))
    assert "SortMergeJoin" not in text
