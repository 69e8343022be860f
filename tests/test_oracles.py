"""Every registered query runs; those with a SQL check give the same rows."""

import __spark_entry__ as entry_module
import oracle
import pytest

QUERIES = entry_module.queries()
CHECKS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in CHECKS:
        assert oracle.differences(got, con.execute(CHECKS[name]).df()) is None
    else:
        assert len(got.columns) > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["snpIdx", "contig", "start", "ref", "alt", "nonmissing", "frequency", "genotype"]
    assert df.count() > 0
