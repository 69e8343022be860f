"""The registered queries against their SQL checks."""

import __spark_entry__ as entry_module
import oracle
import pytest

from locusflow.llm.queries import CHECKS, QUERIES


def test_registered():
    known = entry_module.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.differences(got, oracle.connect(sf_dir).execute(CHECKS[name]).df()) is None
