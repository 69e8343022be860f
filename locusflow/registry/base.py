"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import with_views
from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# SQL forms of the call codings.
DOSE = "(CASE WHEN a0 = 'Alt' AND a1 = 'Alt' THEN 2 WHEN a0 = 'Alt' OR a1 = 'Alt' THEN 1 ELSE 0 END)"
NONREF = "((CASE WHEN a0 <> 'Ref' THEN 1 ELSE 0 END) + (CASE WHEN a1 <> 'Ref' THEN 1 ELSE 0 END))"
ID2 = "contig || ':' || CAST(start AS VARCHAR)"
ID3 = "contig || ':' || CAST(start AS VARCHAR) || ':' || CAST(\"end\" AS VARCHAR)"


def query(name: str, *views: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``views`` are the fixture views its SQL text starts from."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_views(sql, *views, recursive=recursive) if views else sql.strip()
        return function

    return register


def r6(column: str | Column, digits: int = 6) -> Column:
    """Rounded value; NaN becomes NULL and negative zero becomes zero.

    ``round`` goes through decimal texts; values that are neither large nor next to a tie have the same nearest number without.
    """
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    scaled = c * F.lit(10.0**digits)
    near = F.rint(scaled)
    plain = (F.abs(scaled) < 1e11) & (F.abs(scaled - near) < 0.499)
    return F.when(~F.isnan(c), F.when(plain, near / F.lit(10.0**digits)).otherwise(F.round(c, digits)) + F.lit(0.0))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def alleles_out(df: DataFrame) -> DataFrame:
    """Allele array as the two text columns the SQL views have."""
    return df.withColumns({"a0": F.get("alleles", F.lit(0)), "a1": F.get("alleles", F.lit(1))}).drop("alleles")
