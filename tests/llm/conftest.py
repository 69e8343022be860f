import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@pytest.fixture
def frame(spark):
    """DataFrame of (doc_id, text) or (doc_id, text, lang) rows, with columns whose names the operators use too."""

    def make(rows):
        from pyspark.sql import functions as F

        full = [tuple(r) + (None,) * (3 - len(r)) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        return df.withColumns({n: F.lit(1) for n in ("score", "kept", "line", "piece", "uid", "term", "n", "vector", "spans")})

    return make


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text, r.lang) for r in small.select("doc_id", "text", "lang").collect()]
