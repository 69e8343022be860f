"""Long ↔ wide, vectors ↔ columns, label coding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_vector_text
from ..session import cut_lineage

#: Widest table that is still built as columns; wider data stays in long or chunked form.
MAX_COLUMNS = 10_000
#: Longest feature vector held in one row.
MAX_FEATURES = 65_535
ROW_CHUNK = 1 << 16


def distinct_values(long: DataFrame, column: str, limit: int) -> list:
    """Sorted distinct values, refused beyond ``limit`` so that the driver list stays bounded."""
    rows = long.select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values of {column}: keep the long or chunked form")
    return sorted(r[0] for r in rows)


def pivot_wide(
    long: DataFrame,
    variants: Sequence | None = None,
    row: str | Sequence[str] = "sampleId",
    variant_col: str = "variantId",
    value_col: str = "altCount",
    fill: float | None = 0.0,
) -> DataFrame:
    """One row per sample, one double column per variant, filled by key."""
    keys = [row] if isinstance(row, str) else list(row)
    if variants is None:
        variants = distinct_values(long, variant_col, MAX_COLUMNS)
    elif len(variants) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns: use sample_vectors")
    wide = long.groupBy(*keys).pivot(variant_col, list(variants)).agg(F.sum(value_col).cast("double"))
    if fill is None:
        return wide
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(fill)).alias(str(v)) for v in variants])


def transpose(
    rows: DataFrame, row_col: str = "rowIdx", values_col: str = "values", chunk: int = ROW_CHUNK
) -> DataFrame:
    """Columns of a row matrix, each cut into chunks of at most ``chunk`` rows."""
    cells = rows.select(F.col(row_col).alias("_r"), F.posexplode(values_col).alias("colIdx", "_v"))
    return (
        cells.withColumn("chunk", F.floor(F.col("_r") / chunk).cast("int"))
        .groupBy("colIdx", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "_v"))).alias("_cells"))
        .select("colIdx", "chunk", F.transform("_cells", lambda c: c["_v"]).alias("values"))
    )


def feature_arrays(
    long: DataFrame,
    keys: Sequence[str],
    index_col: str = "idx",
    value_col: str = "w",
    out: str = "features",
    limit: int = MAX_FEATURES,
) -> DataFrame:
    """Per sample the feature values in index order as an array (at most ``limit`` of them)."""
    entry = F.struct(F.col(index_col).alias("i"), F.col(value_col).cast("double").alias("v"))
    gathered = long.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_f"))
    values = F.when(
        F.size("_f") > limit, F.raise_error(F.lit(f"more than {limit} features")).cast("array<double>")
    ).otherwise(F.transform("_f", lambda f: f["v"]))
    return gathered.select(*keys, values.alias(out))


def feature_vectors(long: DataFrame, keys: Sequence[str], index_col: str = "idx", value_col: str = "w", out: str = "features") -> DataFrame:
    """The same as an ML vector column."""
    return feature_arrays(long, keys, index_col, value_col, out).withColumn(out, array_to_vector(out))


def assemble_features(wide: DataFrame, columns: Sequence[str] | None = None, out: str = "features") -> DataFrame:
    """Columns → ML vector."""
    from .calls import feature_columns

    cols = list(columns) if columns is not None else feature_columns(wide)
    return VectorAssembler(inputCols=cols, outputCol=out).transform(wide)


def compact(features: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    """Feature table for repeated model fits: stored once, in as many partitions as its rows need."""
    stored = cut_lineage(features)
    return stored.coalesce(max(1, -(-stored.count() // rows_per_partition))).persist()


def pc_columns(df: DataFrame, keys: Sequence[str], k: int, column: str = "pcaFeatures", vector: bool = True) -> DataFrame:
    """Vector (or array) → ``PC1..PCk``."""
    values = vector_to_array(F.col(column)) if vector else F.col(column)
    return df.select(*keys, values.alias("_v")).select(
        *keys, *[F.get("_v", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)]
    )


def vector_text_to_columns(df: DataFrame, k: int, column: str = "features") -> DataFrame:
    """``"[a,b,..]"`` → ``PC1..PCk`` next to the other columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, parse_vector_text(column).alias("_v")).select(
        *rest, *[F.get("_v", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)]
    )


def label_index(df: DataFrame, column: str = "Region") -> DataFrame:
    """Label table: most frequent first, ties by name."""
    from pyspark.sql import Window as W

    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("n").desc(), F.col(column))  # one row per class
    return counts.select(column, (F.row_number().over(order) - 1).cast("double").alias("label"))


def index_labels(df: DataFrame, column: str = "Region", out: str = "label") -> tuple[DataFrame, StringIndexerModel]:
    model = StringIndexer(inputCol=column, outputCol=out, stringOrderType="frequencyDesc").fit(df)
    return model.transform(df), model


def labels_back(df: DataFrame, model: StringIndexerModel, column: str = "prediction", out: str = "predictedLabel") -> DataFrame:
    return IndexToString(inputCol=column, outputCol=out, labels=model.labels).transform(df)
