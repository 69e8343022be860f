"""Orthogonal factors of tall matrices by a tree, and products with them.

Every task folds its rows into one triangular factor, and a tree of groups folds those until one is left. The factor is as
wide as the matrix is, has all of its singular values and right singular vectors, and lives in one task, never on
the driver. So the bound of all that follows is a square of the matrix's smaller side in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Factors folded into one by a task of the tree.
FAN_IN = 8

#: Rows of a factor relative to its width that are multiplied in one group.
GROUP_WIDTHS = 4


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """List column of equal lengths → dense rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists_of(values: np.ndarray) -> pa.Array:
    """Dense rows → list column."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def triangle(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of a stack of rows; fewer rows than columns are their own factor."""
    return rows if len(rows) <= rows.shape[1] else np.linalg.qr(rows, mode="r")


def tall_factor(rows: DataFrame, column: str, width: int, shape: Callable[[np.ndarray], np.ndarray] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(g, x): the rows of one triangular factor of the matrix whose rows are the arrays in ``column``.

    ``shape`` is applied to every batch of rows before, and may change their width.
    """
    ship_package(rows.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), width)
                x = x if shape is None else shape(x)
                held = triangle(x if held is None else np.vstack([held, x]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([lists_of(held)], names=["x"])

    parts = rows.select(column).mapInArrow(fold, "x array<double>").withColumn("g", F.spark_partition_id())
    parts = cut_lineage(parts)
    groups = parts.agg(F.max("g")).first()[0]
    groups = 0 if groups is None else groups + 1
    while groups > 1:
        groups = -(-groups // fan_in)
        parts = parts.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("g").applyInArrow(_fold_group, "g int, x array<double>")
    return cut_lineage(parts.withColumn("g", F.lit(0)))


def _fold_group(key: tuple, table: pa.Table) -> pa.Table:
    x = table["x"].combine_chunks()
    held = triangle(matrix_of(x, len(x[0])))
    return pa.table({"g": pa.array(np.full(len(held), key[0].as_py(), dtype=np.int32)), "x": lists_of(held)})


def of_factor(factor: DataFrame, solve: Callable[[np.ndarray], np.ndarray], name: str = "x") -> DataFrame:
    """(r, ``name``): the rows of ``solve`` of the whole factor, run in the task that holds it."""

    def run(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks()
        out = solve(matrix_of(x, len(x[0])))
        return pa.table({"r": pa.array(np.arange(len(out), dtype=np.int32)), name: lists_of(out)})

    return factor.select("g", "x").groupBy("g").applyInArrow(run, f"r int, {name} array<double>")


def singular_values(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """All singular values, falling; as many as the smaller side has."""
    found = of_factor(tall_factor(rows, column, width), lambda r: np.linalg.svd(r, compute_uv=False)[None, :]).collect()
    return np.array(found[0]["x"]) if found else np.zeros(0)


def times_factor(rows: DataFrame, keys: Sequence[str], column: str, loadings: DataFrame, width: int, out: str, shape: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(``keys``, ``out``): rows of a matrix times loadings ``(r, x)``, one row of them for each column.

    Rows meet the loadings in groups of a few times ``width`` rows, so that copies of the loadings stay smaller than
    the rows themselves and nothing is broadcast.
    """
    ship_package(rows.sparkSession)
    size = max(GROUP_WIDTHS * width, 256)
    numbered = rows.select(*keys, F.col(column).alias("_x"))
    total = numbered.count()
    groups = max(1, -(-total // size))
    numbered = numbered.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))
    copies = loadings.select("r", "x").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {out} array<double>"

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{k: left[k].slice(0, 0) for k in keys}, out: pa.array([], type=pa.list_(pa.float64()))})
        x = matrix_of(left["_x"], width)
        x = x if shape is None else shape(x)
        order = np.argsort(right["r"].to_numpy())
        by = right["x"].combine_chunks()
        return pa.table({**{k: left[k] for k in keys}, out: lists_of(x @ matrix_of(by, len(by[0]))[order])})

    return numbered.groupBy("_g").cogroup(copies.groupBy("_g")).applyInArrow(multiply, schema)


def with_signs(scores: DataFrame, column: str) -> DataFrame:
    """Every component with its largest score positive, whichever way it was found."""
    top = scores.select(F.posexplode(column).alias("c", "v")).groupBy("c").agg(F.max_by("v", F.struct(F.round(F.abs("v"), 9), "v")).alias("v")).collect()
    signs = [1.0] * len(top)
    for row in top:  # one row for each component
        signs[row["c"]] = -1.0 if row["v"] < 0 else 1.0
    if all(s > 0 for s in signs):
        return scores
    factors = F.array(*[F.lit(s) for s in signs])
    return scores.withColumn(column, F.zip_with(column, factors, lambda v, s: v * s))
