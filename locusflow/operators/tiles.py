"""Blocked pair computation.

Pairs are never formed by joining rows with rows. Rows are cut into tiles of bounded size, every tile
is sent to the tile pairs it takes part in, and one task multiplies two tiles with NumPy. A task
therefore holds two tiles, whatever the number of rows, and the shuffle moves each row once per
neighbouring tile instead of once per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles of a row inside a tile pair.
LATER, EARLIER, BOTH = 0, 1, 2


def tile_size(rows: int, row_length: int, cells: int = 1 << 23, most: int = 1024, parts: int = 8) -> int:
    """Rows per tile: at most ``cells`` values per tile, and several tiles even for small inputs."""
    by_memory = max(8, cells // max(row_length, 1))
    by_spread = max(8, -(-rows // parts))
    return int(min(most, by_memory, by_spread))


def role(own: Column, t: Column, u: Column) -> Column:
    return F.when(t == u, BOTH).when(own == t, LATER).otherwise(EARLIER)


def all_tile_pairs(rows: DataFrame, tiles: int) -> DataFrame:
    """Send every row to the ``tiles`` pairs its tile belongs to (columns ``t >= u`` and ``role``)."""
    other = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    t, u = F.greatest("tile", "_o"), F.least("tile", "_o")
    return other.withColumn("role", role(F.col("tile"), t, u)).withColumn("t", t).withColumn("u", u).drop("_o")


def windowed_tile_pairs(tiles: DataFrame, max_bp: int | None, max_n: int | None) -> DataFrame:
    """Tile pairs (contig, t, u), ``u <= t``, that can hold a pair inside the window.

    ``tiles`` has one row per tile: contig, tile, first/last position and number. With a position
    limit, tiles meet in position buckets of the window width (an equi-join), whatever the order of
    their positions; without one, the earlier tiles of the number window are listed directly.
    """
    if max_bp is None:
        ahead = F.col("tile")
        if max_n is not None:
            widest = F.greatest(F.lit(1), F.col("last_n") - F.col("first_n") + 1)
            ahead = F.least(ahead, (F.lit(max_n) / widest).cast("int") + 1)
        pairs = tiles.select(
            "contig", F.col("tile").alias("t"), F.explode(F.sequence(F.col("tile") - ahead, F.col("tile"))).alias("u")
        )
        return pairs
    width = max_bp + 1
    bucket = [F.floor(F.col(c) / width).cast("long") for c in ("first_pos", "last_pos")]
    later = tiles.select(
        "contig", F.col("tile").alias("t"), F.col("first_pos").alias("t_first"), F.col("last_pos").alias("t_last"),
        F.col("first_n").alias("t_n"), F.explode(F.sequence(bucket[0] - 1, bucket[1] + 1)).alias("_b"),
    )
    earlier = tiles.select(
        "contig", F.col("tile").alias("u"), F.col("first_pos").alias("u_first"), F.col("last_pos").alias("u_last"),
        F.col("last_n").alias("u_n"),
        F.explode(F.sequence(bucket[0], bucket[1])).alias("_b"),
    )
    met = later.join(earlier, ["contig", "_b"]).filter(F.col("u") <= F.col("t"))
    met = met.filter((F.col("t_first") - F.col("u_last") <= max_bp) & (F.col("u_first") - F.col("t_last") <= max_bp))
    if max_n is not None:
        met = met.filter(F.col("t_n") - F.col("u_n") <= max_n)
    return met.select("contig", "t", "u").distinct()


def scatter(positions: pa.Array, values: pa.Array, width: int, fill: float, dtype: type) -> np.ndarray:
    """List columns (positions, values) → dense rows of the given width."""
    lengths = np.diff(positions.offsets.to_numpy())
    rows = np.repeat(np.arange(len(positions)), lengths)
    dense = np.full((len(positions), width), fill, dtype=dtype)
    dense[rows, positions.flatten().to_numpy()] = values.flatten().to_numpy()
    return dense


def split_roles(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the later and of the earlier tile."""
    roles = table["role"].to_numpy()
    return np.flatnonzero(roles != EARLIER), np.flatnonzero(roles != LATER)


def list_column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
