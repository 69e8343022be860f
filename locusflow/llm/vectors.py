"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors whose cosine is at least c lie within squared distance 2 - 2c. After a rotation that spreads their
variance they are split into blocks of a few dimensions; in at least one block a linked pair lies within the block's
proportional share of the squared distance. Every block is range-joined on its own: the signs of the leading
coordinates around their means are a vector's home cell, and a vector visits each other cell that its share lets it
reach. Within a tile of home and visiting vectors the block distance selects candidates, and candidates are verified
by cosine in double precision. A pair counts in its first block within budget only, so nothing has to be collected
to remove repeats; tiles return counts per vector and a spanning forest, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .components import components

#: Dimensions of a block, largest number of split coordinates, and vectors a cell should hold.
BLOCK, MOST_SPLITS, CELL = 16, 8, 4096

#: Home and visiting vectors of one tile.
HOME, VISITORS = 2048, 8192

#: Candidates verified at once, and what rounding may add to a squared distance in
#: double and in single precision.
_CHUNK, _ROUNDING, _SINGLE = 1 << 16, 1e-9, 1e-5


def rotation(dims: int, seed: int = 20) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def visited(offsets: np.ndarray, budget: float) -> list[tuple[int, np.ndarray]]:
    """Cells within reach: (bits flipped against home, rows that get there), for distances to the split planes."""
    squares = offsets**2
    out = []
    for n in range(offsets.shape[1] + 1):
        some = False
        for flipped in combinations(range(offsets.shape[1]), n):
            near = np.flatnonzero(squares[:, flipped].sum(axis=1) <= budget + _ROUNDING)
            if len(near):
                some = True
                out.append((sum(1 << b for b in flipped), near))
        if not some:
            break
    return out


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows divided by their largest magnitude, so that squares neither overflow nor vanish."""
    raw = raw.astype(np.float64)
    return raw / np.abs(raw).max(axis=1, keepdims=True)


def _rows(batch: pd.DataFrame, kind: str) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(batch["vector"]), dtype=kind).reshape(len(batch), -1))


def _reach(turned: np.ndarray, means: np.ndarray, splits: int, cosine: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, bits flipped, rows, cells) of all cells that the vectors live in or visit; of two cells only the lower."""
    dims = turned.shape[1]
    for b, part in enumerate(blocks(dims)):
        width = part.stop - part.start
        centred = (turned[:, part] - means[part])[:, : min(splits, width)]
        home = ((centred > 0) << np.arange(centred.shape[1])).sum(axis=1)
        for flipped, near in visited(centred, (2 - 2 * cosine) * width / dims):
            cells = home[near] ^ flipped
            lower = cells <= home[near]
            if lower.any():
                yield b, flipped, near[lower], cells[lower]


def _sizes(kind: str, means: np.ndarray, splits: int, cosine: float):
    """Home and visiting vectors of every cell, counted per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                turned = unit(_rows(batch, kind)) @ rotation(len(means))
                found = [(b, c, flipped == 0) for b, flipped, _, cells in _reach(turned, means, splits, cosine) for c in cells.tolist()]
                frame = pd.DataFrame(found, columns=["block", "cell", "homes"])
                yield frame.groupby(["block", "cell"])["homes"].agg(homes="sum", visitors="count").reset_index()

    return run


HOME_COPY, RESIDENT, VISITOR = 0, 1, 2


def _deal(kind: str, means: np.ndarray, splits: int, cosine: float, tiles: Broadcast):
    """Copies of every vector: one side of its home cell's tiles, the other side there and in the cells it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = tiles.value  # (block, cell) -> (home tiles, visitor tiles), where there is more than one
        for batch in batches:
            if not len(batch):
                continue
            turned = unit(_rows(batch, kind)) @ rotation(len(means))
            salt = batch["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            out = []
            for b, flipped, near, cells in _reach(turned, means, splits, cosine):
                homes, visits = np.array([shape.get((b, c), (1, 1)) for c in cells.tolist()], dtype=np.int64).T
                for role in (VISITOR,) if flipped else (HOME_COPY, RESIDENT):
                    mine, other = (homes, visits) if role == HOME_COPY else (visits, homes)
                    own = (salt[near] % mine.astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(near)), other)
                    across = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                    pair = (own[again], across) if role == HOME_COPY else (across, own[again])
                    out.append(np.stack([near[again], np.full(len(again), b), cells[again], *pair, np.full(len(again), role)]))
            at = np.concatenate(out, axis=1)
            frame = batch.iloc[at[0]].reset_index(drop=True)
            for name, values in zip(("block", "cell", "tile_home", "tile_visit", "role"), at[1:]):
                frame[name] = values
            yield frame

    return run


def _tile(kind: str, dims: int, cosine: float):
    """Per vector of one tile the weight of its partners there, and the smallest vector of its connected part."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        frame = frame.sort_values("id", kind="stable", ignore_index=True)
        ids, weights, role = (frame[c].to_numpy() for c in ("id", "weight", "role"))
        raw = _rows(frame, kind)
        norms = np.sqrt((raw * raw).sum(axis=1))
        turn, parts = rotation(dims), blocks(dims)
        budgets = [(2 - 2 * cosine) * (p.stop - p.start) / dims + _ROUNDING for p in parts]
        homes, visitors = np.flatnonzero(role == HOME_COPY), np.flatnonzero(role != HOME_COPY)
        links, label = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
        found: list[np.ndarray] = []
        x = (raw / norms[:, None]) @ turn[:, parts[b]]
        squares, one = (x * x).sum(axis=1)[:, None], np.ones((len(frame), 1))
        # Squared distances as one product, in single precision; exact tests follow.
        from_home = np.hstack([x, squares, one]).astype(np.float32)
        to_visitor = np.hstack([-2 * x, one, squares]).astype(np.float32)[visitors].T
        step = max(1, (1 << 21) // max(1, len(visitors)))
        for at in range(0, len(homes), step):
            some = homes[at : at + step]
            left, right = np.nonzero(from_home[some] @ to_visitor <= budgets[b] + _SINGLE)
            for k in range(0, len(left), _CHUNK):
                i, j = some[left[k : k + _CHUNK]], visitors[right[k : k + _CHUNK]]
                once = (role[j] == VISITOR) | (ids[i] < ids[j])
                i, j = i[once], j[once]
                ok = (raw[i] * raw[j]).sum(axis=1) / (norms[i] * norms[j]) >= cosine
                i, j = i[ok], j[ok]
                first = np.ones(len(i), dtype=bool)
                apart = raw[i] / norms[i][:, None] - raw[j] / norms[j][:, None]
                for c in range(b + 1):
                    within = ((apart @ turn[:, parts[c]]) ** 2).sum(axis=1) <= budgets[c]
                    first &= within if c == b else ~within
                i, j = i[first], j[first]
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                found.append(np.stack([i, j]))
                if sum(f.shape[1] for f in found) > 1 << 20:
                    found = [_forest(label, np.concatenate(found, axis=1))]
        if found:
            _forest(label, np.concatenate(found, axis=1))
        linked = links > 0
        return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": ids[label[linked]]})

    return run


def _forest(label: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Lower every label to the smallest row of its connected part; edges that keep the same parts together."""
    i, j = edges
    while True:
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            touched = np.unique(edges)
            return np.stack([touched, label[touched]])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)


def _links(classes: DataFrame, kind: str, dims: int, cosine: float) -> DataFrame:
    """(id, links, root) over all tiles, for class representatives of one dimension: (id, weight, vector)."""
    spark = classes.sparkSession
    count = classes.count()
    splits = int(np.clip(np.log2(max(count, 1) / CELL), 1, MOST_SPLITS))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                turned = unit(_rows(batch, kind)) @ rotation(dims)
                yield pd.DataFrame({"at": np.arange(dims), "total": turned.sum(axis=0), "n": len(turned)})

    found = classes.select("vector").mapInPandas(sums, "at int, total double, n long").groupBy("at").agg(F.sum("total") / F.sum("n")).collect()
    means = np.zeros(dims)
    for at, mean in found:
        means[at] = mean
    sizes = classes.select("vector").mapInPandas(_sizes(kind, means, splits, cosine), "block int, cell int, homes long, visitors long")
    shapes = {
        (r.block, r.cell): (max(1, -(-r.homes // HOME)), max(1, -(-r.visitors // VISITORS)))
        for r in sizes.groupBy("block", "cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors")).collect()
    }
    tiles = spark.sparkContext.broadcast({k: v for k, v in shapes.items() if v != (1, 1)})
    copies = classes.mapInPandas(
        _deal(kind, means, splits, cosine, tiles),
        "id long, weight long, vector binary, block int, cell int, tile_home int, tile_visit int, role int",
    )
    return copies.groupBy("block", "cell", "tile_home", "tile_visit").applyInPandas(_tile(kind, dims, cosine), "id long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    length. Equal vectors form a class that takes part once, with its size as weight; all members of a class link with
    each other. A row with a null id has no component and is not kept, and is no other vector's link. Rows that repeat
    id and vector count as two vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind, element = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    usable = (
        F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("hash", F.xxhash64("vector"))
    grouped = rows.where("usable").groupBy("hash", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    grouped = stored(grouped, "vectors")

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: np.asarray(x, dtype=kind).tobytes())

    found = None
    for (dims,) in grouped.select(F.size("vector")).distinct().collect():
        part = stored(grouped.where(F.size("vector") == dims).select("id", "weight", packed("vector").alias("vector")), "vectors")
        some = _links(part, kind, dims, cosine)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    found = stored(found, "vectors")
    parts = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = (
        grouped.join(links, "id", "left").join(parts.toDF("id", "component"), "id", "left")
        .select("hash", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    single = F.when(~F.col("usable"), F.lit(0).cast("long"))
    return (
        rows.join(result, ["hash", "vector"], "left")
        .select(
            "vec_id", F.coalesce(single, "n_links").alias("n_links"),
            F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
