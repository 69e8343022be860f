"""Sample distances, double centring and the cluster indices built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_rows, broadcast_if_small, cut_lineage, one_value
from . import krylov as KR
from . import tiles as TL
from .catalog import row_index, sample_index

METRICS = ("minkowski", "euclidean", "manhattan", "hamming")
#: Features per chunk of a sample row; partial sums of several chunks are added up.
FEATURE_CHUNK = 1 << 14
#: Tiles of samples, unless one would pass so many cells (32 MB); most partitions of their pairs.
TILES, TILE_CELLS, MOST_PARTS = 16, 1 << 22, 2048
#: Most samples in a tile whose products with vectors are formed, cells of vectors that may be broadcast (64 MB).
MOST_EDGE, VECTOR_CELLS = 8192, 1 << 23
#: Tiles of sample ids whose pairs are formed, unless one would pass so many ids (a few MB); pairs of a run and of a partition.
PAIR_TILES, PAIR_IDS, RUN_PAIRS, PART_PAIRS = 64, 1 << 17, 1 << 12, 1 << 20


def sample_rows(
    long: DataFrame, key: str = "sampleId", feature: str = "idx", value: str = "dosage",
    label: str | None = None, chunk: int = FEATURE_CHUNK,
) -> DataFrame:
    """Per sample (and feature chunk) the features as a sparse row; absent features count as zero.

    Of repeated cells the largest value counts, whatever the order of the rows.
    """
    extra = [] if label is None else [F.col(label).cast("string").alias("label")]
    cells = long.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("id"), *extra, F.floor(F.col(feature) / chunk).cast("int").alias("chunk"),
        F.struct((F.col(feature) % chunk).cast("int").alias("f"), F.col(value).cast("double").alias("v")).alias("e"),
    )
    keys = ["id", "chunk"] if label is None else ["id", "label", "chunk"]
    gathered = cells.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return gathered.select(*keys, F.col("e.f").alias("f"), F.col("e.v").alias("v"))


#: Pairs whose power sums a task holds at once, most distinct values of a table of value pairs, largest value of the fast forms.
STRIP_PAIRS, FEW_VALUES, LARGEST = 1 << 18, 8, 1e100
#: Share of two squared lengths below which a squared distance taken from their product is computed anew.
CANCELLED = 1e-4

PowerSums = Callable[[int, int, int], np.ndarray]


def _power_sums(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for r, row in enumerate(a):
        gap = b - row
        if metric == "hamming":
            out[r] = (gap != 0).sum(axis=1)
        elif p == 1:
            out[r] = np.abs(gap).sum(axis=1)
        elif p == 2:
            out[r] = np.einsum("ij,ij->i", gap, gap)
        else:
            out[r] = (np.abs(gap) ** p).sum(axis=1)
    return out


def _power_sums_of(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> PowerSums:
    """Function of (first, last, columns): :func:`_power_sums` of rows first..last-1 of ``a`` and the first rows of ``b``.

    Squared distances come from products of the rows, few distinct values (genotypes) from products of their indicators with
    a table of value pairs, and all else feature by feature; values that are not finite, or huge, row by row.
    """
    plain = lambda first, last, m: _power_sums(a[first:last], b[:m], metric, p)
    if not a.size or not b.size or not (np.abs(a).max() < LARGEST and np.abs(b).max() < LARGEST):
        return plain
    if p == 2 and metric != "hamming":
        return _squares_by_products(a, b)
    values = np.unique(a[:64])
    if len(values) <= FEW_VALUES:
        values = np.unique(np.concatenate([values, np.unique(a), np.unique(b)]))
    gap = np.abs(values[:, None] - values)
    table = (gap != 0).astype(np.float64) if metric == "hamming" else gap**p
    if len(values) <= FEW_VALUES and np.isfinite(table).all():
        whole = (table == np.rint(table)).all() and table.max() * a.shape[1] < 1 << 24  # float32 counts exactly up to here
        kind = np.float32 if whole else np.float64
        right = table.astype(kind)[:, np.searchsorted(values, b)].transpose(1, 2, 0).reshape(len(b), -1)
        return lambda first, last, m: ((a[first:last, :, None] == values).reshape(last - first, -1).astype(kind) @ right[:m].T).astype(np.float64)
    if len(b) < a.shape[1]:
        return plain
    across = np.ascontiguousarray(b.T)

    def by_feature(first: int, last: int, m: int) -> np.ndarray:
        out = np.zeros((last - first, m))
        for at in range(first, last, 8):
            rows, total = a[at : min(at + 8, last)], out[at - first : at - first + 8]
            gap = np.empty_like(total)
            for f in range(a.shape[1]):
                np.subtract(across[f, :m], rows[:, f : f + 1], out=gap)
                if metric == "hamming":
                    total += gap != 0
                    continue
                np.abs(gap, out=gap)
                total += gap if p == 1 else gap**p
        return out

    return by_feature


def _squares_by_products(a: np.ndarray, b: np.ndarray) -> PowerSums:
    """Squared distances as ``x'x + y'y - 2 x'y``, exact for whole numbers; differences that cancel are taken from the rows."""
    whole = (a == np.rint(a)).all() and (b == np.rint(b)).all()
    x, y = (a, b) if whole else (a - a.mean(axis=0), b - a.mean(axis=0))
    own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    exact = whole and own.max() + other.max() < 1 << 50  # no sum of whole numbers is rounded

    def squares(first: int, last: int, m: int) -> np.ndarray:
        both = own[first:last, None] + other[:m]
        out = x[first:last] @ y[:m].T
        out *= -2.0
        out += both
        if exact:
            return out
        r, c = np.nonzero(out < CANCELLED * both)
        for at in range(0, len(r), 1 << 14):
            some = slice(at, at + (1 << 14))
            gap = a[first + r[some]] - b[c[some]]
            out[r[some], c[some]] = np.einsum("ij,ij->i", gap, gap)
        return out

    return squares


class _TilePair:
    """Rows of two tiles in the order of their numbers, and power sums of their pairs strip by strip."""

    def __init__(self, table: pa.Table, metric: str, p: float) -> None:
        self.table = table = table.take(np.argsort(table["sidx"].to_numpy(), kind="stable"))
        later, earlier = TL.split_roles(table)
        f = TL.list_column(table, "f")
        dense = TL.scatter(f, TL.list_column(table, "v"), int(f.flatten().to_numpy().max(initial=-1)) + 1, 0.0, np.float64)
        self.later, self.earlier, number = later, earlier, table["sidx"].to_numpy()
        self.numbers = number[later], number[earlier]
        self.sums = _power_sums_of(dense[later], dense[earlier], metric, p)

    def strips(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(first, last, sums, inside): rows first..last-1 of the later tile by the leading rows of the earlier one.

        ``inside`` tells the pairs of a larger with a smaller number; without it, all are.
        """
        own, other = self.numbers
        rows = max(1, STRIP_PAIRS // max(len(other), 1))
        for first in range(0, len(own), rows):
            last = min(first + rows, len(own))
            m = int(np.searchsorted(other, own[last - 1]))  # numbers rise, so no later one is inside
            if m:
                inside = None if other[m - 1] < own[first] else own[first:last, None] > other[:m]
                yield first, last, self.sums(first, last, m), inside


def _sums_of_tiles(metric: str, p: float, labelled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per strip: the ids of both sides once, and the sums of their pairs, null where a pair is not one of the strip."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        pair = _TilePair(table, metric, p)
        names = ["id", "label"] if labelled else ["id"]
        columns = [pair.table[c].combine_chunks() for c in names]
        for first, last, power, inside in pair.strips():
            sides = pa.array(pair.later[first:last]), pa.array(pair.earlier[: power.shape[1]])
            lists = [c.take(side) for c in columns for side in sides]
            lists.append(pa.array(power.ravel(), mask=None if inside is None else ~inside.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=[c for c, _ in _STRIP[: len(lists) - 1]] + ["total"]
            )

    return sums


#: Lists of a strip: ids of the rows and columns, and their labels.
_STRIP = (("own", "string"), ("other", "string"), ("own_labels", "string"), ("other_labels", "string"))


def _pairs_of_strips(strips: DataFrame, labelled: bool) -> DataFrame:
    """(i, j, total, li, lj) from :func:`_sums_of_tiles`, ``i < j`` as numbers follow the ids, formed by built-in generators."""
    labels = ["own_labels", "other_labels"] if labelled else []
    rows = strips.select("other", "total", *labels, F.posexplode("own").alias("o", "x"))
    cells = rows.select("x", "o", "total", *labels, F.size("other").alias("m"), F.posexplode("other").alias("p", "y"))
    out = [F.col("y").alias("i"), F.col("x").alias("j"), F.get("total", F.col("o") * F.col("m") + F.col("p")).alias("total")]
    if labelled:
        out += [F.get("other_labels", F.col("p")).alias("li"), F.get("own_labels", F.col("o")).alias("lj")]
    return cells.select(*out).where(F.col("total").isNotNull())


def _exponent(metric: str, p: float) -> float:
    if metric not in METRICS:
        raise ValueError(f"unknown distance {metric!r}; one of {METRICS}")
    return {"euclidean": 2.0, "manhattan": 1.0, "hamming": 1.0}.get(metric, float(p))


def _numbered_rows(rows: DataFrame, tile: int | None, ordered: bool = False) -> tuple[DataFrame, int, int, int]:
    """Rows of :func:`sample_rows` with ``sidx`` and ``tile``, the tile size, and the numbers of samples and of the last chunk.

    ``ordered`` numbers follow the ids. Rows without an id are in no pair and take no number.
    """
    labelled = "label" in rows.columns
    rows = cut_lineage(rows)
    named = rows.select("id").where(F.col("id").isNotNull())
    numbers = row_index(named.distinct(), "id", out="sidx").withColumn("sidx", F.col("sidx").cast("int")) if ordered else sample_index(named, "id")
    numbers = cut_lineage(numbers)
    size = rows.agg(F.count_distinct("id").alias("n"), (F.max(F.array_max("f")) + 1).alias("width"), F.max("chunk").alias("chunks")).first()
    # A number of tiles that does not grow with the samples sends each of them a fixed number of times.
    tile = tile or TL.tile_size(size["n"], size["width"] or 1, cells=TILE_CELLS, most=TILE_CELLS, parts=TILES)
    if size["chunks"]:  # a sample without features in some chunk still counts there, as zeros
        every = numbers.select("id", F.explode(F.sequence(F.lit(0), F.lit(size["chunks"]))).alias("chunk"))
        if labelled:
            every = every.join(rows.select("id", "label").distinct(), "id")
        own = rows.select("id", "chunk", "f", "v")
        rows = every.join(own, ["id", "chunk"], "left").withColumns(
            {"f": F.coalesce("f", F.array().cast("array<int>")), "v": F.coalesce("v", F.array().cast("array<double>"))}
        )
    tiled = rows.join(broadcast_if_small(numbers), "id").withColumn("tile", F.floor(F.col("sidx") / tile).cast("int"))
    return tiled, tile, size["n"], size["chunks"] or 0


def _sent_rows(tiled: DataFrame, tile: int, n: int) -> DataFrame:
    """Rows of :func:`_numbered_rows` at their tile pairs, in about one partition for each pair."""
    tiles = max(1, -(-n // tile))
    return TL.all_tile_pairs(tiled, tiles).repartition(min(tiles * (tiles + 1) // 2, MOST_PARTS), "t", "u")


def pair_distances(rows: DataFrame, metric: str = "euclidean", p: float = 2, tile: int | None = None) -> DataFrame:
    """Distance of every sample pair once (columns ``i < j`` and ``dist``), from :func:`sample_rows`.

    The result has n(n-1)/2 rows by definition; it is produced strip by strip of a tile pair and never
    gathered.
    """
    power = _exponent(metric, p)
    labelled = "label" in rows.columns
    tiled, tile, n, chunks = _numbered_rows(rows, tile, ordered=True)
    schema = ", ".join(f"{c} array<{kind}>" for c, kind in (*_STRIP[: 4 if labelled else 2], ("total", "double")))
    strips = _sent_rows(tiled, tile, n).groupBy("t", "u", "chunk").applyInArrow(_sums_of_tiles(metric, power, labelled), schema)
    sums = _pairs_of_strips(strips, labelled)
    keys = ["i", "j", *(["li", "lj"] if labelled else [])]
    if chunks:
        sums = sums.groupBy(*keys).agg(F.sum("total").alias("total"))
    dist = F.col("total") if power == 1 else (F.sqrt("total") if power == 2 else F.pow("total", F.lit(1 / power)))
    out = ["i", "j", dist.alias("dist")]
    if labelled:
        out.append((F.col("li") == F.col("lj")).alias("same"))
    return sums.select(*out)


def distance_matrix(
    long: DataFrame, metric: str = "euclidean", p: float = 2, key: str = "sampleId", feature: str = "idx", value: str = "dosage"
) -> DataFrame:
    return pair_distances(sample_rows(long, key, feature, value), metric, p)


def mirror(pairs: DataFrame, diagonal: DataFrame | None = None) -> DataFrame:
    """Both orders of each pair; ``diagonal`` (one id column) adds the zero diagonal."""
    twice = pairs.select("i", "j", "dist", F.explode(F.array(F.lit(False), F.lit(True))).alias("_s"))  # the pairs are computed once
    swap = F.col("_s")
    full = twice.select(F.when(swap, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("j"), "dist")
    if diagonal is None:
        return full
    d = F.col(diagonal.columns[0])
    return full.unionByName(diagonal.select(d.alias("i"), d.alias("j"), F.lit(0.0).alias("dist")))


def all_pairs(samples: DataFrame, key: str = "sampleId", tile: int | None = None) -> DataFrame:
    """Each unordered sample pair once (``i < j``), tile pair by tile pair.

    Tiles are consecutive in key order, so the place of a pair tells which end is the smaller one. Runs of the earlier tile
    meet the whole later one, and the pairs of one run are bounded. A null key counts as a sample; its pairs name the
    other end twice.
    """
    numbers = row_index(samples.select(F.col(key).alias("id")).distinct(), "id", out="at")
    n = numbers.count()
    tile = tile or TL.tile_size(n, 1, cells=PAIR_IDS, most=PAIR_IDS, parts=PAIR_TILES)
    tiles, run = max(1, -(-n // tile)), max(1, RUN_PAIRS // tile)
    parts = max(1, min(tiles * (tiles + 1) // 2, MOST_PARTS, n * n // 2 // PART_PAIRS))
    numbers = numbers.withColumn("tile", F.floor(F.col("at") / tile).cast("int"))

    def lists(*by: str | Column) -> DataFrame:
        return numbers.groupBy("tile", *by).agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("e"))

    runs = lists(F.floor(F.col("at") % tile / run).cast("int").alias("run"))
    runs = runs.select(F.col("tile").alias("t"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("u"), (F.col("run") * run).alias("p"), F.col("e.id").alias("a"))
    whole = lists().select(F.explode(F.sequence(F.lit(0), "tile")).alias("t"), F.col("tile").alias("u"), F.col("e.id").alias("b"))
    met = runs.repartition(parts, "t", "u").join(whole.repartition(parts, "t", "u").hint("merge"), ["t", "u"])
    first = met.select("t", "u", "b", "p", F.posexplode("a").alias("o", "x"))
    after = F.when(F.col("t") == F.col("u"), F.slice("b", F.col("p") + F.col("o") + 2, F.lit(tile))).otherwise(F.col("b"))
    return first.select("x", F.explode(after).alias("y")).select(F.coalesce("x", "y").alias("i"), F.col("y").alias("j"))


def _square_sums_of_tiles(metric: str, p: float) -> Callable[[pa.Table], pa.Table]:
    def sums(table: pa.Table) -> pa.Table:
        pair = _TilePair(table, metric, p)
        total = np.zeros(len(pair.table))
        for first, last, power, inside in pair.strips():
            squares = power ** (2 / p) if p != 2 else power
            squares = squares if inside is None else np.where(inside, squares, 0.0)
            total[pair.later[first:last]] += squares.sum(axis=1)
            total[pair.earlier[: squares.shape[1]]] += squares.sum(axis=0)
        return pa.table({"id": pair.table["id"], "total": total})

    return sums


def square_sums(
    long: DataFrame, metric: str = "euclidean", p: float = 2, key: str = "sampleId", feature: str = "idx", value: str = "dosage",
    tile: int | None = None,
) -> DataFrame:
    """(id, total): per sample the sum of its squared distances to all others, a row per sample and tile pair before they are added."""
    rows = sample_rows(long, key, feature, value)
    tiled, tile, n, chunks = _numbered_rows(rows, tile)
    if chunks:
        return _sums_of_pairs(pair_distances(rows, metric, p, tile))
    return _added_squares(_sent_rows(tiled, tile, n), metric, _exponent(metric, p))


def _added_squares(sent: DataFrame, metric: str, power: float) -> DataFrame:
    parts = sent.groupBy("t", "u").applyInArrow(_square_sums_of_tiles(metric, power), "id string, total double")
    return parts.groupBy("id").agg(F.sum("total").alias("total"))


def _sums_of_pairs(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("i", "j")).alias("id"), (F.col("dist") * F.col("dist")).alias("d2"))
    return ends.groupBy("id").agg(F.sum("d2").alias("total"))


def mds_double_centre(pairs: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """``B = -1/2 J D^2 J`` from the upper triangle; entries with ``i <= j``.

    ``sums`` from :func:`square_sums` saves a pass over the pairs.
    """
    squared = pairs.select("i", "j", (F.col("dist") * F.col("dist")).alias("d2"))
    sums = cut_lineage(_sums_of_pairs(pairs) if sums is None else sums)
    head = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).first()
    means = sums.select("id", (F.col("total") / head["n"]).alias("m"))
    grand = F.lit((head["total"] or 0.0) / max(head["n"], 1) ** 2)
    side = broadcast_if_small(means)
    off = (
        squared.join(side.select(F.col("id").alias("i"), F.col("m").alias("mi")), "i")
        .join(side.select(F.col("id").alias("j"), F.col("m").alias("mj")), "j")
        .select("i", "j", (F.lit(-0.5) * (F.col("d2") - F.col("mi") - F.col("mj") + grand)).alias("b"))
    )
    diagonal = means.select(F.col("id").alias("i"), F.col("id").alias("j"), (F.col("m") - grand / 2).alias("b"))
    return off.unionByName(diagonal)


class CentredSquares:
    """``B = -1/2 J D^2 J`` as a symmetric matrix for :class:`krylov.EigenPairs`, never stored: every product forms the distances anew.

    A row of ``blocks`` holds the samples of two tiles, as long as they have one feature chunk; ``edge`` samples make a tile.
    """

    def __init__(self, numbered: DataFrame, n: int, edge: int, metric: str, p: float) -> None:
        self.rows = self.columns = n
        self.edge, self.metric, self.power = edge, metric, _exponent(metric, p)
        stored = cut_lineage(numbered.select("id", "sidx", "tile", "f", "v"))
        sums = cut_lineage(_added_squares(_sent_rows(stored, edge, n), metric, self.power).withColumn("m", F.col("total") / n))
        self.grand = (sums.agg(F.sum("total")).first()[0] or 0.0) / n**2
        self.samples = stored.select(F.col("id").alias("i"), "sidx")
        sent = _sent_rows(stored.join(broadcast_if_rows(sums.select("id", "m"), n), "id").drop("id"), edge, n)
        entry = F.struct("sidx", "role", "f", "v", "m")
        self.blocks = cut_lineage(sent.groupBy("t", "u").agg(F.collect_list(entry).alias("e")))

    def times(self, vectors: DataFrame, width: int, across: bool = False) -> DataFrame:
        """(b, q): the matrix times block vectors (b, q)."""
        edge, metric, power, grand = self.edge, self.metric, self.power, self.grand
        side = broadcast_if_rows(vectors, self.rows * width, VECTOR_CELLS)
        joined = self.blocks.join(side.select(F.col("b").alias("t"), F.col("q").alias("qt")), "t")
        joined = joined.join(side.select(F.col("b").alias("u"), F.col("q").alias("qu")), "u")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, u, e, qt, qu in zip(*(batch.column(c) for c in ("t", "u", "e", "qt", "qu"))):
                    pair = _TilePair(pa.Table.from_struct_array(e.values), metric, power)
                    m = pair.table["m"].to_numpy()
                    own, other = m[pair.later], m[pair.earlier]
                    x, y = (q.values.to_numpy().reshape(edge, width) for q in (qt, qu))
                    later, earlier = np.zeros((edge, width)), np.zeros((edge, width))
                    for first, last, sums, inside in pair.strips():
                        c = sums.shape[1]
                        cells = -0.5 * ((sums ** (2 / power) if power != 2 else sums) - own[first:last, None] - other[:c] + grand)
                        if inside is not None:
                            cells[~inside] = 0.0
                        later[first:last] += cells @ y[:c]
                        earlier[:c] += cells.T @ x[first:last]
                    if t.as_py() == u.as_py():
                        later[: len(own)] += earlier[: len(own)] + (own - grand / 2)[:, None] * x[: len(own)]
                        yield _block_rows([t.as_py()], [later])
                    else:
                        yield _block_rows([t.as_py(), u.as_py()], [later, earlier])

        parts = joined.select("t", "u", "e", "qt", "qu").mapInArrow(multiply, "b int, q array<double>")
        return parts.groupBy("b").applyInArrow(KR.added, "b int, q array<double>")


def _block_rows(keys: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
    return KR.batch_of(keys, [b.ravel() for b in blocks])


def centred_squares(
    long: DataFrame, metric: str, p: float = 2, key: str = "sampleId", feature: str = "idx", value: str = "dosage", edge: int | None = None
) -> CentredSquares | None:
    """The matrix of the samples' distances, or ``None`` if it has fewer than two samples or more than one feature chunk."""
    tiled, edge, n, chunks = _numbered_rows(sample_rows(long, key, feature, value), edge)
    if chunks or n < 2:
        return None
    if edge > MOST_EDGE:
        edge = MOST_EDGE
        tiled = tiled.withColumn("tile", F.floor(F.col("sidx") / edge).cast("int"))
    return CentredSquares(tiled, n, edge, metric, p)


# ---------------------------------------------------------------- cluster indices


def labelled_distances(long: DataFrame, label: str, key: str = "sampleId", feature: str = "idx", value: str = "w") -> DataFrame:
    """Pair distances with a same-cluster flag, kept for the passes of the indices below."""
    return pair_distances(sample_rows(long, key, feature, value, label))


def calinski_harabasz(long: DataFrame, label: str, key: str = "sampleId", feature: str = "idx", value: str = "w") -> DataFrame:
    """Between- over within-cluster dispersion, from sums per cluster and feature (no pairs)."""
    x = F.col(value).cast("double")
    cells = long.groupBy(label, feature).agg(F.count(value).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    per_feature = cells.groupBy(feature).agg(
        F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c")
    )
    k = one_value(long.agg(F.count_distinct(label)))
    n = one_value(long.agg(F.count_distinct(key)))
    sums = per_feature.agg(
        F.sum(F.col("q") - F.col("c")).alias("within"), F.sum(F.col("c") - F.col("s") * F.col("s") / F.col("n")).alias("between")
    )
    return sums.select(((F.col("between") / (k - 1)) / (F.col("within") / (n - k))).alias("calinski_harabasz"))


def dunn(pairs: DataFrame) -> DataFrame:
    """Smallest distance between clusters over the largest inside one."""
    return pairs.agg(
        (F.min(F.when(~F.col("same"), F.col("dist"))) / F.max(F.when(F.col("same"), F.col("dist")))).alias("dunn")
    )


#: One range of distances: number of a selection, lowest and highest distance that may be its boundary.
Span = tuple[int, float, float]
_HISTOGRAM = "k int, b long, n long, s double, lo double, hi double"


def _buckets_of(parts: DataFrame) -> DataFrame:
    sums = (F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.groupBy("k", "b").agg(*sums)


def _sums_of_smallest(histogram: Callable[[list[Span]], DataFrame], counts: list[int], low: float, high: float) -> list[float]:
    """For each of ``counts`` the sum of that many smallest distances, exactly.

    Each pass histograms, for every selection, the range that still holds its boundary; only bucket totals (a fixed
    number) reach the driver. The range shrinks by the bucket count every pass.
    """
    totals, left = [0.0] * len(counts), list(counts)
    spans = {k: (low, high) for k, n in enumerate(counts) if n}
    while spans:
        for k, (lo, hi) in list(spans.items()):
            if hi <= lo:  # ties
                totals[k] += left[k] * lo
                del spans[k]
        if not spans:
            break
        found: dict[int, list] = {k: [] for k in spans}
        for row in histogram([(k, *span) for k, span in spans.items()]).orderBy("k", "b").collect():
            found[row["k"]].append(row)
        for k, rows in found.items():
            del spans[k]
            for row in rows:
                if row["n"] > left[k]:
                    spans[k] = (row["lo"], row["hi"])
                    break
                totals[k] += row["s"]
                left[k] -= row["n"]
                if not left[k]:
                    break
    return totals


def _sum_of_smallest(pairs: DataFrame, count: int, low: float, high: float, buckets: int = 4096) -> float:
    """The same for one selection from a table of distances."""

    def histogram(spans: list[Span]) -> DataFrame:
        ((k, lo, hi),) = spans
        inside = pairs.filter(F.col("dist").between(lo, hi))
        bucket = F.least(F.floor((F.col("dist") - lo) / F.lit((hi - lo) / buckets)), F.lit(buckets - 1))
        dist = F.col("dist")
        one = inside.select(F.lit(k).alias("k"), bucket.alias("b"), F.lit(1).alias("n"), dist.alias("s"), dist.alias("lo"), dist.alias("hi"))
        return _buckets_of(one)

    return _sums_of_smallest(histogram, [count], low, high)[0]


def _distances_of_tiles(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Euclidean distances of the sample pairs of two tiles, and whether both have the same label, strip by strip.

    The same rows give the same distances in every pass.
    """
    pair = _TilePair(table, "euclidean", 2)
    label = pair.table["label"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    own, other = label[pair.later], label[pair.earlier]
    for first, last, squares, inside in pair.strips():
        same = (own[first:last, None] == other[: squares.shape[1]]) & (own[first:last] >= 0)[:, None]
        dist = np.sqrt(squares, out=squares)
        yield (dist.ravel(), same.ravel()) if inside is None else (dist[inside], same[inside])


_TOTALS = "n long, nw long, all double, sw double, lo double, hi double, near double, far double"


def _totals_of_tiles(table: pa.Table) -> pa.Table:
    """One row per tile pair: counts, sums and extremes of its distances."""
    n = nw = 0
    total = within = 0.0
    low, high, near, far = np.inf, -np.inf, np.inf, -np.inf
    for dist, same in _distances_of_tiles(table):
        inner, outer = dist[same], dist[~same]
        n, nw, total, within = n + dist.size, nw + inner.size, total + dist.sum(), within + inner.sum()
        low, high = np.minimum(low, dist.min(initial=np.inf)), np.maximum(high, dist.max(initial=-np.inf))
        near, far = np.minimum(near, outer.min(initial=np.inf)), np.maximum(far, inner.max(initial=-np.inf))
    known = lambda x, count: float(x) if count else None
    row = (n, nw, total, within, known(low, n), known(high, n), known(near, n - nw), known(far, nw))
    names = [c.split()[0] for c in _TOTALS.split(", ")]
    return pa.table({n: pa.array([x], pa.int64() if n in ("n", "nw") else pa.float64()) for n, x in zip(names, row)})


def _histogram_of_tiles(spans: list[Span], buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Filled buckets of every span; selections that still share a span share its histogram."""
    distinct = sorted({(low, high) for _, low, high in spans})

    def histogram(table: pa.Table) -> pa.Table:
        count = np.zeros((len(distinct), buckets), dtype=np.int64)
        total = np.zeros((len(distinct), buckets))
        least, most = np.full((len(distinct), buckets), np.inf), np.full((len(distinct), buckets), -np.inf)
        for dist, _ in _distances_of_tiles(table):
            for at, (low, high) in enumerate(distinct):
                some = np.sort(dist[(dist >= low) & (dist <= high)])
                if some.size:
                    bucket = np.minimum((some - low) / ((high - low) / buckets), buckets - 1).astype(np.int64)
                    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                    b, n = bucket[first], np.diff(np.append(first, some.size))
                    count[at, b] += n
                    total[at, b] += np.add.reduceat(some, first)
                    least[at, b] = np.minimum(least[at, b], some[first])
                    most[at, b] = np.maximum(most[at, b], some[first + n - 1])
        out = []
        for k, low, high in spans:
            at = distinct.index((low, high))
            b = np.flatnonzero(count[at])
            out.append((np.full(b.size, k, np.int32), b, count[at, b], total[at, b], least[at, b], most[at, b]))
        columns = [np.concatenate(c) for c in zip(*out)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["k", "b", "n", "s", "lo", "hi"])

    return histogram


def pair_indices(
    long: DataFrame, label: str, key: str = "sampleId", feature: str = "idx", value: str = "w", tile: int | None = None, buckets: int = 4096
) -> DataFrame:
    """One row (dunn, c_index) of a clustering, without a table of pairs.

    Every pass multiplies the tiles anew and takes one row of totals, or the filled buckets of a histogram, from a pair of
    tiles. Samples longer than one feature chunk have no distance inside a tile pair; their pairs are stored. Fewer
    than two samples, or no pair of either kind, give nulls.
    """
    rows = sample_rows(long, key, feature, value, label)
    tiled, tile, n, chunks = _numbered_rows(rows, tile)
    if chunks:
        pairs = cut_lineage(pair_distances(rows, tile=tile))
        return c_index(pairs).select(dunn(pairs).scalar().alias("dunn"), "c_index")
    # Rows are stored once; every pass sends them anew.
    tiles = _sent_rows(cut_lineage(tiled.drop("chunk")), tile, n).groupBy("t", "u")
    head = tiles.applyInArrow(_totals_of_tiles, _TOTALS).agg(
        *[F.sum(c).alias(c) for c in ("n", "nw", "all", "sw")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("near").alias("near"), F.max("far").alias("far")
    ).first()
    schema = "dunn double, c_index double"
    if not head["n"]:
        return long.sparkSession.createDataFrame([(None, None)], schema)

    def histogram(spans: list[Span]) -> DataFrame:
        return _buckets_of(tiles.applyInArrow(_histogram_of_tiles(spans, buckets), _HISTOGRAM))

    smallest, others = _sums_of_smallest(histogram, [head["nw"], head["n"] - head["nw"]], head["lo"], head["hi"])
    spread = head["all"] - others - smallest
    index = (head["sw"] - smallest) / spread if spread else None
    return long.sparkSession.createDataFrame([(head["near"] / head["far"] if head["near"] is not None and head["far"] else None, index)], schema)


def c_index(pairs: DataFrame) -> DataFrame:
    """``(S - S_min) / (S_max - S_min)`` over the within-cluster distances."""
    pairs = cut_lineage(pairs.select("dist", "same"))  # read again by every pass below
    head = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("nw"), F.sum("dist").alias("all"),
        F.sum(F.when(F.col("same"), F.col("dist"))).alias("sw"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
    ).first()
    smallest = _sum_of_smallest(pairs, head["nw"], head["lo"], head["hi"])
    largest = head["all"] - _sum_of_smallest(pairs, head["n"] - head["nw"], head["lo"], head["hi"])
    spread = largest - smallest
    value = (head["sw"] - smallest) / spread if spread else None
    return pairs.sparkSession.createDataFrame([(value,)], "c_index double")


def distance_column(x: Column, y: Column, metric: str = "euclidean", p: float = 2) -> Column:
    """Distance of two array columns of the same row."""
    power = _exponent(metric, p)
    if metric == "hamming":
        parts = F.zip_with(x, y, lambda a, b: (a != b).cast("double"))
    else:
        parts = F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b).cast("double"), F.lit(power)))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return total if power == 1 else F.pow(total, F.lit(1 / power))
