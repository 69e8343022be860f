"""Linkage disequilibrium of windowed SNP pairs and greedy LD pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ld as LD
from ..session import broadcast_if_small, cut_lineage, scratch_path
from . import tiles as TL
from .catalog import row_index, sample_index

#: Samples per chunk of a SNP vector; counts of several chunks are added up.
SAMPLE_CHUNK = 1 << 20
#: Neighbouring SNPs that the greedy scan never separates, and edges up to which segments are settled in one task.
SEGMENT, GROUP_EDGES = 256, 1 << 18
#: Sites per tile of the pair join.
PAIR_TILE = 1024
#: Grid points in one mask.
MASK_BITS = 62


def snp_vectors(
    calls: DataFrame, idx: str = "idx", pos: str = "start", value: str = "dosage", chunk: int = SAMPLE_CHUNK
) -> DataFrame:
    """Per SNP (and sample chunk) the known dosages with their sample numbers.

    ``calls`` holds one dosage per (sample, SNP), repeated rows fold into one; values outside 0..2 and
    NULLs are missing. The sample numbers are checkpointed, so that every later stage sees the same ones.
    """
    numbers = cut_lineage(sample_index(calls.select("sampleId")))
    typed = calls.select(
        "sampleId", "contig", F.col(idx).cast("long").alias("idx"), F.col(pos).cast("long").alias("pos"),
        F.when(F.col(value).between(0, 2), F.col(value)).cast("byte").alias("d"),
    )
    numbered = typed.join(broadcast_if_small(numbers), "sampleId")
    entry = F.struct((F.col("sidx") % chunk).cast("int").alias("s"), "d")
    entries = numbered.select(
        "contig", "idx", "pos", F.floor(F.col("sidx") / chunk).cast("int").alias("chunk"),
        F.when(F.col("d").isNotNull(), entry).alias("e"),  # a SNP without known dosages keeps an empty row
    )
    # Sorted: of contradicting calls the largest dosage counts, whatever the order of the rows.
    gathered = entries.groupBy("contig", "idx", "pos", "chunk").agg(F.array_sort(F.collect_set("e")).alias("e"))
    return gathered.select("contig", "idx", "pos", "chunk", F.col("e.s").alias("s"), F.col("e.d").alias("d"))


_CELL_SCHEMA = pa.schema(
    [("contig", pa.string()), ("i", pa.int64()), ("j", pa.int64())] + [(c, pa.int64()) for c in LD.CELLS]
)


def _cells_of_tiles(max_bp: int | None, max_n: int | None) -> Callable[[pa.Table], pa.Table]:
    def cells(table: pa.Table) -> pa.Table:
        later, earlier = TL.split_roles(table)
        contig = table["contig"][0].as_py()
        idx, pos = table["idx"].to_numpy(), table["pos"].to_numpy()
        s = TL.list_column(table, "s")
        width = int(s.flatten().to_numpy().max(initial=-1)) + 1
        dose = TL.scatter(s, TL.list_column(table, "d"), width, 3, np.int8)
        planes = np.stack([dose == g for g in range(3)]).astype(np.float32)
        a = planes[:, later].reshape(3 * later.size, width)
        b = planes[:, earlier].reshape(3 * earlier.size, width)
        counts = (a @ b.T).reshape(3, later.size, 3, earlier.size)
        gap = idx[later][:, None] - idx[earlier][None, :]
        inside = gap > 0
        if max_n is not None:
            inside &= gap <= max_n
        if max_bp is not None:
            inside &= np.abs(pos[later][:, None] - pos[earlier][None, :]) <= max_bp
        r, c = np.nonzero(inside)
        columns = [pa.array([contig] * r.size, pa.string()), pa.array(idx[later][r]), pa.array(idx[earlier][c])]
        columns += [pa.array(counts[x, r, y, c].astype(np.int64)) for x in range(3) for y in range(3)]
        return pa.Table.from_arrays(columns, schema=_CELL_SCHEMA)

    return cells


def window_tiles(vectors: DataFrame, max_bp: int | None, max_n: int | None, tile: int) -> DataFrame:
    """SNP vectors sent to their tile pairs."""
    tiled = vectors.withColumn("tile", F.floor(F.col("idx") / tile).cast("int"))
    meta = tiled.groupBy("contig", "tile").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min("idx").alias("first_n"), F.max("idx").alias("last_n"),
    )
    pairs = TL.windowed_tile_pairs(meta, max_bp, max_n)
    # One row per tile: the pairs it takes part in, a bounded neighbourhood.
    ends = pairs.select("contig", F.col("t").alias("tile"), "t", "u").unionByName(
        pairs.filter("t <> u").select("contig", F.col("u").alias("tile"), "t", "u")
    )
    routes = ends.groupBy("contig", "tile").agg(F.collect_list(F.struct("t", "u")).alias("_to"))
    sent = tiled.join(routes, ["contig", "tile"]).withColumn("_p", F.explode("_to")).drop("_to")
    sent = sent.select("*", F.col("_p.t").alias("t"), F.col("_p.u").alias("u")).drop("_p")
    return sent.withColumn("role", TL.role(F.col("tile"), F.col("t"), F.col("u")))


def pair_counts(
    vectors: DataFrame, max_bp: int | None = 500_000, max_n: int | None = None, tile: int | None = None
) -> DataFrame:
    """3x3 genotype counts of every SNP pair ``j < i`` inside the window, per contig."""
    size = vectors.agg(
        F.count(F.lit(1)).alias("rows"), (F.max(F.array_max("s")) + 1).alias("width"), F.max("chunk").alias("chunks")
    ).first()  # a tile is as wide as the highest sample number, however few calls are known
    sent = window_tiles(vectors, max_bp, max_n, tile or TL.tile_size(size["rows"], size["width"] or 1))
    schema = "contig string, i long, j long, " + ", ".join(f"{c} long" for c in LD.CELLS)
    counted = sent.groupBy("contig", "t", "u", "chunk").applyInArrow(_cells_of_tiles(max_bp, max_n), schema)
    if size["chunks"]:
        counted = counted.groupBy("contig", "i", "j").agg(*[F.sum(c).alias(c) for c in LD.CELLS])
    return counted


def position_tiles(sites: DataFrame, tile: int) -> DataFrame:
    """Sites (contig, idx, pos) with the number of their tile: ``tile`` neighbours in order of position, however crowded."""
    ordered = row_index(sites, "contig", "pos", "idx", out="_n")
    return cut_lineage(ordered.withColumn("tile", F.floor(F.col("_n") / tile).cast("long")).drop("_n"))


def neighbour_tiles(tiled: DataFrame, max_bp: int, max_n: int | None = None) -> DataFrame:
    """Tile pairs (contig, t, u), ``u <= t``, that can hold a pair inside the window.

    One sweep per contig over the ends of the tiles finds the first tile that reaches into the halo of each; all in between
    belong to it, as tiles follow position. One row per tile is swept, not one per site.
    """
    meta = cut_lineage(
        tiled.groupBy("contig", "tile").agg(
            F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("idx").alias("first_n"), F.max("idx").alias("last_n")
        )
    )
    none = F.lit(None).cast("long")
    ends = meta.select("contig", F.col("last_pos").alias("p"), F.col("tile").alias("end_of"), none.alias("t")).unionByName(
        meta.select("contig", (F.col("first_pos") - max_bp).alias("p"), none.alias("end_of"), F.col("tile").alias("t"))
    )
    onwards = Window.partitionBy("contig").orderBy("p").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    reach = ends.withColumn("_u", F.min("end_of").over(onwards)).where(F.col("t").isNotNull())
    pairs = reach.select("contig", "t", F.explode(F.sequence(F.least("_u", "t"), F.col("t"))).alias("u"))
    if max_n is None:
        return pairs
    side = lambda name: meta.select("contig", F.col("tile").alias(name), F.col("first_n").alias(f"{name}_first"), F.col("last_n").alias(f"{name}_last"))
    met = pairs.join(side("t"), ["contig", "t"]).join(side("u"), ["contig", "u"])
    near = (F.col("t_first") - F.col("u_last") <= max_n) & (F.col("u_first") - F.col("t_last") <= max_n)
    return met.where(near).select("contig", "t", "u")


def window_pair_join(
    snps: DataFrame, max_bp: int = 500_000, max_n: int | None = None, idx: str = "idx", pos: str = "start", tile: int = PAIR_TILE
) -> DataFrame:
    """Pairs ``j < i`` with both gaps inside the window; sites without number, position or contig have none.

    Sites are sorted into ranges and cut by count, and tiles meet those in their halo by an equi-join on the tile pair, so a
    crowded stretch of a contig becomes many keys of bounded size instead of one hot bucket.
    """
    sites = snps.select("contig", F.col(idx).alias("idx"), F.col(pos).alias("pos")).dropna()
    tiled = position_tiles(sites, tile)
    pairs = neighbour_tiles(tiled, max_bp, max_n)
    later = tiled.select("contig", F.col("tile").alias("t"), F.col("idx").alias("x"), F.col("pos").alias("pos_x")).join(pairs, ["contig", "t"])
    earlier = tiled.select("contig", F.col("tile").alias("u"), F.col("idx").alias("y"), F.col("pos").alias("pos_y")).join(pairs, ["contig", "u"])
    close = (F.col("x") != F.col("y")) & (F.abs(F.col("pos_x") - F.col("pos_y")) <= max_bp)
    close = close & ((F.col("t") != F.col("u")) | (F.col("x") > F.col("y")))  # inside a tile both orders meet
    if max_n is not None:
        close = close & (F.abs(F.col("x") - F.col("y")) <= max_n)
    ahead = F.col("x") > F.col("y")
    return later.join(earlier, ["contig", "t", "u"]).filter(close).select(
        "contig", F.greatest("x", "y").alias("i"), F.when(ahead, F.col("pos_x")).otherwise(F.col("pos_y")).alias("pos_i"),
        F.least("x", "y").alias("j"), F.when(ahead, F.col("pos_y")).otherwise(F.col("pos_x")).alias("pos_j"),
    )


def ld_value(counts: DataFrame, method: str, out: str = "ld") -> DataFrame:
    """One LD measure per counted pair."""
    if method == "composite":
        return counts.withColumn(out, LD.composite())
    if method == "corr":
        return counts.withColumn(out, LD.corr())
    if method in ("r", "dprime"):
        with_p = haplotypes(counts)
        measure = LD.r_from_haplotypes if method == "r" else LD.dprime_from_haplotypes
        return with_p.withColumn(out, measure(F.col("hap"))).drop("hap")
    raise ValueError(f"unknown LD method {method!r}; one of {LD.METHODS}")


def haplotypes(counts: DataFrame, out: str = "hap") -> DataFrame:
    """Haplotype proportions (EM) per counted pair as a struct column."""
    return counts.withColumn(out, LD.haplotype_em(*LD.haplotype_counts().values()))


def ld_matrix(
    calls: DataFrame, method: str = "composite", max_bp: int | None = 500_000, max_n: int | None = None,
    idx: str = "idx", pos: str = "start",
) -> DataFrame:
    """LD of all windowed pairs: contig, i, j, ld."""
    counts = pair_counts(snp_vectors(calls, idx, pos), max_bp, max_n)
    return ld_value(counts, method).select("contig", "i", "j", "ld")


# ---------------------------------------------------------------- pruning


def orient(pairs: DataFrame, start: int | None, cross_boundary: bool = False) -> DataFrame:
    """Pairs ``j < i`` → (scan, later, earlier, mask) in scan order.

    ``scan`` is the contig and ``mask`` the single bit 1 unless the pairs bring their own. From ``start`` the scan runs
    upward, below it downward; the two scans ignore each other unless ``cross_boundary`` lets the downward scan see
    what the upward scan kept.
    """
    if "scan" not in pairs.columns:
        pairs = pairs.withColumn("scan", F.col("contig"))
    if "mask" not in pairs.columns:
        pairs = pairs.withColumn("mask", F.lit(1).cast("long"))
    if start is None:
        return pairs.select("scan", F.col("i").alias("later"), F.col("j").alias("earlier"), "mask")
    up_i, up_j = F.col("i") >= start, F.col("j") >= start
    kept = pairs if cross_boundary else pairs.filter(up_i == up_j)
    return kept.select(
        "scan",
        F.when(up_j, F.col("i")).otherwise(F.col("j")).alias("later"),
        F.when(up_j, F.col("j")).otherwise(F.col("i")).alias("earlier"),
        "mask",
    )


def _settle(start: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Greedy scan of one group of segments, all bits of the masks at once.

    Edges lie in one compressed array, ordered by the rank of their later SNP, so a SNP's edges are one slice. A bit
    that hangs on a SNP outside the group stays open.
    """

    def settle(edges: pd.DataFrame) -> pd.DataFrame:
        later, earlier = edges["later"].to_numpy(), edges["earlier"].to_numpy()
        nodes = np.unique(later)
        if start is not None:  # upward part first, then downward from the start
            nodes = nodes[np.lexsort((np.where(nodes >= start, nodes, -nodes), nodes < start))]
        by_number = np.argsort(nodes)
        numbers = nodes[by_number]
        rank = by_number[np.searchsorted(numbers, later)]
        order = np.argsort(rank, kind="stable")
        at = np.minimum(np.searchsorted(numbers, earlier), nodes.size - 1)
        source = np.where(numbers[at] == earlier, by_number[at], nodes.size)[order]
        mask, free = edges["mask"].to_numpy()[order], ~edges["open"].to_numpy()[order]
        bounds = np.searchsorted(rank[order], np.arange(nodes.size + 1))
        kept, dropped = np.zeros(nodes.size + 1, np.int64), np.zeros(nodes.size + 1, np.int64)
        for r in range(nodes.size):
            part = slice(bounds[r], bounds[r + 1])
            own, known = mask[part], kept[source[part]] | free[part]
            out = np.bitwise_or.reduce(own & known)
            wait = np.bitwise_or.reduce(own & ~known & ~dropped[source[part]])
            dropped[r], kept[r] = out, np.bitwise_or.reduce(own) & ~out & ~wait
        told = np.flatnonzero(kept[:-1] | dropped[:-1])
        return pd.DataFrame({"scan": edges["scan"].iloc[0], "node": nodes[told], "kept": kept[told], "dropped": dropped[told]})

    return settle


def _grouped(edges: DataFrame, segment: int, most: int) -> DataFrame:
    """Edges with the group ``_g`` that settles them: neighbouring segments, together about ``most`` edges."""
    numbered = edges.withColumn("_s", F.floor(F.col("later") / segment))
    so_far = F.sum("n").over(Window.partitionBy("scan").orderBy("_s"))  # one row per segment, not per SNP
    groups = numbered.groupBy("scan", "_s").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select("scan", "_s", F.floor((so_far - 1) / most).alias("_g"))
    return numbered.join(groups, ["scan", "_s"]).drop("_s")


def greedy_dropped(edges: DataFrame, start: int | None = None, segment: int = SEGMENT, most: int = GROUP_EDGES) -> DataFrame:
    """SNPs and bits (scan, node, mask) that the greedy scans drop, from conflict edges (scan, later, earlier, mask).

    Every bit of ``mask`` is a scan of its own, an edge without a mask belongs to bit 1. In a scan, a SNP is dropped when
    an earlier neighbour is kept and kept when all earlier neighbours are dropped. Each round settles groups of
    segments in parallel; edges of settled bits vanish, and the groups of the next round widen so that they hold as many
    edges again: what waits along a chain of segments soon lies in one group. The rounds' results are stored side by
    side, so the plan does not grow. A SNP may come in several rows with different bits.
    """
    spark = edges.sparkSession
    if "mask" not in edges.columns:
        edges = edges.withColumn("mask", F.lit(1).cast("long"))
    edges = cut_lineage(edges)
    settled_schema = f"scan {edges.schema['scan'].dataType.simpleString()}, node long, kept long, dropped long"
    paths: list[str] = []
    while not edges.isEmpty():
        waiting = edges.groupBy("scan", F.col("later").alias("earlier")).agg(F.bit_or("mask").alias("open"))
        flagged = edges.join(waiting, ["scan", "earlier"], "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long")))
        paths.append(scratch_path(spark, "settled"))
        _grouped(flagged, segment, most).groupBy("scan", "_g").applyInPandas(_settle(start), settled_schema).write.parquet(paths[-1])
        settled = spark.read.schema(settled_schema).parquet(paths[-1])
        told = settled.select("scan", F.col("node").alias("later"), F.col("kept").bitwiseOR(F.col("dropped")).alias("_told"))
        out = settled.filter("dropped <> 0").select("scan", F.col("node").alias("earlier"), F.col("dropped").alias("_out"))
        gone = F.coalesce("_told", F.lit(0).cast("long")).bitwiseOR(F.coalesce("_out", F.lit(0).cast("long")))
        left = edges.join(told, ["scan", "later"], "left").join(out, ["scan", "earlier"], "left")
        left = left.select("scan", "later", "earlier", F.col("mask").bitwiseAND(F.bitwise_not(gone)).alias("mask"))
        edges = cut_lineage(left.filter("mask <> 0"))
    if not paths:
        return edges.select("scan", F.col("later").alias("node"), "mask")
    settled = spark.read.schema(settled_schema).parquet(*paths)
    return settled.filter("dropped <> 0").select("scan", "node", F.col("dropped").alias("mask"))


def prune_from_pairs(
    snps: DataFrame, pairs: DataFrame, threshold: float, start: int | None = None, cross_boundary: bool = False
) -> DataFrame:
    """Kept SNPs (contig, idx), given LD values of the windowed pairs."""
    conflicts = orient(pairs.filter(LD.is_conflict(F.col("ld"), threshold)), start, cross_boundary)
    dropped = greedy_dropped(conflicts, start).select(F.col("scan").alias("contig"), F.col("node").alias("idx"))
    return snps.select("contig", "idx").join(dropped, ["contig", "idx"], "left_anti")


def ld_prune(
    calls: DataFrame,
    method: str = "composite",
    threshold: float = 0.2,
    max_bp: int | None = 500_000,
    max_n: int | None = None,
    start: int | None = None,
    cross_boundary: bool = False,
    idx: str = "idx",
    pos: str = "start",
) -> DataFrame:
    """Greedy pruning: a SNP stays when its LD with every kept SNP in its window is at most the threshold."""
    vectors = cut_lineage(snp_vectors(calls, idx, pos))
    snps = vectors.select("contig", "idx").distinct()
    pairs = ld_value(pair_counts(vectors, max_bp, max_n), method).select("contig", "i", "j", "ld")
    return prune_from_pairs(snps, pairs, threshold, start, cross_boundary)


def snp_frequency(vectors: DataFrame) -> DataFrame:
    """Alternate-allele frequency per SNP over its known dosages."""
    dose = F.aggregate("d", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return (
        vectors.groupBy("contig", "idx")
        .agg(F.sum(dose).alias("_s"), F.sum(F.size("d")).alias("_n"))
        .select("contig", "idx", (F.col("_s") / (2 * F.col("_n"))).alias("alleleFrequency"))
    )


def ld_prune_grid(
    calls: DataFrame,
    thresholds: Iterable[float],
    mafs: Iterable[float | None] = (None,),
    method: str = "composite",
    max_bp: int | None = 500_000,
    max_n: int | None = None,
    idx: str = "idx",
    pos: str = "start",
) -> DataFrame:
    """Pruning over a parameter grid.

    Pairs are computed once and stay one row each: the grid points are bits of a mask per SNP and per pair, and one scan
    settles them all (beyond ``MASK_BITS`` points, one scan per word of bits, in the same rounds).
    """
    points = [(float(t), m) for m in (None if m is None or m != m else float(m) for m in mafs) for t in thresholds]
    words = [points[k : k + MASK_BITS] for k in range(0, len(points), MASK_BITS)]
    bit = lambda hit, k: F.when(hit, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

    def masks(hits: Callable[[float, float | None], Column]) -> Column:
        """One mask per word of grid points, bit by bit the outcome at that point."""
        return F.array(*[reduce(Column.bitwiseOR, [bit(hits(*point), k) for k, point in enumerate(word)]) for word in words])

    def both(one: str, other: str) -> Column:
        return F.zip_with(one, other, lambda x, y: x.bitwiseAND(y))

    vectors = cut_lineage(snp_vectors(calls, idx, pos))
    minor = F.least("alleleFrequency", 1 - F.col("alleleFrequency"))
    takes = masks(lambda _, maf: F.lit(True) if maf is None else minor >= maf)
    snps = cut_lineage(snp_frequency(vectors).select("contig", "idx", takes.alias("takes")))
    pairs = ld_value(pair_counts(vectors, max_bp, max_n), method).select("contig", "i", "j", "ld")
    # A pair is one row whatever the grid, and only if it conflicts at some point where both SNPs take part.
    some = lambda c: F.exists(c, lambda m: m != 0)
    conflicts = pairs.select("contig", "i", "j", masks(lambda t, _: LD.is_conflict(F.col("ld"), t)).alias("bad")).filter(some("bad"))
    if any(maf is not None for _, maf in points):
        for end in ("i", "j"):
            conflicts = conflicts.join(snps.withColumnRenamed("idx", end), ["contig", end])
            conflicts = conflicts.select("contig", "i", "j", both("bad", "takes").alias("bad")).filter(some("bad"))
    conflicts = conflicts.select("contig", "i", "j", F.posexplode("bad").alias("word", "mask")).filter("mask <> 0")
    conflicts = conflicts.withColumn("scan", F.concat_ws("/", F.col("word").cast("string"), "contig"))
    dropped = greedy_dropped(orient(conflicts, None)).groupBy("scan", F.col("node").alias("idx")).agg(F.bit_or("mask").alias("out"))
    taking = snps.select("contig", "idx", F.posexplode("takes").alias("word", "mask"))
    taking = taking.withColumn("scan", F.concat_ws("/", F.col("word").cast("string"), "contig"))
    kept = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("out", F.lit(0).cast("long"))))
    kept = taking.join(dropped, ["scan", "idx"], "left").withColumn("kept", kept)
    point = lambda t, m: F.struct(F.lit(t).alias("threshold"), F.lit(m).cast("double").alias("maf"))
    chosen = [
        F.when((F.col("word") == w) & (F.col("kept").bitwiseAND(F.lit(1 << k).cast("long")) != 0), point(*p))
        for w, word in enumerate(words) for k, p in enumerate(word)
    ]
    return kept.select("contig", "idx", F.explode(F.array_compact(F.array(*chosen))).alias("g")).select("contig", "idx", "g.threshold", "g.maf")
