"""Near-duplicate documents with SetSketch registers.

A document is the set of its word shingles. Its sketch holds, per register, the minimum of exponential values over
the set, stored as the truncated negative logarithm to a base slightly above 1; such sketches merge by maximum, and
two registers agree the likelier the more similar the sets are. Bands of register values give candidates, the
joint likelihood of two sketches drops hopeless ones, and links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_of, hash_words, mix, prepare, stored
from .components import components

#: Base of the register scale and rate of the exponential values.
BASE, RATE = 1.1, 20.0

#: 48 bands of 6 registers miss a pair of similarity 0.8 with probability below 5e-7.
REGISTERS, BAND_ROWS = 288, 6

#: Standard deviations of the estimate by which a candidate may fall short of the threshold.
SLACK = 6.0

#: Members and shingles in a chunk of a large bucket.
TILE_ROWS, TILE_SHINGLES = 2048, 1_500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and their offsets."""
    tokens, at = hash_words(texts)
    counts = np.diff(at)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = doc_of(offsets)
    first = at[:-1][owner] + np.arange(offsets[-1]) - offsets[owner]
    short = counts[owner] < words
    values = mix(tokens[first] + _GOLD) if len(first) else np.empty(0, dtype=np.uint64)
    for j in range(1, words):
        inside = ~short | (j < counts[owner])
        following = tokens[np.minimum(first + j, len(tokens) - 1)] if len(first) else values
        values = np.where(inside, mix(values * np.uint64(3) + following), values)
    for k in np.flatnonzero(sizes > 1):
        values[offsets[k] : offsets[k + 1]].sort()
    if not len(values):
        return values, offsets
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    sums = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], sums[offsets]


def sketches(values: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Register values (sets x registers, uint8).

    Every element sends out a Poisson process whose arrivals fall on uniformly drawn registers; the first arrival
    at a register is then exponential and independent of the others. An element stops once its process has passed
    the largest minimum of its set, so a large set costs about one arrival per element.
    """
    sets = len(offsets) - 1
    least = np.full((sets, registers), np.inf)
    state, owner = values.copy(), doc_of(offsets)
    time = np.zeros(len(values))
    part, rows = least, np.arange(sets)
    step = 0
    while len(state):
        state = mix(state + _GOLD)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * registers)
        place = ((mix(state ^ _GOLD) >> np.uint64(33)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(part.reshape(-1), owner * registers + place, time)
        step += 1
        if step > 8 and step % 16:
            continue
        alive = time < part.max(axis=1)[owner]
        if part is not least:
            least[rows] = part
        state, time, owner = state[alive], time[alive], owner[alive]
        kept, owner = np.unique(owner, return_inverse=True)
        rows = rows[kept]
        part = least[rows]
    with np.errstate(divide="ignore"):
        scale = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isfinite(least), scale, 0), 0, 255).astype(np.uint8)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets, given their sketches (pairs x registers) and sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    total = (size_a + size_b).astype(np.float64)
    u, v = (size_a / total)[:, None], (size_b / total)[:, None]
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, steps)[None, :] * top
    p, q = _chance(np.clip(u - v * grid, 1e-12, 1)), _chance(np.clip(v - u * grid, 1e-12, 1))
    likelihood = above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))
    return grid[np.arange(len(grid)), likelihood.argmax(axis=1)]


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart by their text."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(text, text.isNull())


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int, registers: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, key1, key2, sketch) per row; equal sets have equal keys."""
    # Ids pass Python as text, so that a null does not turn the others into floating numbers.
    rows = docs.select(
        F.col(id_col).cast("long").cast("string").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, offsets = shingle_sets(batch["text"].tolist(), words)
            marks = sketches(values, offsets, registers)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * _GOLD + np.uint64(c)))]) for c in (11, 97)]
            keys = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": np.diff(offsets), "key1": keys[0], "key2": keys[1],
                    "sketch": [x.tobytes() for x in marks],
                }
            )

    found = rows.mapInPandas(run, "doc_id string, text_key long, n_shingles long, key1 long, key2 long, sketch binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) that size and joint likelihood do not rule out."""
    side = classes.select(F.col("rep").alias("id"), "n_shingles", "sketch")
    joined = (
        pairs.join(side.toDF("a", "size_a", "sketch_a"), "a").join(side.toDF("b", "size_b", "sketch_b"), "b")
        .where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                first, second = (np.stack([np.frombuffer(x, np.uint8) for x in batch[c]]) for c in ("sketch_a", "sketch_b"))
                found = joint_similarity(first, second, batch["size_a"].to_numpy(), batch["size_b"].to_numpy())
                least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / first.shape[1])
                yield batch.loc[found >= least, ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity: 100 * intersection >= percent * union."""
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, at = shingle_sets(batch["text_a"].tolist(), words)
            second, to = shingle_sets(batch["text_b"].tolist(), words)
            keep = [
                _similar(first[at[k] : at[k + 1]], second[to[k] : to[k + 1]], percent) for k in range(len(batch))
            ]
            yield batch.loc[keep, ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    registers: int = REGISTERS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Texts are lower-cased (A-Z) and cut at white space; a text shorter than a shingle is one shingle, and one without
    words links with nothing. Documents with equal sets form a class at once and take part once. In every bucket of
    equal band values the members are tried against the smallest one; then, inside tiles, all pairs of the bucket that
    are still in different components. So no pair of a bucket stays untested unless a chain of links joins it
    already, and a settled group never forms its pairs.
    Null ids keep their row, link with nothing and are not kept. Rows that repeat an id with another text are documents of
    their own, linked or not by what they say; ``kept`` compares ids only. An empty table gives no rows.
    """
    return near_groups(docs, id_col, text_col, words, percent, registers, band_rows).drop("text_key", "stays")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    registers: int = REGISTERS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """:func:`near_duplicates` with ``text_key`` and ``stays``: true for one document of each component, the one of the
    smallest id and text key, and for all documents that link with nothing. Rows that repeat id and text are one document."""
    spark = docs.sparkSession
    prepare(spark)
    similarity = percent / 100
    table = stored(sketch_table(docs, id_col, text_col, words, registers), "setsketch")
    sets = ["n_shingles", "key1", "key2"]
    linked = table.where("doc_id is not null and n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    # Classes have numbers of their own, as rows of one id may lie in several. They rise with the first document, so that
    # the middle of a star is the oldest member of a bucket, of which the others tend to be copies.
    unnumbered = stored(linked.groupBy(*sets).agg(first, F.first("sketch").alias("sketch")), "near")
    classes = stored(unnumbered.orderBy("first").withColumn("rep", F.monotonically_increasing_id()), "near")
    discard(unnumbered)
    bands = F.array(
        *(F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * band_rows, band_rows)) for k in range(registers // band_rows))
    )
    buckets = classes.select("rep", F.posexplode(bands).alias("at", "band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("band", "a")
    members = stored(buckets.join(shared, "band").select("at", "band", "a", F.col("rep").alias("b")), "near")
    asked = classes.join(members.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi").select("rep", "first.*")
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    texts = bodies.join(asked, ["doc_id", "text_key"]).groupBy(F.col("rep").alias("id")).agg(F.first("text").alias("text"))
    texts = stored(texts, "near")
    star = stored(_likely(members.where("a <> b").select("a", "b").distinct(), classes, similarity), "near")

    # The smallest candidate of every document first: one confirmation settles most of a group.
    nearest = star.groupBy("b").agg(F.min("a").alias("a"))
    edges = stored(_confirmed(nearest.select("a", "b"), texts, words, percent), "near")
    groups = _groups(edges)
    rest = _apart(star.join(nearest, ["a", "b"], "left_anti"), groups)
    edges = stored(edges.unionByName(_confirmed(rest, texts, words, percent)), "near")
    groups = _groups(edges)

    # Then, in tiles, every pair of a bucket whose components still differ.
    late = stored(_late_links(members, groups, classes, texts, words, percent, registers // band_rows), "near")
    if not late.isEmpty():
        groups = _groups(edges.unionByName(late))

    joined = groups.toDF("rep", "component")
    least = classes.join(joined, "rep").groupBy("component").agg(F.min("first").alias("least"))
    least = joined.join(least, "component").select("rep", "least")
    found = classes.join(least, "rep", "left").select(*sets, F.coalesce("least", "first").alias("least"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("least.doc_id"), F.col("doc_id")))
    one = F.col("doc_id").isNull() | F.col("least").isNull() | (F.struct("doc_id", "text_key") == F.col("least"))
    return (
        table.drop("sketch").join(found, sets, "left")
        .select("doc_id", "text_key", "n_shingles", own.alias("component_id"), one.alias("stays"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _late_links(
    members: DataFrame, groups: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, bands: int
) -> DataFrame:
    """Links (a, b) between components that share a bucket; a few per pair of components, found inside tiles.

    A bucket of two was settled by its star. Larger ones are cut into chunks of bounded content, and each pair of
    chunks is one tile, so that nothing but links leaves a task.
    """
    # Narrow rows first: only what is left of them meets sketches and texts.
    sizes = classes.select(F.col("rep").alias("b"), "n_shingles")
    known = members.select("at", "band", "b").join(groups.toDF("b", "component"), "b", "left").join(sizes, "b")
    known = stored(known.withColumn("component", F.coalesce("component", "b")), "near")
    mixed = (
        known.groupBy("band").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("content")
        )
        .where("low < high and n > 2")
        .select("band", F.ceil(F.greatest(F.col("n") / TILE_ROWS, F.col("content") / TILE_SHINGLES)).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    spread = (
        known.join(mixed, "band").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    )
    sides = classes.select(F.col("rep").alias("b"), "sketch")
    tile, rows = ["band", "low", "high"], ["at", "own", "b", "component", "n_shingles"]
    # Sketches first: only members with a likely partner in their tile send their texts there.
    likely = spread.join(sides, "b").select(*tile, *rows, "sketch").groupBy(*tile).applyInPandas(
        _likely_members(percent, bands), "band long, low int, high int, at int, own int, b long, component long, n_shingles long"
    )
    likely = stored(likely, "near")
    full = likely.join(sides, "b").join(texts.toDF("b", "text"), "b").select(*tile, *rows, "sketch", "text")
    return full.groupBy(*tile).applyInPandas(_tile(words, percent, bands), "a long, b long")


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["own", "b"], ignore_index=True)


def _partners(key: tuple, frame: pd.DataFrame, percent: int, bands: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a tile with their later rows, likeliest first, that sketches do not rule out and that lie in another component.

    A pair belongs to the first band its sketches share, and to one tile.
    """
    similarity = percent / 100
    part, size, chunk = (frame[c].to_numpy() for c in ("component", "n_shingles", "own"))
    marks = np.stack([np.frombuffer(x, np.uint8) for x in frame["sketch"]])
    keys = np.ascontiguousarray(marks[:, : marks.shape[1] // bands * bands]).view(f"V{marks.shape[1] // bands}")
    _, keys = np.unique(keys, return_inverse=True)  # equal band values as equal numbers
    keys = keys.reshape(len(frame), bands)
    least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / marks.shape[1])
    band, both = int(frame["at"].iloc[0]), key[1] != key[2]
    for i in range(len(frame)):
        rest = np.arange(i + 1, len(frame))
        rest = rest[(part[rest] != part[i]) & (np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]))]
        if both:
            rest = rest[chunk[rest] != chunk[i]]
        if len(rest) and band:
            rest = rest[~(keys[rest, :band] == keys[i, :band]).any(axis=1)]
        if not len(rest):
            continue
        found = joint_similarity(np.broadcast_to(marks[i], (len(rest), marks.shape[1])), marks[rest], np.full(len(rest), size[i]), size[rest])
        likely = np.flatnonzero(found >= least)
        if len(likely):
            yield i, rest[likely[np.argsort(-found[likely], kind="stable")]]


def _likely_members(percent: int, bands: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        kept = np.zeros(len(frame), dtype=bool)
        for i, others in _partners(key, frame, percent, bands):
            kept[i] = True
            kept[others] = True
        return frame.loc[kept, ["band", "low", "high", "at", "own", "b", "component", "n_shingles"]]

    return run


def _tile(words: int, percent: int, bands: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        ids, part = frame["b"].to_numpy(), frame["component"].to_numpy()
        sets, offsets = shingle_sets(frame["text"].tolist(), words)
        links = []
        joined = {c: c for c in part.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        for i, others in _partners(key, frame, percent, bands):
            for j in others.tolist():
                x, y = root(int(part[i])), root(int(part[j]))
                if x != y and _similar(sets[offsets[i] : offsets[i + 1]], sets[offsets[j] : offsets[j + 1]], percent):
                    joined[max(x, y)] = min(x, y)
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(both) - common)


def _groups(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("node", "component")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be in one component."""
    return (
        pairs.join(groups.toDF("a", "ca"), "a", "left").join(groups.toDF("b", "cb"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    )
