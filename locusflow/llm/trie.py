"""Prefix trie of conversations, its subtree totals by time-forward processing.

Conversations become rows (conversation, depth) that carry a 128-bit sum over the turns so far, each mixed with its depth;
rows of one depth and sum are a node. Numbers and sums inside a conversation are taken per block of a range-partitioned
sort and shifted by the blocks before, so that no task holds a conversation.

Totals flow from the leaves up. Nodes of a single conversation form chains with one leaf and nothing to save; they are
folded into a count at the node above before anything is sorted. The remaining nodes belong to shards: a node whose
members have more than ``SHARD_TURNS`` turns below it is on top, every other one belongs to the subtree of its topmost
ancestor below those. Each shard is sorted by falling depth and read once; a node takes what its children
have put into a priority queue and puts its own total there for its parent. What shard roots pass on is added up by
receiver, and the nodes on top are read the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_rows
from .common import discard, prepare, stored

#: A node with more turns of its members below it than this is handled on top, the others in shards.
SHARD_TURNS = 200_000

#: Messages that a queue holds in memory, and records that it reads back at once from each of its runs.
QUEUE_MESSAGES, RUN_RECORDS = 200_000, 1_000

#: Bytes of the decimal ids that travel as one row when the ids of a node are hashed.
BLOCK_BYTES = 1 << 16

_LIMB = (1 << 32) - 1
_WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Priority queue of (key, values) whose sorted runs leave memory when it grows beyond a limit.

    Runs are anonymous files of the task, gone with it.
    """

    def __init__(self, limit: int = QUEUE_MESSAGES) -> None:
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, key: tuple, *values: int) -> None:
        heapq.heappush(self.heap, (key, values))
        if len(self.heap) >= self.limit:
            self._spill()

    def _spill(self) -> None:
        folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
        file = tempfile.TemporaryFile(dir=folders[0] if os.path.isdir(folders[0]) else None)
        self.heap.sort()
        for k in range(0, len(self.heap), RUN_RECORDS):
            pickle.dump(self.heap[k : k + RUN_RECORDS], file)
        file.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        run = self._records(file)
        self.runs.append([next(run), run])

    @staticmethod
    def _records(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def take(self, key: tuple) -> Iterator[tuple]:
        """Values of all messages to ``key``; keys are asked for in rising order."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        for run in self.runs:
            while run[0] is not None and run[0][0] == key:
                yield run[0][1]
                run[0] = next(run[1], None)
        if any(run[0] is None for run in self.runs):
            self.runs = [run for run in self.runs if run[0] is not None]


def _limbs(value: Column) -> list[Column]:
    """Four 32-bit numbers of a hexadecimal digest."""
    return [F.conv(F.substring(value, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _key(sums: list[Column]) -> list[Column]:
    low = [s.bitwiseAND(F.lit(_LIMB)) for s in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b")]


def _blocked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``block``: rows of a group stand in consecutive blocks, in order; a large group takes many."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    df = stored(df, f"{name}-unsorted")  # the bounds of the ranges are sampled from it, and texts are read once
    blocks = stored(df.repartitionByRange(n, F.col(group), *order).withColumn("block", F.spark_partition_id()), name)
    discard(df)
    return blocks


def _running(df: DataFrame, group: str, order: list[Column], sums: list[str]) -> DataFrame:
    """Running sums of the columns in ``sums`` over each group, from totals of blocks and windows inside one block."""
    inside = Window.partitionBy(group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, "block").agg(*[F.sum(s).alias(s) for s in sums])
    shifts = totals.select(group, "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums])
    here = df.withColumns({s: F.sum(s).over(inside) for s in sums})
    out = here.join(shifts, [group, "block"]).withColumns({s: F.col(s) + F.col(f"{s}_before") for s in sums})
    return out.drop(*[f"{s}_before" for s in sums])


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, rank from 1, digest, words) of every turn; null turns first, equal ones by the digest of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("rank"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    return _running(_blocked(rows, "conv_id", order, "trie-turns"), "conv_id", order, ["rank"]).select("conv_id", "rank", "digest", "words")


def rebuilt_turns(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (conv_id, depth, digest, words) and (conv_id, length), turnless ones included.

    Conversation c starts with the first h turns of c - c % ``every`` and goes on with its own behind the first h;
    h is the crc32 of the decimal id modulo ``most``.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", h.alias("h"), "own", (c - c % every).alias("base"))
    heads = turns.where(F.col("rank") < most).groupBy(c.alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "digest", "words"))).alias("head")
    )  # at most ``most`` - 1 turns
    head = F.filter(F.coalesce(F.col("head"), F.array()), lambda x: x["rank"] <= F.col("h"))
    plan = ids.join(heads, "base", "left").withColumn("head", head).select(
        "conv_id", "h", "head", F.size("head").cast("long").alias("shared"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest")
    )
    shared = plan.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.rank").alias("depth"), "x.digest", "x.words")
    own = turns.where(F.col("rank") > h).join(plan.select("conv_id", "h", "shared"), "conv_id")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("shared")).alias("depth"), "digest", "words")
    return shared.unionByName(own), plan.select("conv_id", (F.col("shared") + F.col("rest")).alias("length"))


def prefix_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, words, length): each row's node, and the node above."""
    mixed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.col("digest")))
    rows = turns.select("conv_id", "depth", "words", *[x.alias(f"s{k}") for k, x in enumerate(_limbs(mixed))])
    rows = rows.select("*", *[F.col(f"s{k}").alias(f"v{k}") for k in range(4)])
    order = [F.col("depth")]
    rows = _running(_blocked(rows, "conv_id", order, "trie-rows"), "conv_id", order, [f"s{k}" for k in range(4)])
    sums, own = ([F.col(f"{n}{k}") for k in range(4)] for n in "sv")
    above = [x.alias(n) for x, n in zip(_key([s - v for s, v in zip(sums, own)]), ("pa", "pb"))]
    return rows.select("conv_id", "depth", *_key(sums), *above, "words").join(lengths, "conv_id")


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): hash of the rising decimal ids that end at a node; ids stream through, also those of a
    node that holds most of them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("depth", "a", "b", "conv_id")]
            for d, a, b, c in zip(*columns):
                if (d, a, b) != node or size >= BLOCK_BYTES:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (d, a, b), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out, ["depth", "a", "b", "first", "ids"])
            out = []
        if ids:
            yield _batch([(*node, first, ",".join(ids))], ["depth", "a", "b", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*[batch.column(n).to_pylist() for n in ("depth", "a", "b", "ids")]):
                if (d, a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (d, a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _batch(out, ["depth", "a", "b", "ends_sha256"])
        if node:
            yield _batch([(*node, digest.hexdigest())], ["depth", "a", "b", "ends_sha256"])

    keys = ["depth", "a", "b"]
    rows = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    packed = rows.mapInArrow(blocks, "depth long, a long, b long, first long, ids string")
    return packed.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashes, "depth long, a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("ids", "ends_sha256") else pa.int64() for n in names]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


_TOTALS = "depth long, a long, b long, pa long, pb long, inside boolean, n_leaves long, saved_tokens long"


def _forward(nodes: DataFrame, queue_limit: int) -> DataFrame:
    """Subtree totals of all nodes of each ``shard``; partitions hold whole shards.

    ``leaves`` and ``saved`` are a node's own part of the totals, with what came from other shards; ``inside`` nodes pass
    theirs on to a node of the same shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_limit)
        for batch in batches:
            leaves, saved = batch.column("leaves").to_pylist(), batch.column("saved").to_pylist()
            columns = [batch.column(n).to_pylist() for n in ("shard", "depth", "a", "b", "pa", "pb", "inside")]
            for k, (shard, depth, a, b, above_a, above_b, inside) in enumerate(zip(*columns)):
                for more_leaves, more_saved in queue.take((shard, -depth, a, b)):
                    leaves[k] += more_leaves
                    saved[k] += more_saved
                if inside:
                    queue.push((shard, 1 - depth, above_a, above_b), leaves[k], saved[k])
            kept = [batch.column(n) for n in ("depth", "a", "b", "pa", "pb", "inside")]
            totals = [pa.array(leaves, type=pa.int64()), pa.array(saved, type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *totals], names=["depth", "a", "b", "pa", "pb", "inside", "n_leaves", "saved_tokens"])

    columns = nodes.select("shard", "depth", "a", "b", "pa", "pb", "inside", "leaves", "saved")
    return columns.sortWithinPartitions("shard", F.col("depth").desc(), "a", "b").mapInArrow(run, _TOTALS)


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard_turns: int = SHARD_TURNS, queue_limit: int = QUEUE_MESSAGES) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens) of all nodes of several conversations, and of the root."""
    key = ["depth", "a", "b"]
    shared = nodes.where((F.col("n_convs") > 1) | (F.col("depth") == 0)).select(
        *key, "pa", "pb", "conv_id", "below",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_single")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    on_top = (F.col("below") > shard_turns) | (F.col("depth") == 0)
    top = shared.where(on_top)
    path = rows.select("conv_id", *key)
    cuts = path.join(broadcast_if_rows(top.select(*key), top.count()), key).groupBy("conv_id").agg(F.max("depth").alias("cut"))
    first = path.join(cuts, "conv_id", "left").where(F.col("depth") == F.coalesce(F.col("cut"), F.lit(0)) + 1)
    first = first.select("conv_id", F.col("a").alias("ra"), F.col("b").alias("rb"))
    light = shared.where(~on_top).join(first, "conv_id").withColumns(
        {"shard": F.xxhash64("ra", "rb"), "inside": (F.col("a") != F.col("ra")) | (F.col("b") != F.col("rb"))}
    )
    low = stored(_forward(light.repartition("shard"), queue_limit), "trie-totals")
    passed = low.where(~F.col("inside")).groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
    )
    own = top.join(passed, key, "left").withColumns(
        {
            "leaves": F.col("leaves") + F.coalesce(F.col("more_leaves"), F.lit(0)), "saved": F.col("saved") + F.coalesce(F.col("more_saved"), F.lit(0)),
            "shard": F.lit(0).cast("long"), "inside": F.col("depth") > 0,
        }
    )
    high = _forward(own.repartition("shard"), queue_limit)
    return low.unionByName(high).select(*key, "n_leaves", "saved_tokens")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    every: int = 20, most: int = 4, shard_turns: int = SHARD_TURNS, queue_limit: int = QUEUE_MESSAGES,
) -> DataFrame:
    """One row per node of the trie of all conversations, rebuilt with shared heads (:func:`rebuilt_turns`).

    Columns, all long but the last: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, members beyond the first times words of the last text), ends_sha256 of the
    members that end here. Nodes are told apart by 128-bit sums of hashes of role and text.

    Turns are ordered by number, null first, and equal ones by a hash of role and text; a null role or text is
    empty; repeated rows are turns of their own. Rows without conversation id belong to no conversation and are left out. No
    conversation gives no rows, not even a root. Columns not named are not looked at. A node that a third of all
    conversations pass through is one row behind map-side sums; ids that end in one node are hashed as a stream.
    """
    prepare(conversations.sparkSession)
    key = ["depth", "a", "b"]
    turns = stored(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-numbered")
    steps, lengths = rebuilt_turns(turns, every, most)
    lengths = stored(lengths, "trie-lengths")
    rows = stored(prefix_rows(steps, lengths), "trie-prefixes")
    zero = F.lit(0).cast("long")
    members = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")]
    below = F.sum(F.col("length") - F.col("depth") + 1).alias("below")
    inner = rows.groupBy(*key).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"), *members, below)
    root = lengths.withColumn("depth", zero).agg(*members, below).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        zero.alias("words"), "n_convs", "conv_id", "below",
    )
    nodes = stored(inner.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("n_single")
    )
    nodes = stored(nodes.join(children, key, "left").na.fill(0, ["n_children", "n_single"]), "trie-nodes-children")
    ends = rows.where("depth = length").select(*key, "conv_id").unionByName(
        lengths.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    smallest = lengths.agg(F.min("conv_id")).first()[0]
    top = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")))
    deep = nodes.where("depth > 1").join(above.where("depth > 1"), ["depth", "pa", "pb"])
    totals = subtree_totals(nodes, rows, shard_turns, queue_limit)
    full = top.unionByName(deep).join(totals, key, "left").join(_ends_hashes(ends), key, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce(F.col("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.col("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.col("ends_sha256"), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
