"""Packing of whole documents into training sequences of bounded length.

Texts are tokenised where they lie; only piece lengths travel. Groups of bounded size are packed best-fit by
decreasing length and improved by a local search that moves documents or exchanges one for one and two for one
between underfull sequences whenever the sum of squared fills grows, until sequences run empty. What stays
underfull in all groups is packed again in fewer groups, level by level.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Pieces packed together by one task.
GROUP_PIECES = 2500

#: Donors per sequence to be spared, and receivers, that a sweep of the local search looks at.
DONORS, RECEIVERS = 8, 128

#: Share of a group's sequences, the least filled ones, that are handed to the next level; more if they have no more than
#: that share of its pieces. The least filled one always goes.
REOPENED = 20

#: Texts with other characters than these, or with longer unbroken runs, take the tokenizer's own code.
_PLAIN_LIMIT, _LONGEST_RUN = 0x250, 500

_encoders: dict[str, object] = {}


class Encoder:
    """Token ids of the byte-level BPE file.

    ``byte_bpe_50k.json`` defines the ids. Its ranks file gives the same ids several times faster, and is used for
    texts of Latin letters, which tests compare; every other text goes through the tokenizer itself, as does one
    that spells a special token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and self._plain(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype="<u4")
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _plain(self, text: str) -> bool:
        if not text:
            return True
        if not text.isascii() and ord(max(text)) >= _PLAIN_LIMIT:
            return False
        return max(map(len, text.split()), default=0) <= _LONGEST_RUN and not any(s in text for s in self.special)


def encoder(path: str | None = None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """A document that fits is one piece; a longer one has full pieces, the first taking the remainder."""
    if tokens <= capacity:
        return [tokens]
    rest = tokens % capacity
    return ([rest] if rest else []) + [capacity] * (tokens // capacity)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, closed by id 0."""
    # Ids pass Python as text, so that a null does not turn the others into floating numbers.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                raw = coder.ids(text).tobytes() + b"\0\0\0\0"
                start = 0
                for k, length in enumerate(piece_lengths(len(raw) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start += length
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Sequences of one group: member lists and fills."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.members, self.fill = capacity, [], []

    def new(self, members: list[int], fill: int) -> None:
        self.members.append(members)
        self.fill.append(fill)


def best_fit(lengths: list[int], capacity: int) -> _Bins:
    """Longest first, each into the fullest sequence with room."""
    bins = _Bins(capacity)
    room: list[tuple[int, int]] = []  # sorted (free, sequence)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(room, (lengths[k], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins.members[b].append(k)
            bins.fill[b] += lengths[k]
        else:
            b, free = len(bins.fill), capacity
            bins.new([k], lengths[k])
        if free > lengths[k]:
            insort(room, (free - lengths[k], b))
    return bins


def improve(bins: _Bins, lengths: list[int]) -> None:
    """Local search: empty the least filled sequences into the free space of the others.

    A donor's document x moves into a receiver with room for it, or is exchanged for one shorter document (or for
    two whose sum is shorter) of a receiver that has room for the difference. The receiver, at least as full as the
    donor, gains what the donor loses, so the sum of squared fills grows with every step and the search ends. Donors
    are the least filled sequences, some more than the total of tokens could spare, so that space also gathers in
    sequences about to be emptied; receivers those with most space. With none to spare the packing is already best.
    """
    capacity, members, fill = bins.capacity, bins.members, bins.fill
    fewest_left = fewest(lengths, capacity)
    changed = True
    while changed:
        changed = False
        used = sorted((b for b in range(len(fill)) if members[b]), key=lambda b: (fill[b], b))
        spare = len(used) - fewest_left
        if spare <= 0:
            return
        for donor in used[: DONORS * (spare + 1)]:
            receivers = [b for b in used[:RECEIVERS] if b != donor and members[b] and fill[donor] <= fill[b] < capacity][::-1]
            for x in sorted(members[donor], key=lambda k: (-lengths[k], k)):
                step = _best_step(bins, lengths, x, receivers)
                if step is None:
                    continue
                gain, receiver, back = step
                members[donor].remove(x)
                members[receiver].append(x)
                for y in back:
                    members[receiver].remove(y)
                    members[donor].append(y)
                fill[donor] -= gain
                fill[receiver] += gain
                changed = True


def _best_step(bins: _Bins, lengths: list[int], x: int, receivers: list[int]) -> tuple | None:
    """The move or exchange of ``x`` that leaves the least free space in its receiver: (gain, receiver, returned)."""
    best, left = None, bins.capacity
    for receiver in receivers:
        free = bins.capacity - bins.fill[receiver]
        if not free:
            continue
        if lengths[x] <= free:
            step = (lengths[x], receiver, ())
        else:
            step = _exchange(lengths, bins.members[receiver], lengths[x], free, receiver)
        if step and free - step[0] < left:
            best, left = step, free - step[0]
            if not left:
                break
    return best


def _exchange(lengths: list[int], held: list[int], x: int, free: int, receiver: int) -> tuple | None:
    """Documents to take back for one of ``x`` tokens: the largest gain that ``free`` allows."""
    best = None
    for i, y in enumerate(held):
        gain = x - lengths[y]
        if 0 < gain <= free and (best is None or gain > best[0]):
            best = (gain, receiver, (y,))
        if gain > free:
            for z in held[i + 1 :]:
                two = gain - lengths[z]
                if 0 < two <= free and (best is None or two > best[0]):
                    best = (two, receiver, (y, z))
    return best


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``."""
    bins = best_fit(lengths, capacity)
    improve(bins, lengths)
    return [m for m in bins.members if m]


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _packer(base: int, last: bool, capacity: int, group_pieces: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one group; its least filled sequences are marked open unless this is the last level."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, ignore_index=True, na_position="last")
        found = pack(frame["length"].tolist(), capacity)
        order = np.fromiter((k for m in found for k in m), dtype=np.int64, count=len(frame))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        out = frame.iloc[order].reset_index(drop=True)
        number = np.repeat(np.arange(len(found)), sizes)
        lengths = out["length"].to_numpy()
        before = np.cumsum(lengths) - lengths
        first = np.cumsum(sizes) - sizes
        fills = np.add.reduceat(lengths, first)
        out["sequence_id"] = base + (int(key[0]) << 28) + number
        out["offset"] = before - np.repeat(before[first], sizes)
        least = np.argsort(fills, kind="stable")
        handed = np.zeros(len(fills), dtype=bool)
        few = (np.arange(len(fills)) < max(1, len(fills) // REOPENED)) | (np.cumsum(sizes[least]) <= group_pieces // REOPENED)
        handed[least] = few & (fills[least] < capacity) & (not last)
        out["open"] = np.repeat(handed, sizes)
        return out[[*_PIECE, "sequence_id", "offset", "open"]]

    return run


_PLACED = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Documents longer than ``capacity`` are cut; no other one is, and no
    token is left out. Rows with repeated or null ids are packed as documents of their own. An empty table gives no rows.
    Pieces are dealt to groups by a hash of all their columns, so a group has a mix of lengths and its size
    follows from the number of pieces; full pieces skip the search. After each level every group hands its least filled
    sequence, and others up to a twentieth of its sequences or pieces, to the next level, until one group is left. Groups
    at least halve with every level: where the handed sequences hold many short pieces, a group grows to those of some
    sequences, which ``capacity`` bounds.
    """
    spark = docs.sparkSession
    prepare(spark)
    todo = stored(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    columns = _PIECE
    full = todo.where(F.col("length") == capacity)
    done = [full.select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo = todo.where(F.col("length") < capacity)
    count, level = todo.count(), 0
    groups = -(-count // group_pieces)
    while count:
        level += 1
        base = -(level << 56)  # negative numbers; full pieces have those from 0 up

        keyed = todo.withColumn("__group", F.pmod(F.xxhash64(*columns, F.lit(level)), F.lit(max(1, groups))))
        placed = stored(
            keyed.groupBy("__group").applyInPandas(_packer(base, groups <= 1, capacity, group_pieces), _PLACED),
            f"packed-{level}",
        )
        done.append(placed.where("not open").drop("open"))
        if groups <= 1:
            break
        todo = placed.where("open").select(*columns)
        count = todo.count()
        groups = min(-(-count // group_pieces), -(-groups // 2))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(out.columns))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def fewest(lengths: list[int], capacity: int) -> int:
    """Lower bound on the number of sequences."""
    return -(-sum(lengths) // capacity)


__all__ = ["best_fit", "encoder", "fewest", "improve", "pack", "pack_documents", "piece_lengths", "pieces"]
