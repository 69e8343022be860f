"""Byte-level BPE by overlapping chunks: long texts are cut anywhere, scanned in parallel and stitched.

A text of at most ``CHUNK`` characters is encoded where it lies. A longer one is cut into chunks that overlap their
successor; every chunk is split into pre-tokens from its first character on, wherever that falls. Two scans that share
one pre-token boundary agree from there on, as the pattern never looks back; so the first boundary that a chunk's tail has
in common with the head of the next chunk is where the next one takes over; a boundary behind white space is passed over, as a piece
that ends there would split its last white space otherwise. The pieces between these seams are encoded in parallel and
their ids put one after the other. A text with a seam at which the scans share no boundary (one
pre-token longer than the overlap) is cut again into longer chunks, until its seams hold or it is one chunk.

Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Characters of a chunk, and those of its successor that it also reads.
CHUNK, OVERLAP = 1 << 15, 1 << 10

#: Growth of both for texts whose seams do not hold.
GROWTH = 8

#: A match that ends this close to the end of a cut text may be another one in the whole text ("'l" of "'ll").
MARGIN = 2

_KEY = "__bpe_key"


class Coder:
    """Encoder, decoder and pre-tokeniser of one ranks file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._regex, self._pattern = regex, public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("ranks", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {k: v for v, k in ranks.items()}
        self._plain = regex.compile(self._pattern)
        self._other = None

    def encode(self, text: str) -> np.ndarray:
        """Ids of all pre-tokens of a text."""
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:  # the library's matcher gives up on very long runs of white space
            ids = [i for m in self.matcher(text).finditer(text) for i in self.encoding._encode_single_piece(m.group())]
            return np.asarray(ids, dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def matcher(self, text: str):
        """The pattern with the classes of characters that the encoder itself knows."""
        if text.isascii():
            return self._plain
        if self._other is None:
            self._other = self._agreeing()
        disputed, pattern = self._other
        return pattern if disputed is not None and disputed.search(text) else self._plain

    def _agreeing(self):
        """Letters and digits depend on the Unicode version; the encoder is asked about those that are not old ones.

        Its answer shows in the ids of a made-up vocabulary: a letter joins the letter before it in one pre-token, and only
        then its first byte can merge with that letter.
        """
        import tiktoken

        every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
        wrong = {}
        for group, mark in (("L", b"x"), ("N", b"1")):
            mine = set(self._regex.findall(rf"\p{{{group}}}", every))
            asked = sorted(c for c in every if (c in mine) != (unicodedata.category(c)[0] == group))
            ranks = {bytes([b]): b for b in range(256)} | {mark + bytes([b]): 256 + b for b in range(256)}
            probe = tiktoken.Encoding("probe", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
            ids = probe.encode_to_numpy("".join(f"{mark.decode()}{c}" for c in asked), disallowed_special=())
            joined = ids[(ids == mark[0]) | (ids >= 256)] >= 256
            theirs = {c for c, j in zip(asked, joined) if j}
            wrong[group] = (theirs - mine, (set(asked) & mine) - theirs)
        if not any(a or b for a, b in wrong.values()):
            return None, self._plain

        def group(name: str) -> str:
            more, less = wrong[name]
            return f"[[\\p{{{name}}}{_ranges(more)}]--[{_ranges(less) or chr(0xFFFF)}]]"

        letter, number = group("L"), group("N")
        text = self._pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letter}{number}]")
        text = text.replace(r"\p{L}+", f"{letter}+").replace(r"\p{N}+", f"{number}+")
        disputed = "".join(_ranges(s) for pair in wrong.values() for s in pair)
        return self._regex.compile(f"[{disputed}]"), self._regex.compile(text, flags=self._regex.V1)

    def boundaries(self, text: str, complete: bool) -> np.ndarray:
        """Ends of the pre-tokens, and 0; only the certain ones if the text goes on behind its end."""
        ends = np.fromiter((m.end() for m in self.matcher(text).finditer(text)), dtype=np.int64)
        ends = np.concatenate([np.zeros(1, dtype=np.int64), ends])
        return ends if complete else ends[ends <= len(text) - MARGIN]


def _ranges(characters: set[str]) -> str:
    points = np.array(sorted(map(ord, characters)), dtype=np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1) if len(points) else []
    return "".join(f"\\U{r[0]:08X}-\\U{r[-1]:08X}" for r in runs)


@lru_cache(maxsize=4)
def coder(path: str | None = None) -> Coder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Coder(path)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _encoder(ranks: str | None):
    @F.arrow_udf("array<int>")
    def encode(text: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), begin.to_pylist(), end.to_pylist())
        return _lists([coder(ranks).encode(t[b:e]) for t, b, e in rows], pa.int32())

    return encode


def encode_documents(
    docs: DataFrame, text_col: str = "text", as_column: str = "ids", ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with the token ids of every whole text in ``as_column``.

    Equal to the ids that the tiktoken library gives with ``public_tokenizers.PATTERN`` and the ranks file, without special
    tokens; texts on whose white space that library gives up are encoded all the same. A null text counts as empty and has
    no ids; repeated rows stay, each with its ids; an empty table gives an empty one; ids of rows are not looked at. A column
    of the name of ``as_column`` is replaced. Texts have any length: tasks hold one chunk at a time, but a text itself and
    its ids are one row at the start and at the end.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(as_column) if as_column != text_col else docs
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    encode = _encoder(ranks)
    whole = docs.where(F.length(text) <= chunk).withColumn(as_column, encode(text, F.lit(0), F.lit(chunk)))
    cut = docs.where(F.length(text) > chunk).withColumn(_KEY, F.sha2(text, 256))
    ids = _encode_long(cut.select(F.col(_KEY).alias("key"), text.alias("text")), encode, ranks, chunk, overlap)
    ids = ids.select(F.col("key").alias(_KEY), F.col("ids").alias(as_column))
    return whole.unionByName(cut.join(ids, _KEY).drop(_KEY))


def _encode_long(texts: DataFrame, encode, ranks: str | None, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of all different texts, cut into chunks; copies are cut but scanned and encoded once."""
    pieces = None
    while True:
        chunks = stored(_scanned(texts, ranks, chunk, overlap), "bpe-chunks")
        seams = stored(_seams(chunks), "bpe-seams")
        open_keys = seams.where("open").select("key").distinct()
        again = not open_keys.isEmpty()
        held = seams.join(open_keys, "key", "left_anti") if again else seams
        here = chunks.select("key", "part", "text").join(held.select("key", "part", "begin", "seam"), ["key", "part"])
        last = F.coalesce(F.lit(chunk) + F.col("seam"), F.lit(chunk + overlap))
        here = here.select("key", "part", encode("text", "begin", last).alias("ids"))
        pieces = here if pieces is None else pieces.unionByName(here)
        if not again:
            break
        texts = texts.join(open_keys, "key", "left_semi")
        chunk, overlap = chunk * GROWTH, overlap * GROWTH
    in_order = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return pieces.groupBy("key").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def _scanned(texts: DataFrame, ranks: str | None, chunk: int, overlap: int) -> DataFrame:
    """Chunks with the boundaries of their own scan at both ends, as places behind their first and their last own character."""

    @F.arrow_udf("array<string>")
    def cut(text: pa.Array) -> pa.Array:
        rows = [[t[k : k + chunk + overlap] for k in range(0, len(t), chunk)] for t in text.to_pylist()]
        return pa.array(rows, type=pa.list_(pa.string()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                ends = coder(ranks).boundaries(text, complete=len(text) < chunk + overlap)
                heads.append(ends[ends < overlap])
                tails.append(np.array([e - chunk for e in ends[ends >= chunk] if not text[e - 1].isspace()], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(heads, pa.int32()), _lists(tails, pa.int32())], names=[*batch.schema.names, "head", "tail"])

    cuts = texts.select("key", F.posexplode(cut("text")).alias("part", "text"))
    once = cuts.groupBy("key", "part").agg(F.first("text").alias("text"))
    return once.mapInArrow(scan, "key string, part int, text string, head array<int>, tail array<int>")


def _seams(chunks: DataFrame) -> DataFrame:
    """Where every chunk takes over and hands on; ``open`` if it shares no boundary with its successor."""
    order = Window.partitionBy("key").orderBy("part")
    ends = chunks.select("key", "part", "tail", F.lead("head").over(order).alias("next"))
    seams = ends.select("key", "part", F.array_min(F.array_intersect("tail", "next")).alias("seam"), F.col("next").isNotNull().alias("goes_on"))
    return seams.select(
        "key", "part", F.coalesce(F.lag("seam").over(order), F.lit(0)).alias("begin"), "seam", (F.col("goes_on") & F.col("seam").isNull()).alias("open")
    )


def decode_ids(df: DataFrame, ids_col: str = "ids", as_column: str = "bytes", ranks: str | None = None) -> DataFrame:
    """``df`` with the concatenated raw bytes of each row's ids (binary); null ids give no bytes."""
    prepare(df.sparkSession)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_pylist() if len(ids) else []
        decoder = coder(ranks)
        return pa.array([decoder.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], type=pa.binary())

    return df.withColumn(as_column, decode(_no_nulls(F.col(f"`{ids_col}`"))))


def _no_nulls(ids: Column) -> Column:
    return F.coalesce(ids, F.array().cast("array<int>"))
