"""Helpers of the corpus operators: vectorised words and hashes, folds, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Rows per Arrow batch; long texts then keep a batch at a few MB.
BATCH_ROWS = "1000"

#: Bytes of text hashed at once; a longer single word extends a piece.
PIECE_BYTES = 1 << 21

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: results of costly passes survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing reads any more; does nothing for any other table."""
    path = getattr(df, "_stored_path", None)
    if path is not None:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_MULTIPLIER, k, 1 << 64))])
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, k, 1 << 64))])
    return _powers[:n], _inverses[:n]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))

#: True for the bytes that separate words in ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _hash_piece(piece: bytes, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(piece, dtype=np.uint8)
    inside = np.concatenate([[False], ~is_space[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    powers, inverses = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * powers[:-1], out=sums[1:])
    values = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(values + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(texts: Sequence[str | None], is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all A-Z-lowered words, and the offsets of each text's words (len(texts) + 1)."""
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    out: list[np.ndarray] = []
    buffer: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not buffer:
            return
        joined = b" ".join(buffer)
        lengths = np.fromiter(map(len, buffer), dtype=np.int64, count=len(buffer))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        hashes, starts, _ = _hash_piece(joined, is_space)
        out.append(hashes)
        where = np.searchsorted(begins, starts, side="right") - 1
        np.add.at(counts, np.asarray(owners, dtype=np.int64)[where] + 1, 1)
        buffer.clear()
        owners.clear()
        held = 0

    for k, text in enumerate(texts):
        data = as_bytes(text).lower()
        for part in _cut(data, is_space):
            buffer.append(part)
            owners.append(k)
            held += len(part) + 1
            if held >= PIECE_BYTES:
                flush()
    flush()
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), np.cumsum(counts)


def _cut(data: bytes, is_space: np.ndarray) -> Iterator[bytes]:
    """Pieces of a long text, cut at separators only."""
    if len(data) <= PIECE_BYTES:
        yield data
        return
    gaps = np.flatnonzero(is_space[np.frombuffer(data, dtype=np.uint8)])
    at = 0
    while len(data) - at > PIECE_BYTES:
        k = int(np.searchsorted(gaps, at + PIECE_BYTES))
        if k == len(gaps):
            break
        yield data[at : gaps[k]]
        at = int(gaps[k])
    yield data[at:]


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


#: Bits of a membership map; its size does not depend on the data.
MAP_BITS = 1 << 24


def membership_map(keys: DataFrame, column: str) -> np.ndarray:
    """Fixed-size bit map (2 MB of 64-bit words) of 64-bit keys: a cheap filter in tasks before an exact join."""
    place = F.col(column).bitwiseAND(F.lit(MAP_BITS - 1))
    words = (
        keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in the map."""
    at = keys.view(np.uint64) & np.uint64(MAP_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def row_keys(id_column: str, text_column: str) -> tuple[Column, Column]:
    """Two hashes that name a row by id and text, equal for repeated rows; nulls are told apart from empty text."""
    parts = [F.col(id_column).cast("string"), F.col(text_column).cast("string"), F.col(id_column).isNull(), F.col(text_column).isNull()]
    return F.xxhash64(*parts), F.hash(*parts)
