"""Vector codes by Lloyd's algorithm in integers, one codebook for each part of the vectors.

Every round assigns parts to their nearest entry and replaces entries by the floor of their parts' mean. Between rounds a
vector keeps, part by part, its entry and the exact squared distance to it. A part whose entry did not move compares only
the moved entries against the stored distance: among the others its entry is still nearest, and of those equally near the
first. A part whose entry moved compares all entries. The state of a round is a stored table; codebooks, whose size does
not depend on the data, travel through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored

#: Components are integer multiples of 1 / SCALE.
SCALE = 1024

#: Integers of this size and above would not keep sums and squared distances exact.
LIMIT = 1 << 24


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; integers below 2^53, so exact in doubles."""
    return np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ entries.T) + np.einsum("ij,ij->i", entries, entries)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the parts ``x`` and their squared distances, and how many distances it took.

    ``code`` and ``far`` are those of the round before, when only ``moved`` entries differed; code -1 is none.
    """
    code, far = code.copy(), far.copy()
    whole = (code < 0) | moved[code]
    compared = 0
    if whole.any():
        d = distances(x[whole], entries)
        code[whole] = d.argmin(axis=1)
        far[whole] = d.min(axis=1)
        compared += d.size
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~whole)
    if len(active) and len(kept):
        d = distances(x[kept], entries[active])
        best = d.argmin(axis=1)
        value, entry = d[np.arange(len(kept)), best], active[best]
        nearer = (value < far[kept]) | ((value == far[kept]) & (entry < code[kept]))
        code[kept[nearer]], far[kept[nearer]] = entry[nearer], value[nearer]
        compared += d.size
    return code, far, compared


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), type=kind))


def integer_vectors(vectors: DataFrame, vector_col: str, parts: int) -> DataFrame:
    """``vectors`` with the integer components in ``ints``; rows that can have no code are left out."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where(F.coalesce(v.isNotNull() & sound & (F.size(v) > 0) & (F.size(v) % parts == 0), F.lit(False)))
    return kept.withColumn("ints", F.transform(v, lambda x: F.floor(x * SCALE)))


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> DataFrame:
    """(id, label, codes, distances, error, label_error, codebooks) of every vector: an entry number and a squared distance
    for each part, their sum, the sum of the errors of equal labels, and the final entries by part, entry and position.

    The codebooks start as the parts of the vectors with the smallest ids (null ids last, equal ids by their components); with
    fewer vectors than ``entries`` there are so many entries. Rows whose vector is null, empty, not divisible into parts,
    or holds null or non-finite components are left out, and so are those of another length than the first vector's.
    Null labels are one label. Repeated rows count as often as they stand. No vector gives no rows. Components of 2^24
    / ``SCALE`` (16,384) and above raise ``ValueError``, as sums would not stay exact. Columns not named are not looked at.
    """
    prepare(vectors.sparkSession)
    picked = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    table = stored(integer_vectors(picked, "vector", parts).select("id", "label", "ints"), "codes-ints")
    order = [F.col("id").asc_nulls_last(), F.col("ints")]
    first = table.orderBy(*order).limit(1).collect()
    width = len(first[0].ints) if first else parts
    table = table.where(F.size("ints") == width)
    largest = table.select(F.max(F.array_max(F.transform("ints", lambda x: F.abs(x))))).first()[0] or 0
    if largest >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} and above have no exact codes")
    start = [r.ints for r in table.orderBy(*order).limit(entries).collect()]
    books = np.array(start, dtype=np.float64).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()

    state = table.select("id", "label", "ints", F.array_repeat(F.lit(-1), parts).alias("codes"), F.array_repeat(F.lit(0).cast("long"), parts).alias("distances"))
    previous, moved, written = table, np.ones(books.shape[:2], dtype=bool), []
    for k in range(rounds + 1):
        state = stored(_assigned(state, books, moved), "codes-state")
        discard(previous)
        previous = state
        if k < rounds:
            renewed = _renewed(state, books)
            moved = (renewed != books).any(axis=2)
            books = renewed

    errors = state.withColumn("error", F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x)).drop("ints")
    by_label = errors.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    text = ",".join(str(int(v)) for v in books.ravel())
    out = errors.join(by_label, F.col("label").eqNullSafe(F.col("same"))).drop("same").withColumn("codebooks", F.lit(text))
    return out.withColumnsRenamed({"id": id_col, "label": label_col})


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """One assignment; the ints travel through unchanged."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("ints"), parts * size).astype(np.float64)
            codes = _matrix(batch.column("codes"), parts).astype(np.int64)
            far = _matrix(batch.column("distances"), parts).astype(np.float64)
            for p in range(parts if len(x) else 0):
                codes[:, p], far[:, p], _ = assign(x[:, p * size : (p + 1) * size], books[p], moved[p], codes[:, p], far[:, p])
            new = [_rows(codes.astype(np.int32), pa.int32()), _rows(far.astype(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("ints"), *new], names=["id", "label", "ints", "codes", "distances"])

    return state.mapInArrow(run, state.schema)


def _renewed(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean; every task sends one row of sums for each entry it met."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, size), dtype=np.int64)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("ints"), parts * size)
            codes = _matrix(batch.column("codes"), parts)
            for p in range(parts if len(x) else 0):
                np.add.at(sums[p], codes[:, p], x[:, p * size : (p + 1) * size])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), _rows(sums[part, entry].reshape(-1, size), pa.int64())],
            names=["part", "entry", "n", "sums"],
        )

    met = state.select("ints", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = met.select("part", "entry", "n", F.posexplode("sums").alias("at", "total"))
    rows = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = books.copy()
    for r in rows:  # one row for each component of the codebooks
        out[r.part, r.entry, r.at] = r.total // r.n
    return out


def digest_of(codebooks: str) -> str:
    return hashlib.sha256(codebooks.encode()).hexdigest()
