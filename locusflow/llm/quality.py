"""Quality of texts by a factorisation machine.

Features are hashed words, binned statistics of a text's structure and binned numeric metadata. Besides its weight each
feature has a short vector, and every pair of features interacts by the product of their vectors; the sum over all
pairs equals half the difference between the squared sum and the sum of squares, so scoring is linear in the features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, doc_of, fold, hash_words, prepare

#: Hashed words, length of a feature's vector, bins of a statistic.
WORDS, RANK, BINS = 1 << 15, 8, 8

#: Labelled rows a model is fitted on at most.
MAX_TRAIN = 8000

#: Passes over the sample, rows of a gradient step, step size, shrinkage.
EPOCHS, STEP_ROWS, RATE, SHRINK = 12, 128, 0.1, 1e-4

STATISTICS = (
    "log characters", "log words", "characters per word", "upper case", "digits", "symbols", "sentence marks", "line ends",
    "other than ASCII", "different words", "most frequent word", "words of up to 2 bytes", "words over 12 bytes", "repeated lines", "empty lines",
)

# Byte classes: 0 other, 1 upper case, 2 lower case, 3 digit, 4 sentence mark, 5 symbol, 6 blank, 7 line end, 8 not ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7
_CLASS[128:] = 8


def statistics(texts: Sequence[str | None], words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Matrix (texts x STATISTICS)."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for k, text in enumerate(texts):
        data = as_bytes(text)
        if not data:
            continue
        n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
        own = words[at[k] : at[k + 1]]
        counts = np.unique(own, return_counts=True)[1]
        w = max(len(own), 1)
        lengths = np.fromiter(map(len, data.split()), dtype=np.int64)
        lines = text.split("\n")
        full = [x for x in lines if x.strip()]
        out[k] = (
            np.log1p(len(data)), np.log1p(len(own)), len(data) / w, n[1] / max(n[1] + n[2], 1), n[3] / len(data), n[5] / len(data), n[4] / len(data),
            n[7] / len(data), n[8] / len(data), len(counts) / w, counts.max(initial=0) / w, (lengths <= 2).sum() / w, (lengths > 12).sum() / w,
            1 - len(set(full)) / max(len(full), 1), 1 - len(full) / len(lines),
        )
    return out


def word_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and values of the hashed words (unit rows of logarithmic counts), and statistics."""
    words, at = hash_words(texts)
    cells, counts = np.unique(doc_of(at) * WORDS + (words >> np.uint64(49)).astype(np.int64), return_counts=True)
    rows, columns = cells // WORDS, cells % WORDS
    values = np.log1p(counts)
    norm = np.sqrt(np.bincount(rows, weights=values * values, minlength=len(texts)))
    return rows, columns, values / np.maximum(norm[rows], 1e-12), statistics(texts, words, at)


def dense(stats: np.ndarray, metadata: np.ndarray) -> np.ndarray:
    """Statistics and metadata side by side; a missing number stays missing."""
    return np.hstack([stats, np.sign(metadata) * np.log1p(np.abs(metadata))])


@dataclass
class QualityModel:
    """Bias, weights and vectors of all features, and the bin edges of the dense ones."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    edges: np.ndarray

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        """Feature numbers of the binned columns; a missing number has a bin of its own."""
        out = np.empty(numbers.shape, dtype=np.int64)
        for c in range(numbers.shape[1]):
            found = np.searchsorted(self.edges[c], numbers[:, c], side="right")
            out[:, c] = WORDS + c * (BINS + 1) + np.where(np.isnan(numbers[:, c]), BINS, found)
        return out

    def raw(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Model output before the logistic function, and the sums of vectors; rows ascending."""
        n = np.bincount(rows, minlength=count)
        first = np.cumsum(n) - n
        some = n > 0
        weighted = self.vectors[columns] * values[:, None]
        sums, squares, linear = np.zeros((count, RANK)), np.zeros(count), np.zeros(count)
        if len(rows):
            sums[some] = np.add.reduceat(weighted, first[some], axis=0)
            squares[some] = np.add.reduceat((weighted * weighted).sum(axis=1), first[some])
            linear[some] = np.add.reduceat(self.weights[columns] * values, first[some])
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: Sequence[str | None], metadata: np.ndarray) -> np.ndarray:
        rows, columns, values, stats = word_features(texts)
        bins = self.bins(dense(stats, metadata))
        rows, columns, values = together(rows, columns, values, bins)
        return logistic(self.raw(rows, columns, values, len(texts))[0])


def together(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and bins as one feature list, ascending by row."""
    count, width = bins.shape
    rows = np.concatenate([rows, np.repeat(np.arange(count), width)])
    columns = np.concatenate([columns, bins.ravel()])
    values = np.concatenate([values, np.full(count * width, 0.5)])
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order], values[order]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(features: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray, labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Adaptive gradient steps on the logistic loss; ``features`` are columns and values of the words of every row."""
    draw = np.random.default_rng(seed)
    size = WORDS + numbers.shape[1] * (BINS + 1)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    known = [c[~np.isnan(c)] for c in numbers.T]
    edges = np.array([np.quantile(c, cuts) if len(c) else np.zeros(BINS - 1) for c in known]).reshape(numbers.shape[1], BINS - 1)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    model = QualityModel(float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.01, (size, RANK)), edges)
    bins = model.bins(numbers)
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), STEP_ROWS):
            part = order[at : at + STEP_ROWS]
            sizes = np.array([len(features[k][0]) for k in part])
            rows = np.repeat(np.arange(len(part)), sizes)
            columns = np.concatenate([features[k][0] for k in part])
            values = np.concatenate([features[k][1] for k in part])
            rows, columns, values = together(rows, columns.astype(np.int64), values.astype(np.float64), bins[part])
            raw, sums = model.raw(rows, columns, values, len(part))
            slope = (logistic(raw) - labels[part]) / len(part)
            each = slope[rows] * values
            some, place = np.unique(columns, return_inverse=True)
            slope_w = np.bincount(place, weights=each) + SHRINK * model.weights[some] / len(part)
            pull = each[:, None] * (sums[rows] - model.vectors[columns] * values[:, None])
            by = np.argsort(place, kind="stable")
            first = np.searchsorted(place[by], np.arange(len(some)))
            slope_v = np.add.reduceat(pull[by], first, axis=0) + SHRINK * model.vectors[some] / len(part)
            seen_w[some] += slope_w**2
            seen_v[some] += slope_v**2
            seen_b += slope.sum() ** 2
            model.weights[some] -= RATE * slope_w / np.sqrt(seen_w[some])
            model.vectors[some] -= RATE * slope_v / np.sqrt(seen_v[some])
            model.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return model


def _numbers(frame: pd.DataFrame, metadata: Sequence[str]) -> np.ndarray:
    return frame[list(metadata)].to_numpy(dtype=np.float64, na_value=np.nan).reshape(len(frame), len(metadata))


def _sampled(batches: Iterator[pd.DataFrame], metadata: Sequence[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, columns, values, stats = word_features(batch["text"].tolist())
        cuts = np.searchsorted(rows, np.arange(len(batch) + 1))
        numbers = dense(stats, _numbers(batch, metadata))
        yield pd.DataFrame(
            {
                "label": batch["label"].astype(np.float64), "numbers": [x.tobytes() for x in numbers],
                "columns": [columns[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])],
                "values": [values[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])],
            }
        )


def _fitted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["columns", "values", "numbers", "label"], ignore_index=True)
    features = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(frame["columns"], frame["values"])]
    numbers = np.stack([np.frombuffer(x, np.float64) for x in frame["numbers"]])
    return pd.DataFrame({"model": [pickle.dumps(fit(features, numbers, frame["label"].to_numpy()))]})


def blank(width: int) -> QualityModel:
    """Scores everything one half."""
    size = WORDS + width * (BINS + 1)
    return QualityModel(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros((width, BINS - 1)))


def train(labelled: DataFrame, metadata: Sequence[str]) -> QualityModel:
    """Model of (label, text, metadata) rows, at most MAX_TRAIN of them; fitted in one task, 1.2 MB come back."""
    features = labelled.mapInPandas(lambda batches: _sampled(batches, metadata), "label double, numbers binary, columns binary, values binary")
    rows = features.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_fitted, "model binary").collect()
    if rows:
        return pickle.loads(bytes(rows[0].model))
    return blank(len(STATISTICS) + len(metadata))


def quality_column(docs: DataFrame, model: QualityModel, text_col: str, metadata: Sequence[str]) -> Column:
    """Score of every row's text, from 0 to 1; empty and null texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def look(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            numbers = np.stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns[1:]], axis=1) if len(columns) > 1 else np.empty((len(columns[0]), 0))
            yield pd.Series(shared.value.score(columns[0].tolist(), numbers))

    return look(F.col(text_col).cast("string"), *(F.col(c).cast("double") for c in metadata))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata: Sequence[str] = (), folds: int = 4, held_out: int = 2, threshold: float = 0.7, max_train: int = MAX_TRAIN, as_column: str = "quality",
) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``as_column`` (held_out, score, predicted).

    Learns from labelled rows whose crc32(id as text) modulo ``folds`` is not ``held_out``; of more than ``max_train``
    those with the smallest hashes of their ids. An id with several labels counts with the smaller one; null labels and
    labels without a document teach nothing, and with none at all every score is one half. Null metadata has a bin of its own.
    """
    prepare(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label")).where("__id is not null and label is not null")
    chosen = chosen.where(fold("__id", folds) != held_out).groupBy("__id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_train)
    numbers = [F.col(c).cast("double").alias(f"__meta{k}") for k, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"), *numbers)
    labelled = rows.join(F.broadcast(chosen), "__id").drop("__id")  # at most max_train rows
    model = train(labelled, [f"__meta{k}" for k in range(len(metadata))])
    found = docs.withColumn("__score", quality_column(docs, model, text_col, metadata))
    return found.withColumn(
        as_column,
        F.struct(
            (fold(id_col, folds) == held_out).alias("held_out"), F.col("__score").alias("score"),
            (F.col("__score") >= threshold).cast("int").alias("predicted"),
        ),
    ).drop("__score")
