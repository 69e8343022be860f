"""Language of texts by string kernels.

The kernel counts the byte n-grams (1 to 3, blended) present in both of two texts, normalised by the geometric mean of
their own counts. Landmarks from a bounded sample give a Nystroem map, on which one ridge regression per language is
fitted against the rest. Map and regression are linear in a text's normalised presence vector, so they fold into one
matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, prepare

#: Hashed n-gram space; longest n-gram; landmarks; ridge; steepness of the scores.
SPACE_SIZE, LONGEST, LANDMARKS, RIDGE, STEEPNESS = 1 << 14, 3, 256, 1e-2, 4.0

#: Most training texts, all languages together; a share of it for each language.
MAX_TRAIN = 4000

UNKNOWN = "und"

#: Texts in one presence matrix, and bytes of text hashed at once.
_ROWS, _BYTES = 256, 1 << 20

_LETTER = regex.compile(r"\p{L}")

# ASCII bytes other than letters count as blanks: neither digits nor marks tell a language.
_PLAIN = bytes(c if c > 0x7F or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def presence(texts: list[str | None]) -> np.ndarray:
    """0/1 matrix (texts x SPACE_SIZE, float32) of the hashed n-grams in each text; whole texts, in parts."""
    out = np.zeros((len(texts), SPACE_SIZE), dtype=np.float32)
    for k, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(as_bytes(" " + text.lower() + " ").translate(_PLAIN), dtype=np.uint8)
        for at in range(0, len(data), _BYTES):
            part = data[at : at + _BYTES + LONGEST - 1].astype(np.uint32)
            code = np.zeros(len(part), dtype=np.uint32)
            for n in range(1, LONGEST + 1):
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] * np.uint32(256) + part[n - 1 :]
                hashed = (code + np.uint32(n << 28)) * np.uint32(0x9E3779B1)
                out[k, hashed >> np.uint32(32 - 14)] = 1
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class LanguageModel:
    """Languages and the weights (SPACE_SIZE x languages) of a normalised presence vector."""

    languages: list[str]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for at in range(0, len(texts), _ROWS):
            part = texts[at : at + _ROWS]
            known = np.fromiter(map(has_letter, part), dtype=bool, count=len(part))
            if not self.languages:
                known[:] = False
                best, score = np.zeros(len(part), dtype=int), np.zeros(len(part))
            else:
                marks = presence(part)
                size = np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
                raw = STEEPNESS * ((marks @ self.weights) / size).astype(np.float64)
                share = np.exp(raw - raw.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best, score = share.argmax(axis=1), share.max(axis=1)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores.append(np.where(known, score, 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def fit(labels: list[str], marks: list[bytes]) -> LanguageModel:
    """Kernel ridge regression from labels and packed presence vectors."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((SPACE_SIZE, 0), dtype=np.float32))

    def rows(which: range | np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.stack([np.frombuffer(marks[k], np.uint8) for k in which]), axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))

    order = np.argsort([labels[:k].count(x) for k, x in enumerate(labels)], kind="stable")  # languages take turns
    landmarks = rows(order[:LANDMARKS])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    strong = values > 1e-6 * values[-1]
    root = vectors[:, strong] / np.sqrt(values[strong])
    targets = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
    for at in range(0, len(labels), _ROWS):
        block = range(at, min(at + _ROWS, len(labels)))
        mapped = (rows(block) @ landmarks.T).astype(np.float64) @ root
        gram += mapped.T @ mapped
        right += mapped.T @ targets[at : at + _ROWS]
    solved = np.linalg.solve(gram + RIDGE * len(labels) / len(names) * np.eye(len(gram)), right)
    return LanguageModel(names, (landmarks.T @ (root @ solved)).astype(np.float32))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Presence vectors of a sample as bits."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.iloc[at : at + _ROWS]
            bits = np.packbits(presence(part["text"].tolist()).astype(bool), axis=1)
            yield pd.DataFrame({"lang": part["lang"].tolist(), "marks": [x.tobytes() for x in bits]})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> LanguageModel:
    """Model from rows with a language and a letter.

    The sample takes up to ``max_train`` different texts, for every language an equal quota, drawn by a hash of the
    text; only packed presence vectors of 2 KB reach the driver.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where("lang is not null and text is not null").withColumn("draw", F.xxhash64("text"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("draw")).collect()}
    if not sizes:
        return fit([], [])
    quota = max_train / len(sizes)
    limit = F.lit(0.0)
    for name, size in sizes.items():
        limit = F.when(F.col("lang") == name, min(1.0, quota / max(size, 1))).otherwise(limit)
    drawn = labelled.where(F.pmod("draw", F.lit(1_000_003)) < limit * 1_000_003).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    drawn = drawn.orderBy("draw", "lang").limit(max_train).where(F.col("text").rlike(r"\p{L}"))
    sample = sorted((r.lang, bytes(r.marks)) for r in drawn.select("lang", "text").mapInPandas(_packed, "lang string, marks binary").collect())
    return fit([x[0] for x in sample], [x[1] for x in sample])


def language_column(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of every row's text; ``und`` with score 0 where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return look(F.col(text_col).cast("string"))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2,
    as_column: str = "language",
) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``as_column`` (held_out, lang_pred, score).

    Rows whose crc32(id as text) modulo ``folds`` is ``held_out``, and rows without language or text, teach nothing.
    With nothing to learn from, every text is ``und``. Repeated rows, null ids and further columns pass unchanged.
    """
    prepare(docs.sparkSession)
    out = fold(id_col, folds) == held_out
    model = train(docs.where(~out), text_col, lang_col)
    found = docs.withColumn("__found", language_column(docs, model, text_col))
    return found.withColumn(
        as_column, F.struct(out.alias("held_out"), F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))
    ).drop("__found")
