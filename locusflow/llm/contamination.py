"""Benchmark contamination: one Aho-Corasick automaton over the windows of all test items, one scan per text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare

#: Characters of benchmark text in one automaton (about 200 MB of nodes); more text makes further automata, scanned in turn.
SLICE_BYTES = 1 << 18

#: ASCII bytes other than digits and letters end a word; all bytes of other characters belong to words.
_BLANK = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the A-Z-lowered text, in UTF-8."""
    return as_bytes(text).lower().translate(_BLANK).split()


def windows(text: str | None, size: int) -> set[bytes]:
    """Every run of ``size`` words, between single blanks; a shorter text with words is one window."""
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))}


def automaton(items: list[tuple[int, str]], size: int) -> ahocorasick.Automaton | None:
    """Windows with the items they occur in and their number of words; byte strings stand as Latin-1 text."""
    owners: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        for window in windows(text, size):
            owners[window].add(item)
    machine = ahocorasick.Automaton()
    for window, found in owners.items():
        machine.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(found)))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def scan(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, disjoint word ranges [from, to) that windows cover, and the items that occur."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set = set()
    if machine is None or not words:
        return len(words), spans, items
    line = b" " + b" ".join(words) + b" "
    blanks = None
    for end, (length, found) in machine.iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        last = int(np.searchsorted(blanks, end))
        items.update(found)
        spans.append((last - length, last))
    return len(words), joined(spans), items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    if not spans:
        return []
    data = as_bytes(text)
    inside = np.frombuffer(b" " + data.lower().translate(_BLANK) + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    raw = np.frombuffer(data, np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in spans]


def _slices(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in parts of at most ``limit`` bytes (or one item), streamed to the driver."""
    part: list[tuple[int, str]] = []
    held = 0
    rows = benchmark.select(F.col(item_col), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        if part and held + len(text) > limit:
            yield part
            part, held = [], 0
        part.append((item, text))
        held += len(text)
    yield part


_FOUND = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def _scanner(part: Broadcast, size: int):
    """Column function that adds what one part of the benchmark finds to the earlier findings."""

    @F.pandas_udf(_FOUND)
    def look(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        machine = automaton(part.value, size)
        for texts, before in batches:
            rows = []
            for text, spans, items in zip(texts, before["spans"], before["items"]):
                n, new, found = scan(text, machine)
                if spans is not None and len(spans):
                    new = joined(new + [(s["first"], s["end"]) for s in spans])
                found = {str(x) for x in found} | set(items if items is not None else ())
                rows.append((n, [{"first": a, "end": b} for a, b in new], sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return look


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 13, as_column: str = "passages", slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct column ``as_column``.

    Fields: n_words; spans, the disjoint word ranges [first, end) covered by windows of test items; items, the
    sorted ids (as strings) that occur; n_hit, the words covered; chars, the spans in characters of the text. Null
    texts have no words, test items without words match nothing, and with an empty benchmark nothing is hit. Rows
    are handled one by one, so repeated rows and ids, null ids and further columns pass unchanged.

    The test items travel as broadcast parts of at most ``slice_bytes``, so no automaton outgrows a worker; each text
    is scanned once per part, which is once for benchmarks below that size.
    """
    spark = docs.sparkSession
    prepare(spark)
    state = f"__{as_column}_state"
    out = docs.withColumn(state, F.lit(None).cast(f"struct<{_FOUND.replace(' long', ':long').replace(' array', ':array')}>"))
    for part in _slices(benchmark, item_col, item_text_col, slice_bytes):
        look = _scanner(spark.sparkContext.broadcast(part), size)
        out = out.withColumn(state, look(F.col(text_col).cast("string"), F.col(state)))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def places(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            [{"start": a, "end": b} for a, b in characters(t, [(s["first"], s["end"]) for s in x])] if len(x) else [] for t, x in zip(texts, spans)
        ])

    covered = F.aggregate(f"{state}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    # Only rows with hits send their text to Python again.
    hit_text = F.when(F.size(f"{state}.spans") > 0, F.col(text_col).cast("string"))
    return out.withColumn(
        as_column,
        F.struct(
            F.col(f"{state}.n_words").alias("n_words"), F.col(f"{state}.spans").alias("spans"), F.col(f"{state}.items").alias("items"),
            covered.alias("n_hit"), places(hit_text, F.col(f"{state}.spans")).alias("chars"),
        ),
    ).drop(state)


def contaminated(as_column: str = "passages") -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col(f"{as_column}.n_hit") > 0) & (20 * F.col(f"{as_column}.n_hit") >= F.col(f"{as_column}.n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the passages themselves."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_passages(rows, benchmark, "text", **options)
    return found.select(
        "doc_id", "passages.n_words", "passages.n_hit", F.size("passages.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "passages.items"), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.col("passages.chars").alias("chars"),
    )


