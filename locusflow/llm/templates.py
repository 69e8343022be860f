"""Dropping lines that follow a template recurring across documents.

Lines are parsed by a tree of fixed depth: token count first, then the leading tokens, in which fields with digits
are wildcards. Below such a leaf a line's core are the words that stand at their positions in most documents; a word in
fewer documents than the core's rarest one is a variable field, however frequent it is on its own, and lines with the
same core share a template. All counting is grouped and combined before it is shuffled, so neither a leaf nor a template
is ever gathered in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, membership_map, prepare, row_keys, stored

#: Leading tokens that lead to a leaf.
DEPTH = 3

#: Documents a template must occur in.
MIN_DOCS = 3

#: A line of so many tokens is a passage: word for word, it need occur only in so many documents.
LONG_TOKENS, LONG_DOCS = 20, 2

#: Lines with fewer tokens are too common to say anything; generalised lines need more.
MIN_TOKENS, MIN_VARIABLE_TOKENS = 5, 8

#: Share of a line's words (wildcards are none) that the core of a generalised template has.
CONSTANT_SHARE = 0.75

#: Share of words among the tokens of a masked line; with fewer, as in rows of numbers, only equal lines are the same.
WORD_SHARE = 0.5

WILDCARD = "<*>"

_DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    """Tokens between white space, those with digits as wildcards."""
    tokens = line.split()
    if _DIGIT.search(line):
        return [WILDCARD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def identity(line: str) -> tuple[list[str], int]:
    """Tokens by which lines are told apart, and how many of them are words: masked, unless too few words are left."""
    raw = line.split()
    if not _DIGIT.search(line):
        return raw, len(raw)
    tokens = masked(line)
    words = len(raw) - tokens.count(WILDCARD)
    return (tokens, words) if words >= WORD_SHARE * len(raw) else (raw, len(raw))


def _hash(text: str, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return value - (1 << 64) if value >> 63 else value


def leaf_of(tokens: list[str]) -> int:
    return _hash(" ".join([str(len(tokens)), *tokens[:DEPTH]]), 1)


_LINES = "doc_id long, key1 long, key2 int, line int, tokens int, words int, leaf long, line1 long, line2 long, first boolean"


def _parse(passages: bool):
    """Lines by their masked tokens; with ``passages``, long ones with wildcards also word for word, in a leaf of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["at", "line", "tokens", "words", "leaf", "line1", "line2", "first"]
        for batch in batches:
            out = []
            for at, text in enumerate(batch["text"]):
                seen: set[int] = set()
                for number, line in enumerate(text.split("\n") if text else ()):
                    tokens, words = identity(line)
                    n = len(tokens)
                    if n < MIN_TOKENS:
                        continue
                    whole = " ".join(tokens)
                    one = _hash(whole)
                    out.append((at, number, n, words, leaf_of(tokens), one, _hash(whole, 7), one not in seen))
                    seen.add(one)
                    if passages and words < n and n >= LONG_TOKENS:
                        whole = " ".join(line.split())
                        one = _hash(whole)
                        out.append((at, number, n, n, one, one, _hash(whole, 7), one not in seen))
                        seen.add(one)
            found = pd.DataFrame(out, columns=names)
            rows = batch[["doc_id", "key1", "key2"]].iloc[found["at"].to_numpy(dtype=np.int64)].reset_index(drop=True)
            yield pd.concat([rows, found.drop(columns="at")], axis=1)

    return run


def _tokens(leaves: Broadcast):
    """Token hashes of the lines that may lie in a leaf of the map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = leaves.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                for line in text.split("\n") if text else ():
                    tokens, words = identity(line)
                    if len(tokens) >= MIN_VARIABLE_TOKENS:
                        leaf = leaf_of(tokens)
                        if maybe_in(bits, np.array([leaf], dtype=np.int64))[0]:
                            whole = " ".join(tokens)
                            out.append((leaf, _hash(whole), _hash(whole, 7), [None if t == WILDCARD and words < len(tokens) else _hash(t) for t in tokens]))
            yield pd.DataFrame(out, columns=["leaf", "line1", "line2", "parts"])

    return run


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, long_docs: int) -> tuple[DataFrame, DataFrame]:
    """All parsed lines, and (line1, line2, first place) of those whose template recurs or that are recurring passages."""
    spark = docs.sparkSession
    key1, key2 = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key1.alias("key1"), key2.alias("key2"), F.col(text_col).cast("string").alias("text"))
    numbered = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))  # a null id comes first
    lines = stored(numbered.mapInPandas(_parse(long_docs < min_docs), _LINES), "lines")

    line = ["line1", "line2"]
    place = F.struct("doc_id", "key1", "key2", "line")
    held = lines.groupBy("leaf", "tokens", "words", *line).agg(F.sum(F.col("first").cast("long")).alias("docs"), F.min(place).alias("place"))
    held = stored(held, "templates")
    leaves = (
        held.where(F.col("tokens") >= MIN_VARIABLE_TOKENS).groupBy("leaf")
        .agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines")).where((F.col("docs") >= min_docs) & (F.col("lines") > 1)).select("leaf")
    )
    leaves = stored(leaves, "templates")
    shared = spark.sparkContext.broadcast(membership_map(leaves, "leaf"))
    parts = rows.select("text").mapInPandas(_tokens(shared), "leaf long, line1 long, line2 long, parts array<long>")
    parts = parts.join(leaves, "leaf", "left_semi").groupBy(*line).agg(F.first("leaf").alias("leaf"), F.first("parts").alias("parts"))
    # Counted only here, so that both uses of the table share one scan of the texts.
    parts = parts.withColumn("words", F.size(F.filter("parts", lambda x: x.isNotNull())))
    spread = parts.join(held.select(*line, "docs"), line).select("leaf", *line, "words", "docs", F.posexplode("parts").alias("at", "part")).where("part is not null")
    counts = spread.groupBy("leaf", "at", "part").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    # The core ends with the count that its required number of words reaches; it follows from the line's own leaf.
    share = F.ceil(CONSTANT_SHARE * F.col("words")).cast("int")
    template = (
        spread.join(counts, ["leaf", "at", "part"]).groupBy("leaf", *line, "words").agg(F.collect_list(F.struct("n", "at", "part")).alias("held"))
        .where(F.size("held") >= share).withColumn("least", F.element_at(F.sort_array(F.col("held.n"), asc=False), share))
        .withColumn("core", F.array_sort(F.transform(F.filter("held", lambda x: x["n"] >= F.col("least")), lambda x: F.struct(x["at"], x["part"]))))
        .select(*line, F.xxhash64("leaf", "core").alias("template"), (F.size("core") < F.col("words")).alias("generalised"))
    )
    named = held.join(template, line, "left").select(
        *line, "docs", "place", F.coalesce("template", "line1").alias("template"), F.coalesce("generalised", F.lit(False)).alias("generalised")
    )
    named = stored(named.where("generalised or docs >= %d" % min_docs), "templates")
    counted = named.groupBy("template").agg(F.sum("docs").alias("docs"), F.min("place").alias("kept")).where(F.col("docs") >= min_docs)
    found = named.select(*line, "template").join(counted.select("template", "kept"), "template").select(*line, "kept")
    passages = held.where((F.col("words") == F.col("tokens")) & (F.col("tokens") >= LONG_TOKENS) & F.col("docs").between(long_docs, min_docs - 1))
    return lines, found.unionByName(passages.select(*line, F.col("place").alias("kept")))


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, dropped_column: str = "dropped_lines",
    long_docs: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``; ``text_col`` without the dropped lines, whose numbers ``dropped_column`` lists.

    A line is dropped when its template occurs in at least ``min_docs`` documents, except at the template's first
    place (smallest id, then line), so that shared content stays in the corpus once. Fields with digits are
    variable in lines of which at least half the tokens are words; rows of numbers are the same only if they are equal.
    A line of at least twenty tokens goes from ``long_docs`` documents on if it stands there word for word (``min_docs``
    if not given; the query and the pipeline give two). Lines of fewer than five tokens stay, and templates with variable words ask for eight tokens. Documents
    are rows: copies count, a line repeated inside one document counts once. Rows that repeat both id and text get
    the same drops. A null text stays null with no drops; a null id sorts first; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    lines, found = recurring_lines(docs, id_col, text_col, min_docs, min_docs if long_docs is None else long_docs)
    place = F.struct("doc_id", "key1", "key2", "line")
    gone = (
        lines.join(found, ["line1", "line2"]).where(place != F.col("kept"))
        .groupBy("key1", "key2").agg(F.array_sort(F.collect_set("line")).alias("gone"))
        .toDF("__line_key1", "__line_key2", "__gone")
    )
    key1, key2 = row_keys(id_col, text_col)
    keyed = docs.withColumns({"__line_key1": key1, "__line_key2": key2})
    joined = keyed.join(gone, ["__line_key1", "__line_key2"], "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, k: ~F.array_contains("__gone", k)), "\n")
    return joined.withColumns(
        {
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left),
            dropped_column: F.coalesce("__gone", F.array().cast("array<int>")),
        }
    ).drop("__line_key1", "__line_key2", "__gone")
