"""Language-model scores of texts: a hashed maximum-entropy model with class-factored softmax.

Token counts of all training texts are exact. The most frequent words are spread over classes by rank; the first class
stands for every other word and splits its share by add-one-half counts, so the model is a proper distribution over
the counted words and one unknown word. The class given the context, and the word given class and context, are
softmaxes over sums of hashed feature rows: previous word, previous two words, and the word before the previous one.
Training is synchronous: a round sums, over all training texts, how often each feature row met each outcome and how
often the present model expects it to, and the weights take one scaled step. Sums do not depend on how the texts are
spread over tasks, so neither does the model. The first round needs only the observed counts: with the previous word as
the one feature, the maximum-entropy weights have a closed form.

The words of the first class, however many, are told apart by that closed form alone, with the previous word as the feature
and the counts as bias: (pairs of context and word + SMOOTHING * share of the word) / (words of the class after the context +
SMOOTHING). Pairs are counted exactly, in groups of words of bounded size that also look up the pairs of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_words, mix, prepare, stored

#: Most words whose counts are sent to all tasks; rarer ones are joined.
HOT_WORDS = 1 << 18

#: Classes and words in each; the first class is for all other words.
CLASSES, CLASS_WORDS = 32, 32

#: Words that contexts of classes tell apart, hashed contexts that all other words share, and feature rows of either table.
CONTEXT_WORDS, SHARED, ROWS = 4096, 4096, 1 << 15

#: Contexts with the one that stands for the start of a text.
CONTEXTS = CONTEXT_WORDS + SHARED + 1

#: Hashed contexts that words outside the hot ones share before words of the first class.
REST_SHARED = 1 << 16

#: Words of the first class in a group that counts and looks up their pairs, texts of a block sent to the groups.
GROUP_TOKENS, BLOCK_TEXTS = 1 << 20, 1 << 15

#: Scaling rounds after the closed form, tokens in a block of events, observations that a feature row is smoothed with.
ROUNDS, STEP_TOKENS, SMOOTHING = 1, 8192, 16.0

#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 1 << 20

#: Weight rows in one block of an exchange, first sums per block, tasks of a training pass per core.
BLOCK_ROWS, FAN_IN, TASKS_A_CORE = 1024, 32, 4

END = np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = -60.0


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, every text closed by one end, and the offsets of the texts."""
    words, at = hash_words(texts)
    offsets = at + np.arange(len(at))
    out = np.full(offsets[-1], END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[offsets[1:] - 1] = False
    out[inside] = words
    return out, offsets


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per word, combined over the batches of a task as far as memory allows."""
    held = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([held[0], *(w for w, _ in waiting)]), return_inverse=True)
        return words, np.bincount(place, weights=np.concatenate([held[1], *(n for _, n in waiting)]), minlength=len(words)).astype(np.int64)

    def frame(pair: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"word": pair[0].view(np.int64), "n": pair[1]})

    for batch in batches:
        words, counts = np.unique(tokens_of(batch["text"].tolist())[0], return_counts=True)
        waiting.append((words, counts))
        if sum(len(w) for w, _ in waiting) > HELD_WORDS:
            held, waiting = merged(), []
            if len(held[0]) > HELD_WORDS:
                yield frame(held)
                held = (held[0][:0], held[1][:0])
    yield frame(merged())


@dataclass
class Vocabulary:
    """Hot words (sorted hashes) with counts and ranks, and the totals of the training tokens."""

    words: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    tokens: int
    distinct: int

    @property
    def head(self) -> int:
        """Words that have a class of their own rank."""
        return min(len(self.words), (CLASSES - 1) * CLASS_WORDS)

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def rest_mass(self) -> float:
        top = self.counts[self.ranks < self.head]
        return self.mass - float(top.sum()) - 0.5 * len(top)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: not hot) and count of every token."""
        if not len(self.words):
            return np.full(len(tokens), -1), np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        hot = self.words[at] == tokens
        return np.where(hot, self.ranks[at], -1), np.where(hot, self.counts[at], 0)


def vocabulary(counts: DataFrame, hot_words: int = HOT_WORDS) -> Vocabulary:
    """Totals, and the words above the smallest count level (eighths of powers of two) that fits ``hot_words``."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
    least, held = None, 0
    for row in sorted(levels, reverse=True):
        held += row.words
        if held > hot_words:
            break
        least = row.level
    if least is None:
        return Vocabulary(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), sum(r.tokens for r in levels), sum(r.words for r in levels))
    hot = counts.where(level >= least).toArrow()
    words, n = hot.column("word").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    ranks = np.empty(len(words), dtype=np.int64)
    ranks[np.lexsort((words, -n))] = np.arange(len(words))
    return Vocabulary(words, n, ranks, sum(r.tokens for r in levels), sum(r.words for r in levels))


#: Rows of one class in the table of words.
AREA = (ROWS - CLASSES) // CLASSES


@dataclass
class Model:
    """Class rows and word rows (ROWS x 32 each); row 0, and rows 0 to 31, are biases."""

    classes: np.ndarray
    words: np.ndarray


def first_model(v: Vocabulary) -> Model:
    """Biases from counts: without context features the model is the add-one-half unigram."""
    classes = np.zeros((ROWS, CLASSES), dtype=np.float32)
    words = np.zeros((ROWS, CLASS_WORDS), dtype=np.float32)
    mass = np.zeros((CLASSES, CLASS_WORDS))
    top = np.flatnonzero(v.ranks < v.head)
    mass[1 + v.ranks[top] // CLASS_WORDS, v.ranks[top] % CLASS_WORDS] = v.counts[top] + 0.5
    mass[0, 0] = v.rest_mass
    with np.errstate(divide="ignore"):
        total = mass.sum(axis=1)
        classes[0] = np.where(total > 0, np.log(total / v.mass), _EMPTY)
        inside = np.log(mass / np.maximum(total, 1e-300)[:, None])
    words[:CLASSES] = np.where(mass > 0, inside, _EMPTY)
    return Model(classes, words)


@dataclass
class Events:
    """Targets and feature rows of a run of tokens."""

    context: np.ndarray  # the two words before, as one number
    klass: np.ndarray
    slot: np.ndarray
    class_rows: np.ndarray  # tokens x 4
    word_rows: np.ndarray


def events(v: Vocabulary, tokens: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> Events:
    known = np.where((ranks >= 0) & (ranks < CONTEXT_WORDS), ranks, CONTEXT_WORDS + (tokens % np.uint64(SHARED)).astype(np.int64))
    before = np.full((2, len(tokens)), CONTEXTS - 1, dtype=np.int64)
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in (1, 2):
        has = np.flatnonzero(place >= back)
        before[back - 1, has] = known[has - back]
    one, two = before.astype(np.uint64)  # previous word, word before it
    own = (ranks >= 0) & (ranks < v.head)
    klass = np.where(own, 1 + ranks // CLASS_WORDS, 0)
    slot = np.where(own, ranks % CLASS_WORDS, 0)
    # Rows of the classes: bias, previous word, word before it, both hashed. Those of the words: one bias a class, then
    # for each class an area of its own, half of it for the previous word and a quarter for either other feature.
    class_rows = np.zeros((len(tokens), 4), dtype=np.int64)
    class_rows[:, 1], class_rows[:, 2] = 1 + before[0], 1 + CONTEXTS + before[1]
    pair = mix((one * np.uint64(CONTEXTS) + two) * _GOLD)
    class_rows[:, 3] = 1 + 2 * CONTEXTS + (pair % np.uint64(ROWS - 1 - 2 * CONTEXTS)).astype(np.int64)
    word_rows = np.zeros((len(tokens), 4), dtype=np.int64)
    word_rows[:, 0] = klass
    area = CLASSES + klass * AREA
    quarter = np.uint64(AREA // 4)
    for k, (key, at, size) in enumerate([(mix(one * _GOLD), 0, 2 * quarter), (mix(two * _GOLD), 2, quarter), (pair, 3, quarter)]):
        word_rows[:, k + 1] = area + at * int(quarter) + (key % size).astype(np.int64)
    return Events(before[0] * CONTEXTS + before[1], klass, slot, class_rows, word_rows)


def rest_contexts(v: Vocabulary) -> int:
    """Contexts of words of the first class: a hot word each, the hashes of all others, and the start of a text."""
    return len(v.words) + REST_SHARED + 1


def rest_events(v: Vocabulary, tokens: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of the first class, and the word before each as one of :func:`rest_contexts`."""
    at = np.flatnonzero(klass == 0)
    first = np.zeros(len(tokens) + 1, dtype=bool)
    first[offsets[:-1]] = True
    before = at - 1
    context = np.where(ranks[before] >= 0, ranks[before], len(v.words) + (tokens[before] % np.uint64(REST_SHARED)).astype(np.int64))
    return at, np.where(first[at], rest_contexts(v) - 1, context)


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    raw = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        raw += weights[rows[:, k]]
    raw -= raw.max(axis=1, keepdims=True)
    np.exp(raw, out=raw)
    raw /= raw.sum(axis=1, keepdims=True)
    return raw


def _sides(e: Events) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For classes and for words: events, what tells their distributions apart, feature rows, outcomes."""
    own = np.flatnonzero(e.klass)
    return [
        (np.arange(len(e.klass)), e.context, e.class_rows, e.klass),
        (own, e.context[own] * CLASSES + e.klass[own], e.word_rows[own], e.slot[own]),
    ]


def log10_scores(model: Model, e: Events) -> np.ndarray:
    """log10 of class and, outside the first class, of word given class; one sum over outcomes per distinct context."""
    out = np.zeros(len(e.klass))
    for (own, key, rows, target), weights in zip(_sides(e), (model.classes, model.words)):
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        total = np.empty(len(first))
        for at in range(0, len(first), STEP_TOKENS):
            part = rows[first[at : at + STEP_TOKENS]]
            raw = weights[part[:, 0]]
            for k in range(1, part.shape[1]):
                raw += weights[part[:, k]]
            top = raw.max(axis=1, keepdims=True)
            raw -= top
            total[at : at + STEP_TOKENS] = top[:, 0] + np.log(np.exp(raw, out=raw).sum(axis=1, dtype=np.float64))
        raw = weights[rows, target[:, None]].sum(axis=1, dtype=np.float64)
        out[own] += (raw - total[same]) / np.log(10)
    return out


def _expected(weights: np.ndarray, key: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Add what the model expects of these events to the rows of their features, each distinct context once."""
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    for at in range(0, len(first), STEP_TOKENS):
        part = rows[first[at : at + STEP_TOKENS]]
        chance = _softmax(weights, part) * times[at : at + STEP_TOKENS, None].astype(np.float64)
        flat = part[:, 1:].astype(np.uint16).ravel()  # ROWS fit, and 16 bits are sorted by radix
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        out[flat[starts]] += np.add.reduceat(chance[order // (part.shape[1] - 1)], starts, axis=0)


def _expected_first(weights: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """The same while only biases and the previous word have weights, for all other features.

    The feature row of the previous word then tells distributions apart, and each distinct pair of it with another row is added once.
    """
    own, at = np.unique(rows[:, 1], return_index=True)
    chance = _softmax(weights, rows[at, :2])
    place = np.empty(ROWS, dtype=np.int64)
    place[own] = np.arange(len(own))
    for k in range(2, rows.shape[1]):
        code = np.sort(rows[:, k] * ROWS + rows[:, 1])
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
        times, code = np.diff(np.append(starts, len(code))), code[starts]
        for low in range(0, len(code), STEP_TOKENS):
            some = code[low : low + STEP_TOKENS]
            flat = some // ROWS
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            sums = chance[place[some % ROWS]] * times[low : low + STEP_TOKENS, None].astype(np.float64)
            out[flat[first]] += np.add.reduceat(sums, first, axis=0)


def _sums(v: Broadcast, model: Broadcast | None, only_first: bool):
    """Sums of one task per feature row and outcome, by row block: observed without a model, else expected.

    Observed sums are followed by how many words of the first class came after each of their contexts.
    """
    size = 2 * ROWS * CLASSES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = rest_contexts(v.value) if model is None else 0
        blocks = np.zeros((-(-(size + after) // (BLOCK_ROWS * CLASSES)), BLOCK_ROWS * CLASSES))
        sums = blocks.reshape(-1)[:size].reshape(2, ROWS, CLASSES)
        for batch in batches:
            tokens, offsets = tokens_of(batch["text"].tolist())
            ranks = v.value.look_up(tokens)[0]
            e = events(v.value, tokens, offsets, ranks)
            for side, (_, context, rows, target) in enumerate(_sides(e)):
                if model is None:
                    np.add.at(sums[side].reshape(-1), (rows[:, 1:] * CLASSES + target[:, None]).ravel(), 1)
                elif only_first:
                    _expected_first((model.value.classes, model.value.words)[side], rows, sums[side])
                else:
                    _expected((model.value.classes, model.value.words)[side], context, rows, sums[side])
            if model is None:
                context = rest_events(v.value, tokens, offsets, ranks, e.klass)[1]
                blocks.reshape(-1)[size : size + after] += np.bincount(context, minlength=after)
        for block in np.flatnonzero(blocks.any(axis=1)):
            yield pd.DataFrame({"block": [int(block)], "sums": [blocks[block].tobytes()]})

    return run


def _add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    sums = sum(np.frombuffer(x) for x in frame["sums"])
    return pd.DataFrame({"block": [key[0]], "part": [0], "sums": [sums.tobytes()]})


def _total(texts: DataFrame, v: Broadcast, model: Model | None, only_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all texts (side, row, outcome), and without a model those of the contexts of the first class.

    A task hands on one table of fixed size, so there are a few tasks a core however many files the texts lie in; the
    blocks of the tables are added up in two levels.
    """
    context = texts.sparkSession.sparkContext
    shared = None if model is None else context.broadcast(model)
    parts = texts.coalesce(TASKS_A_CORE * context.defaultParallelism).mapInPandas(_sums(v, shared, only_first), "block int, sums binary")
    parts = parts.withColumn("part", F.spark_partition_id() % FAN_IN)
    for keys in (["block", "part"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(_add, "block int, part int, sums binary")
    size, after = 2 * ROWS * CLASSES, rest_contexts(v.value)
    blocks = np.zeros((-(-(size + after) // (BLOCK_ROWS * CLASSES)), BLOCK_ROWS * CLASSES))
    for row in parts.collect():  # 64 blocks of fixed size, and one for every 32,768 contexts of hot words
        blocks[row.block] = np.frombuffer(row.sums)
    return blocks.ravel()[:size].reshape(2, ROWS, CLASSES), blocks.ravel()[size : size + after]


def _smoothed(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """log of observed over expected outcomes of feature rows, both with ``SMOOTHING`` observations as expected."""
    n = observed.sum(axis=1, keepdims=True)
    prior = SMOOTHING * expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log((observed + prior) / (expected + prior))
    return np.where((n > 0) & (prior > SMOOTHING * 1e-12), step, 0.0)


def _first_rows(side: int) -> np.ndarray:
    """Feature rows of the previous word."""
    if side == 0:
        return np.arange(1, 1 + CONTEXTS)
    return (CLASSES + np.arange(CLASSES)[:, None] * AREA + np.arange(AREA // 4 * 2)).ravel()


def train(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> tuple[Model, np.ndarray]:
    """Model after the closed form for the previous word and ``rounds`` scaling steps, each over all of ``texts``.

    Also how many words of the first class followed each of :func:`rest_contexts`.
    """
    shared = texts.sparkSession.sparkContext.broadcast(v)
    model = first_model(v)
    observed, after = _total(texts, shared, None)
    for side, weights in enumerate((model.classes, model.words)):
        rows = _first_rows(side)
        bias = weights[:1] if side == 0 else weights[(rows - CLASSES) // AREA]
        chance = np.exp(bias.astype(np.float64))
        weights[rows] = _smoothed(observed[side, rows], chance * observed[side, rows].sum(axis=1, keepdims=True))
    for turn in range(rounds):
        expected, _ = _total(texts, shared, model, turn == 0)
        for side, weights in enumerate((model.classes, model.words)):
            step = _smoothed(observed[side], expected[side])
            if turn == 0:  # the previous word is fitted already, two other features share the step
                step[_first_rows(side)] = 0
            weights += (step / (2 if turn == 0 else 3)).astype(np.float32)
    return model, after


#: Rows of texts (``block`` and ``place`` name them), of the words of a block of texts in one group, and of a group's sums for a block.
_ROWS = (
    "part int, block long, place int, doc_id string, held_out boolean, n_tokens long, known long, base double, model double, n_rest long, "
    "words binary, counts binary, contexts binary, places binary, values binary, cold binary, cold_values binary"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _ROWS.split(", ")])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Rows of ``_ROWS`` with these columns, the others null."""
    made = {k: x if isinstance(x, pa.Array) else pa.array(x, _SCHEMA.field(k).type) for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _score(v: Broadcast, model: Broadcast, after: Broadcast, parts: int):
    """Sums over what a task knows of every text, and the words of the first class for the groups that know their pairs."""

    def texts(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        words, size = v.value, batch.num_rows
        tokens, offsets = tokens_of(batch.column("text").to_pylist())
        ranks, counts = words.look_up(tokens)
        e = events(words, tokens, offsets, ranks)
        at, context = rest_events(words, tokens, offsets, ranks, e.klass)
        known = np.where(ranks >= 0, np.log10(counts + 0.5), 0.0)
        logs = log10_scores(model.value, e)
        logs[at] += known[at] - np.log10(1 + after.value[context] / SMOOTHING)
        total = lambda x: np.add.reduceat(x, offsets[:-1])
        yield _batch(
            size, part=[block % parts] * size, block=[block] * size, place=np.arange(size), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"),
            n_tokens=np.diff(offsets), known=total((ranks >= 0).astype(np.int64)), base=total(known), model=total(logs), n_rest=total((e.klass == 0).astype(np.int64)),
        )
        # Groups are ranges of hashes, so sorted words lie in the order of their groups.
        order = np.argsort(tokens[at], kind="stable")
        at, context = at[order], context[order].astype(np.uint32)
        own = tokens[at]
        place = np.searchsorted(offsets, at, side="right") - 1
        code = (place * 2 + batch.column("held_out").to_numpy(zero_copy_only=False)[place]).astype(np.uint16)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else at
        distinct, times = own[starts], np.diff(np.append(starts, len(own))).astype(np.uint32)
        group = ((distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else starts
        ends, last = np.append(edges[1:], len(group)), np.append(starts, len(own))
        words_at, tokens_at = [*zip(edges, ends)], [*zip(last[edges], last[ends])] if len(edges) else []
        cut = lambda x, pieces: [x[low:high].tobytes() for low, high in pieces]
        yield _batch(
            len(edges), part=group[edges], block=[block] * len(edges), words=cut(distinct, words_at), counts=cut(times, words_at),
            contexts=cut(context, tokens_at), places=cut(code, tokens_at),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_TEXTS):
                yield from texts(batch.slice(low, BLOCK_TEXTS), block)
                block += 1

    return run


def _groups(v: Broadcast):
    """Counts of the words and pairs of one group, and their sums for every block of texts; rows of texts pass."""

    def run(table: pa.Table) -> pa.Table:
        is_text = pc.is_valid(table["place"])
        sent = table.filter(pc.invert(is_text))
        passed = table.filter(is_text)
        if not sent.num_rows:
            return passed.cast(_SCHEMA)
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in sent[name].to_pylist()]
        some, times, contexts, places = read("words", np.uint64), read("counts", np.uint32), read("contexts", np.uint32), read("places", np.uint16)
        words, which = np.unique(np.concatenate(some), return_inverse=True)
        which = np.repeat(which, np.concatenate(times))
        place = np.concatenate(places)
        taught = (place & 1) == 0
        n = np.bincount(which[taught], minlength=len(words))
        pairs, pair = np.unique(which * rest_contexts(v.value) + np.concatenate(contexts), return_inverse=True)
        met = np.bincount(pair[taught], minlength=len(pairs))
        gains = np.log10(1 + met[pair] * v.value.rest_mass / (SMOOTHING * (n[which] + 0.5)))
        cold = (v.value.look_up(words)[0] < 0)[which]
        logs = np.log10(2.0 * n + 1)
        out: dict[str, list] = {"places": [], "values": [], "cold": [], "cold_values": []}
        ends = np.cumsum([len(x) for x in places])
        for low, high in zip(ends - [len(x) for x in places], ends):
            own = place[low:high] >> 1
            out["places"].append((found := np.unique(own)).tobytes())
            out["values"].append(np.bincount(own, weights=gains[low:high])[found].astype(np.float32).tobytes())
            rare = cold[low:high]
            own, word = own[rare], which[low:high][rare]
            out["cold"].append((found := np.unique(own)).tobytes())
            sums = [np.bincount(own, weights=x)[found] for x in (logs[word], n[word] > 0)]
            out["cold_values"].append(np.concatenate(sums).tobytes())
        sums = _batch(sent.num_rows, part=sent["part"].to_numpy(), block=sent["block"].to_numpy(), **out)
        return pa.concat_tables([passed.cast(_SCHEMA), pa.Table.from_batches([sums])])

    return run


_SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, base double, model double, n_rest long"


def _scored(table: pa.Table) -> pa.Table:
    """Rows of the texts of a block, with the sums of all groups."""
    is_text = pc.is_valid(table["place"])
    texts, parts = table.filter(is_text), table.filter(pc.invert(is_text))
    size = texts.num_rows
    gains, bases, known = np.zeros(size), np.zeros(size), np.zeros(size)
    for places, values, cold, cold_values in sorted(zip(*(parts[c].to_pylist() for c in ("places", "values", "cold", "cold_values")))):
        gains[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(values, dtype=np.float32)
        found = np.frombuffer(cold, dtype=np.uint16)
        logs, counts = np.frombuffer(cold_values).reshape(2, -1)
        bases[found] += logs
        known[found] += counts
    place = texts["place"].to_numpy()
    n_known = texts["known"].to_numpy() + np.rint(known[place]).astype(np.int64)
    cold_tokens = texts["n_tokens"].to_numpy() - texts["known"].to_numpy()
    rare = bases[place] + cold_tokens * np.log10(0.5)
    return pa.table(
        {
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": texts["n_tokens"], "n_known": n_known,
            "base": texts["base"].to_numpy() + rare, "model": texts["model"].to_numpy() + rare + gains[place], "n_rest": texts["n_rest"],
        }
    )


def language_model_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, hot_words: int = HOT_WORDS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and score their end alone. Rows whose crc32(id as text) modulo ``folds`` is ``held_out`` teach
    nothing; with nothing to learn from, every token has probability one. Counts of the hot words travel by
    broadcast, at most ``hot_words``; words outside the ``head`` travel to the groups that count them and their pairs with the
    word before, so every word is scored in its context.
    Repeated rows, null ids and further columns do no harm; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    taught = rows.where("not held_out").select("text")
    counts = stored(taught.mapInPandas(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts, hot_words)
    model, after = train(taught, v)
    share = spark.sparkContext.broadcast
    known = share(v)
    in_rest = v.tokens - int(v.counts[v.ranks < v.head].sum())
    parts = max(spark.sparkContext.defaultParallelism, -(-in_rest * folds // max(folds - 1, 1) // GROUP_TOKENS))
    sent = rows.mapInArrow(_score(known, share(model), share(after), parts), _ROWS)
    scored = sent.groupBy("part").applyInArrow(_groups(known), _ROWS).groupBy("block").applyInArrow(_scored, _SCORED)
    mass, rest_mass = float(np.log10(v.mass)), float(np.log10(max(v.rest_mass, 0.5)))
    return scored.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * mass).alias("base_score"), (F.col("model") - F.col("n_rest") * rest_mass).alias("score"),
    )
