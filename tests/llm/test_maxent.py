import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from locusflow.llm import maxent
from locusflow.llm.maxent import Vocabulary, _softmax, events, first_model, language_model_scores, tokens_of

ASCII = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII)), None]


def check(df, rows, **options):
    counts = Counter()
    for doc, text, *_ in rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 != 1:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    got = language_model_scores(df, **options).collect()
    wanted = []
    for doc, text, *_ in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        wanted.append((str(doc), len(own), sum(counts[t] > 0 for t in own), round(base, 6), total))
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.train_tokens) for r in got)
    assert [x[:3] for x in found] == [x[:3] for x in sorted(wanted)] and np.allclose([x[3] for x in found], [x[3] for x in sorted(wanted)])
    assert all(x[4] == total for x in found) and all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return got


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_whole_table(small, small_rows, hot):
    got = check(small, small_rows, hot_words=hot)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(frame):
    rows = [(k, f"a b c d{k % 3} a b") for k in range(12)] + [(50, None), (51, ""), (52, "z " * 50000), (None, "a b"), (0, "a b c d0 a b")]
    check(frame(rows), rows)
    only_held = [(k, "some text") for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1]
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in language_model_scores(frame(only_held)).collect())
    assert language_model_scores(frame([])).count() == 0


def test_model_does_not_depend_on_tasks(small):
    """The same scores, and better ones than the base on held-out texts, from 1, 8 and 64 partitions."""
    found = [{r.doc_id: r for r in language_model_scores(small.repartition(n)).collect()} for n in (1, 8, 64)]
    for other in found[1:]:
        assert all(math.isclose(r.score, other[k].score, rel_tol=1e-6) for k, r in found[0].items())
    held = [r for r in found[0].values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.1


def test_scores_of_a_slow_model(frame):
    """Closed form, one scaling step and scores again, event by event with dictionaries and double precision."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, 40).clip(max=60))) for k in range(40)]
    taught = [t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    got = {r.doc_id: r.score for r in language_model_scores(frame(rows)).collect()}
    hashes, offsets = tokens_of(taught)
    words, counts = np.unique(hashes, return_counts=True)
    ranks = np.empty(len(words), dtype=np.int64)
    ranks[np.lexsort((words, -counts))] = np.arange(len(words))
    v = Vocabulary(words, counts, ranks, int(counts.sum()), len(words))
    bias = first_model(v)

    def seen(texts):
        """(side, feature rows, outcome) of every event, and whether it is of a counted word."""
        tokens_, at = tokens_of(texts)
        e = events(v, tokens_, at, v.look_up(tokens_)[0])
        for k in range(len(tokens_)):
            yield k, 0, e.class_rows[k].tolist(), int(e.klass[k])
            if e.klass[k]:
                yield k, 1, e.word_rows[k].tolist(), int(e.slot[k])

    weights = [{}, {}]

    def chance(side, features):
        raw = (bias.classes, bias.words)[side][features[0]].astype(float).copy()
        for f in features[1:]:
            raw = raw + weights[side].get(f, np.zeros(32))
        raw = np.exp(raw - raw.max())
        return raw / raw.sum()

    def table(only_first, value):
        out = [{}, {}]
        for _, side, features, outcome in seen(taught):
            for f in features[1:2] if only_first else features[1:]:
                out[side].setdefault(f, np.zeros(32))
                out[side][f] += value(side, features, outcome)
        return out

    def step(observed, expected, share):
        for side in (0, 1):
            for f, o in observed[side].items():
                e = expected[side][f]
                prior = maxent.SMOOTHING * e / e.sum()
                some = prior > maxent.SMOOTHING * 1e-12
                weights[side][f] = weights[side].get(f, np.zeros(32)) + np.where(some, np.log((o + prior + 1e-300) / (e + prior + 1e-300)) * share, 0)

    one = lambda side, features, outcome: np.eye(32)[outcome]
    step(table(True, one), table(True, lambda side, features, _: chance(side, features[:1])), 1)
    observed, expected = table(False, one), table(False, lambda side, features, _: chance(side, features))
    first = table(True, one)
    for side in (0, 1):
        observed[side] = {f: x for f, x in observed[side].items() if f not in first[side]}
    step(observed, expected, 0.5)
    for doc, text in rows:
        wanted = 0.0
        at = tokens_of([text])[0]
        for k, side, features, outcome in seen([text]):
            wanted += math.log10(chance(side, features)[outcome])
            if side == 0 and outcome == 0:
                wanted += math.log10((v.look_up(at[k : k + 1])[1][0] + 0.5) / v.rest_mass)
        assert math.isclose(got[doc], wanted, rel_tol=1e-4), (doc, got[doc], wanted)


def test_probabilities_sum_to_one():
    """Over all words and one unknown word, in any context and with any weights."""
    rng = np.random.default_rng(1)
    hashes, _ = tokens_of([" ".join(f"w{k}" for k in range(1500))])
    words = np.unique(hashes)
    counts = rng.integers(1, 50, len(words))
    ranks = np.empty(len(words), dtype=np.int64)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    v = Vocabulary(words, counts, ranks, int(counts.sum()), len(words))
    model = first_model(v)
    model.classes += rng.normal(0, 0.3, model.classes.shape).astype(np.float32)
    model.words[maxent.CLASSES :] += rng.normal(0, 0.3, model.words[maxent.CLASSES :].shape).astype(np.float32)
    context = hashes[:3]
    total = 0.0
    for word in [*words, np.uint64(12345)]:
        t = np.append(context, word)
        rank, n = v.look_up(t)
        e = events(v, t, np.array([0, 4]), rank)
        chance = float(_softmax(model.classes, e.class_rows[3:])[0, e.klass[3]])
        if e.klass[3]:
            chance *= float(_softmax(model.words, e.word_rows[3:])[0, e.slot[3]])
        else:
            chance *= (n[3] + 0.5) / v.rest_mass
        total += chance
    assert abs(total - 1) < 1e-3
