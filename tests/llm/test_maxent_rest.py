"""Words beyond the first classes have a context too."""

import math
import zlib
from collections import Counter

import numpy as np

from locusflow.llm import maxent
from locusflow.llm.maxent import events, language_model_scores, log10_scores, rest_contexts, rest_events, tokens_of

HOT, RARE = 992, 40


def _rows():
    """Enough frequent words to fill all classes, and rare words in fixed pairs after them."""
    head = " ".join(f"h{k}" for k in range(HOT) for _ in range(60))
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = [(ids[0], head)] + [(k, " ".join(f"r{2 * j} r{2 * j + 1}" for j in range(RARE // 2))) for k in ids[1:21]]
    right = " ".join(f"r{2 * j} r{2 * j + 1}" for j in range(5))
    wrong = " ".join(f"r{2 * j} r{2 * (j + 5) + 1}" for j in range(5))
    return rows + [(held[0], right), (held[1], wrong), (held[2], "h1 new r1 r0 new")], held


def test_words_outside_the_classes_depend_on_the_word_before(frame):
    rows, held = _rows()
    got = {r.doc_id: r.score for r in language_model_scores(frame(rows)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_pairs_of_other_words_against_dictionaries(frame):
    """Class part from the model, the word in the first class from counted pairs; also with hot words left to the groups."""
    rows, held = _rows()
    for hot in (1 << 18, 1000):
        df = frame(rows)
        taught = [t for k, t in rows if k not in held]
        hashes, at = tokens_of(taught)
        words, n = np.unique(hashes, return_counts=True)
        counts = df.sparkSession.createDataFrame([(int(w), int(c)) for w, c in zip(words.view(np.int64), n)], "word long, n long")
        v = maxent.vocabulary(counts, hot)
        model, after = maxent.train(df.where(~df.doc_id.isin(held)).select("text"), v)
        pairs, contexts, seen = Counter(), Counter(), Counter(hashes.tolist())

        def rest(text, v=v):
            t, o = tokens_of([text])
            ranks = v.look_up(t)[0]
            e = events(v, t, o, ranks)
            places, before = rest_events(v, t, o, ranks, e.klass)
            return e, [(b, w) for b, w in zip(before.tolist(), t[places].tolist())]

        for text in taught:
            for pair in rest(text)[1]:
                pairs[pair] += 1
                contexts[pair[0]] += 1
        assert len(contexts) and all(after[c] == k for c, k in contexts.items()) and after.sum() == sum(contexts.values())
        assert rest_contexts(v) == len(after)
        got = {r.doc_id: (r.score, r.n_known) for r in language_model_scores(df, hot_words=hot).collect()}
        for doc, text in rows:
            e, own = rest(text)
            wanted = float(log10_scores(model, e).sum())
            for context, word in own:
                share = (seen[word] + 0.5) / v.rest_mass
                wanted += math.log10((pairs[context, word] + maxent.SMOOTHING * share) / (contexts[context] + maxent.SMOOTHING))
            assert math.isclose(got[doc][0], wanted, rel_tol=1e-6), (doc, got[doc], wanted)
            assert got[doc][1] == sum(seen[w] > 0 for w in tokens_of([text])[0].tolist())
