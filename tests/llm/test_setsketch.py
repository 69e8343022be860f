import re

import numpy as np
import pytest

from locusflow.llm import setsketch
from locusflow.llm.setsketch import joint_similarity, near_duplicates, shingle_sets, sketches

ASCII = {c: c + 32 for c in range(65, 91)}


def brute(rows, words, percent=80):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        found = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        sets[doc] = sets.get(doc, set()) | found
    label = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def check(df, rows, words):
    sets, label = brute(rows, words)
    got = {r.doc_id: r for r in near_duplicates(df, words=words).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), label[d], label[d] == d) for d in label}


@pytest.mark.parametrize("words", [2, 5])
def test_whole_table(small, small_rows, words):
    check(small, small_rows, words)


def test_large_group_of_edited_copies(frame):
    """Members far from each other, linked by chains, in buckets that are cut into tiles."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for doc in range(160):
        text = list(base)
        for k in rng.choice(120, int(rng.integers(0, 22)), replace=False):
            text[k] = f"x{doc}_{k}"
        rows.append((doc * 3, " ".join(text)))
    old = setsketch.TILE_ROWS
    setsketch.TILE_ROWS = 40
    try:
        check(frame(rows), rows, 2)
    finally:
        setsketch.TILE_ROWS = old


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE  two\n"), (7, "a b " * 30000), (8, "a b"), (9, " \t")]
    check(frame(rows), rows, 2)
    odd = near_duplicates(frame([(None, "x y z"), (1, "x y z"), (1, "x y z"), (2, "x y z")]), words=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in odd) == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(frame([])).count() == 0


def test_large_ids_beside_null_and_repeated_ids(spark):
    rows = [(2**60 + 1, "a b c"), (None, "a b c"), (2**60 + 3, "d e f"), (5, "d e f"), (5, "x y z"), (7, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df, words=2).collect())
    big = 2**60
    assert got == sorted([(str(big + 1), big + 1, True), ("None", None, False), (str(big + 3), 5, False), ("5", 5, True), ("5", 5, True), ("7", 5, False)])


def test_estimate_is_close():
    rng = np.random.default_rng(6)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        own = [rng.integers(0, 2**63, int(1000 / share - 1000), dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, x])) for x in own]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        marks = sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        size = [np.array([len(s)]) for s in sets]
        assert abs(joint_similarity(marks[:1], marks[1:], *size)[0] - true) < 6 * np.sqrt(true * (1 - true) / marks.shape[1]) + 0.02


def test_sketches_merge():
    a, at = shingle_sets(["p q r s", "q r s t u", "p q r s\nq r s t u"], 2)
    joined = np.unique(np.concatenate([a[at[0] : at[1]], a[at[1] : at[2]]]))
    one = sketches(a, at)
    assert (np.maximum(one[0], one[1]) == sketches(joined, np.array([0, len(joined)]))[0]).all()
