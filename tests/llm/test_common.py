import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusflow.llm import common
from locusflow.llm.components import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\n\t\x0b\x1f", max_size=40), max_size=6))
def test_words_like_the_pattern(texts):
    hashes, at = common.hash_words(texts)
    lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    known = {}
    for w, h in zip(flat, hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{k}é" for k in range(3000))
    whole = common.hash_words([text, None, "w1é"])
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    cut = common.hash_words([text, None, "w1é"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[0][1] == whole[0][-1]


def test_membership_map(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    bits = common.membership_map(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert common.maybe_in(bits, keys).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert common.maybe_in(bits, others).mean() < 0.01


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    edges = {
        "chain": [(k, k + 1) for k in range(60)] + [(200, 201)],
        "star": [(5, k) for k in range(6, 80)] + [(None, 4), (9, 9)],
        "random": [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(70)],
        "empty": [],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
