import math

import numpy as np
import pytest

from locusflow.llm import vectors
from locusflow.llm.vectors import near_vectors


def brute(rows, cosine=0.95):
    usable = {}
    for k, (vec, x) in enumerate(rows):
        if vec is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            x = np.array(x) / max(abs(c) for c in x)
            usable[k] = x / np.sqrt((x * x).sum())
    links = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and float(usable[a] @ usable[b]) >= cosine]
    label = {k: rows[k][0] for k in range(len(rows))}
    count = dict.fromkeys(label, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((rows[k][0] if rows[k][0] is not None else -1, count[k], label[k] if label[k] is not None else -1) for k in label)


def check(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = near_vectors(df.selectExpr("*", "1 AS id", "2 AS weight", "3 AS label")).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_and_copies(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "HOME", 20)
    monkeypatch.setattr(vectors, "VISITORS", 30)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 24))
    rows = []
    for k in range(260):
        x = centres[k % 8] * rng.uniform(0.5, 2) + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.4, 2])
        rows.append((1000 - k, np.float32(x).astype(float).tolist()))
    rows += [(2000 + k, rows[0][1]) for k in range(30)]
    check(spark, rows, kind)


def test_edges(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 3.0, 4.0]), (5, [1.0, math.nan, 3.0, 4.0]), (6, [math.inf, 1.0, 1.0, 1.0]), (7, x), (7, x),
        (8, [2.0, 4.0, 6.0, 8.0]), (None, x), (9, [1e200, 2e200, 3e200, 4e200]), (10, x[:3]), (11, [-c for c in x]),
    ]
    check(spark, rows)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
