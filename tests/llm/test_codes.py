"""Integer Lloyd rounds against plain ones."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from locusflow.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain(rows, parts, entries, rounds):
    width = None
    kept = []
    for v, e, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not e or any(x is None or not np.isfinite(x) for x in e) or len(e) % parts or (width is not None and len(e) != width):
            continue
        width = len(e)
        kept.append((v, label, np.floor(1024 * np.array(e, dtype=np.float32).astype(np.float64)).astype(np.int64).reshape(parts, -1)))
    books = [[x[p].copy() for _, _, x in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        d = [int(((x - c) ** 2).sum()) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, _, x in kept:
                met.setdefault(nearest(p, x[p])[0], []).append(x[p])
            for k, xs in met.items():
                books[p][k] = sum(xs) // len(xs)
    out = []
    for v, label, x in kept:
        found = [nearest(p, x[p]) for p in range(parts)]
        out.append((v, label, [c for c, _ in found], sum(d for _, d in found)))
    text = ",".join(str(int(i)) for p in range(parts) for c in books[p] for i in c)
    return out, text


@pytest.mark.parametrize(("entries", "rounds"), [(4, 0), (4, 1), (8, 4), (300, 2)])
def test_against_plain(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    rows = [(k * 3, [float(x) for x in np.round(rng.normal(size=8), 2)], int(k % 3) if k % 4 else None) for k in range(60)]
    rows += rows[:10]  # repeated rows: equal vectors and equal entries
    rows += [(1, None, 1), (2, [], 1), (4, [1.0] * 7 + [None], 1), (5, [1.0] * 7 + [float("nan")], 1), (7, [float("inf")] * 8, 1), (8, [1.0] * 7, 1), (500, [1.0] * 4, 0), (None, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("label", "label")
    got = codes.compress_vectors(df.selectExpr("*", "1 AS codes", "2 AS ints"), parts=2, entries=entries, rounds=rounds).collect()
    wanted, text = plain(rows, 2, entries, rounds)
    assert {r.codebooks for r in got} == {text}
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in got), key=key) == sorted(wanted, key=key)
    sums = {}
    for _, label, _, error in wanted:
        sums[label] = sums.get(label, 0) + error
    assert all(r.label_error == sums[r.label] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 12))
def test_active_entries(seed, entries, n):
    """Compared with moved entries only, ties included, assignments equal full scans."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, size=(n, 2)).astype(float)
    books = rng.integers(-2, 3, size=(entries, 2)).astype(float)
    code, far = np.full(n, -1), np.zeros(n)
    moved = np.ones(entries, dtype=bool)
    for _ in range(4):
        code, far, _ = codes.assign(x, books, moved, code, far)
        d = ((x[:, None] - books[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        new = np.where(rng.random((entries, 1)) < 0.5, rng.integers(-2, 3, size=books.shape), books)
        moved, books = (new != books).any(axis=1), new


def test_settled_parts_compare_little():
    rng = np.random.default_rng(0)
    x, books = rng.integers(-99, 99, size=(100, 4)).astype(float), rng.integers(-99, 99, size=(50, 4)).astype(float)
    code, far, first = codes.assign(x, books, np.ones(50, dtype=bool), np.full(100, -1), np.zeros(100))
    moved = np.zeros(50, dtype=bool)
    assert first == 5000 and codes.assign(x, books, moved, code, far)[2] == 0
    moved[code[0]] = True
    stay = int((code != code[0]).sum())
    assert codes.assign(x, books, moved, code, far)[2] == stay + 50 * (100 - stay)


def test_no_vectors(spark):
    assert codes.compress_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress_vectors(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []


def test_too_large(spark):
    with pytest.raises(ValueError):
        codes.compress_vectors(spark.createDataFrame([(1, [3.0e4] * 4, 2)], SCHEMA))
