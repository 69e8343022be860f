import zlib

import numpy as np

from locusflow.llm.quality import STATISTICS, dense, fit, score_quality, together, word_features


def test_held_out(spark, small, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.quality for r in score_quality(small, labels, metadata=["n_chars"]).collect()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, x in got.items() if x.held_out} == set(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    known = [d for d in held if d in truth]
    assert sum((got[d].score >= 0.5) == truth[d] for d in known) >= 0.85 * len(known)


def test_edges(spark, frame):
    rows = [(k, ["fine words in a row", "!! JUNK ## !!"][k % 2] + f" w{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(None, 1), (5, None), (999, 0), (0, 1)], "doc_id long, quality int")
    odd = [(100, None), (101, ""), (102, "x" * 200000), (None, "fine words"), (0, rows[0][1])]
    df = frame(rows + odd)
    got = score_quality(df, labels, metadata=["n"], as_column="found").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.found.score <= 1 for r in got)
    score = {r.doc_id: r.found.score for r in got}
    assert np.mean([score[k] for k in range(0, 60, 2)]) > 0.7 > 0.4 > np.mean([score[k] for k in range(1, 60, 2)])
    none = score_quality(df, labels.limit(0)).collect()
    assert {r.quality.score for r in none} == {0.5}
    assert score_quality(frame([]), labels).count() == 0


def test_output_equals_the_sum_over_pairs():
    texts = ["a b c a", "b d", ""]
    rows, columns, values, stats = word_features(texts)
    numbers = dense(stats, np.array([[1.0], [np.nan], [3.0]]))
    features = [(columns[rows == k], values[rows == k]) for k in range(3)]
    model = fit(features * 4, np.tile(numbers, (4, 1)), np.array([1.0, 0, 1] * 4))
    r, c, v = together(rows, columns, values, model.bins(numbers))
    raw, _ = model.raw(r, c, v, 3)
    for k in range(3):
        x = list(zip(c[r == k], v[r == k]))
        slow = model.bias + sum(model.weights[i] * a for i, a in x)
        slow += sum(a * b * model.vectors[i] @ model.vectors[j] for p, (i, a) in enumerate(x) for j, b in x[p + 1 :])
        assert abs(slow - raw[k]) < 1e-9
    assert stats.shape == (3, len(STATISTICS)) and not stats[2].any()
