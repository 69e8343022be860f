import zlib

import pytest

from locusflow.llm.language import fit, identify_languages, presence


def test_held_out_accuracy(small, small_rows):
    got = {r.doc_id: r.language for r in identify_languages(small).collect()}
    held = [(d, lang) for d, _, lang in small_rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, x in got.items() if x.held_out} == {d for d, _ in held}
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_edges(frame):
    base = [(k, ["the cat and the dog", "der hund und die katze"][k % 2] + f" {k}", ["en", "de"][k % 2]) for k in range(40)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "x" * 300000, None), (104, "Ж", None), (None, "the dog", None), (0, base[0][1], "en")]
    got = identify_languages(frame(base + odd), as_column="score")  # takes the place of a column of that name
    rows = {r.doc_id: r.score for r in got.collect()}
    assert got.count() == len(base) + len(odd)
    assert [rows[d].lang_pred for d in (100, 101, 102)] == ["und"] * 3 and rows[100].score == 0
    assert rows[103].lang_pred in ("en", "de") and rows[104].lang_pred in ("en", "de") and rows[None].lang_pred == "en"
    blank = identify_languages(frame([(1, "some text"), (2, None)])).collect()
    assert all(r.language.lang_pred == "und" and r.language.score == 0 for r in blank)
    assert identify_languages(frame([])).count() == 0


def test_numbers_that_are_no_letters(frame):
    base = [(k, ["the cat and the dog", "der hund und die katze"][k % 2] + f" {k}", ["en", "de"][k % 2]) for k in range(40)]
    odd = [(100, "½ ² ① Ⅷ", None), (101, "_ 12 ³", None), (102, "ª", None), (103, "½ x", None)]
    got = {r.doc_id: r.language.lang_pred for r in identify_languages(frame(base + odd)).collect()}
    assert [got[d] for d in (100, 101)] == ["und", "und"] and "und" not in (got[102], got[103])


def test_weights_equal_the_kernel_form():
    """The folded matrix scores as the kernel with all training texts as landmarks does."""
    import numpy as np

    texts, labels = ["aa ab", "ba bb", "aab", "bbb a"], ["x", "y", "x", "y"]
    marks = presence(texts)
    model = fit(labels, [np.packbits(m.astype(bool)).tobytes() for m in marks])
    unit = marks / np.sqrt(marks.sum(axis=1, keepdims=True))
    kernel = (unit @ unit.T).astype(float)
    target = np.array([[1, -1], [-1, 1], [1, -1], [-1, 1]], dtype=float)
    dual = kernel @ np.linalg.solve(kernel + 1e-2 * 4 / 2 * np.eye(4), target)
    assert np.allclose(unit @ model.weights, dual, atol=1e-3)


@pytest.mark.parametrize("text", ["ab" * 10, "a" * 3_000_000])
def test_presence_of_long_texts(text):
    assert presence([text, None]).sum(axis=1).tolist()[1] == 0 and presence([text]).sum() < 12
