import re

import pytest

from locusflow.llm.contamination import contamination_report, find_passages

ASCII = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(text, items, size=13):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            part = w[k : k + size]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "one two three"), (10, " ".join(f"w{k}" for k in range(20))), (2, "Ünï code 7"), (3, "..."), (4, None), (5, ""), (6, "one two")]
ROWS = [
    (1, "ONE, two-three four"), (2, None), (3, ""), (4, "... --"), (5, "x " * 50 + "one two three"), (6, " ".join(f"W{k}." for k in range(20))),
    (7, "w0 w1 w2"), (8, "ünï CODE 7 Ünï code 7"), (9, "one two " * 20000), (5, "one two three"), (None, "one two"), (11, " ".join(f"w{k}" for k in range(3, 18))),
    (12, "éone two three"), (13, "one two one two three"),
]


@pytest.mark.parametrize("limit", [1 << 18, 12])
def test_brute_force(spark, frame, limit):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_passages(frame(ROWS), benchmark, slice_bytes=limit).select("doc_id", "text", "passages").collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, hit, items = brute(r.text, ITEMS)
        p = r.passages
        assert (p.n_words, p.n_hit, p["items"]) == (n, hit, items)
        covered = [w for s in p.spans for w in words(r.text)[s["first"] : s["end"]]]
        assert [w for c in p.chars for w in words(r.text[c["start"] : c["end"]])] == covered and len(covered) == hit


def test_report(spark, frame):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in contamination_report(frame(ROWS), benchmark).collect()}
    assert got[5].contaminated and got[2].n_words == 0 and not got[2].contaminated and got[6].n_items == 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in contamination_report(frame(ROWS), empty).collect())
    assert contamination_report(frame([]), benchmark).count() == 0
