"""Terms far from the entity, and with marks around them."""

import pytest

from locusflow.llm.privacy import _ENCLOSING, MARKS, find_private, sanitise, term_of


@pytest.mark.parametrize("gap", [11, 500])
def test_terms_far_from_the_entity(frame, gap):
    between = "the town is a place to be " * (gap // 7 + 1)
    names = ["Zorblatt,", "(Zorblatt)", "Zorblatt."]
    rows = [(k, f"{names[k]} {between} write to z@mail.org {between} {'abc'[k]} zorblatt") for k in range(3)]
    rows += [(k, between + " write to me") for k in range(10, 60)]
    got = {r.doc_id: r.terms for r in find_private(frame(rows)).collect()}
    for k in range(3):
        assert [rows[k][1][s.start : s.end].lower() for s in got[k]] == ["zorblatt", "zorblatt"]
    assert got[10] == []
    clean = {r.doc_id: r.text for r in sanitise(frame(rows)).collect()}
    assert all("zorblatt" not in clean[k].lower() and "[EMAIL]" in clean[k] for k in range(3)) and clean[10] == rows[3][1]


def test_marks():
    assert term_of("(Roe),") == term_of("Roe.") == term_of("Roe") == "roe"
    text = "'a' (b.c), -- ... x!y? \"Roe\" " + "!" * 100000 + "z"
    assert _ENCLOSING.sub(" ", text).split() == [w.strip(MARKS) for w in text.split() if w.strip(MARKS)]
