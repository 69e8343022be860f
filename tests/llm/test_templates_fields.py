"""Templates whose field values are frequent, and rows of numbers."""

import pytest

from locusflow.llm.templates import drop_recurring_lines


def dropped(frame, rows):
    return {r.doc_id: r.dropped_lines for r in drop_recurring_lines(frame(rows)).collect()}


@pytest.mark.parametrize("authors,boards,copies", [(8, 8, 1), (12, 3, 2), (2, 20, 1)])
def test_two_fields_of_frequent_values(frame, authors, boards, copies):
    """Every author and board is in three documents or more, every pair of them in one or two."""
    names = [f"{x}{y}ster" for x in "abcdefgh" for y in "aeiou"]
    rows = []
    for a in range(authors):
        for b in range(boards):
            for c in range(copies):
                rows.append((len(rows), f"posted by the user {names[a]} in the board {names[-1 - b]} on 2024-0{a % 9}-1{c}"))
    rows += [(900 + k, f"posted by the {w} is quite another line that has eleven") for k, w in enumerate(("baker", "smith"))]
    got = dropped(frame, rows)
    assert got[0] == [] and all(v == [0] for k, v in got.items() if 0 < k < 900) and got[900] == got[901] == []


def test_a_value_of_nearly_all_documents(frame):
    rows = [(k, f"posted by the user {'ann' if k != 20 else 'bob'} in the board {'sports' if k != 20 else 'music'} on 2024-01-{k}") for k in range(30)]
    got = dropped(frame, rows)
    assert got[0] == [] and all(got[k] == [0] for k in range(1, 30))


def test_templates_of_one_leaf_stay_apart(frame):
    kinds = ["opened the door of room {} with a red key", "closed the gate in yard {} for the long night"]
    names = [f"{x}{y}" for x in "abcdefgh" for y in "aeiou"]
    rows = [(k, "it was then " + kinds[k >= 5].format(names[k])) for k in range(35)]
    got = dropped(frame, rows)
    assert got[0] == got[5] == [] and all(got[k] == [0] for k in range(35) if k not in (0, 5))


def test_rows_of_numbers(frame):
    rows = [(k, f"{k} {k * 7} {k * 11} {k * 13} {k * 17} {k * 19} {k * 23} {k * 29}\ntotal {k} 1{k} 2{k} 3{k} 4{k}") for k in range(10)]
    rows += [(20 + k, "1 2 3 4 5 6 7 8") for k in range(4)]
    got = dropped(frame, rows)
    assert all(got[k] == [] for k in range(10)) and got[20] == [] and all(got[k] == [0] for k in (21, 22, 23))
