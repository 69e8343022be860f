import math
import random
import re
from collections import Counter, defaultdict

import pytest

from locusflow.llm import templates
from locusflow.llm.templates import drop_recurring_lines, masked


def brute(rows, min_docs=3, long_docs=None):
    """Row number -> numbers of dropped lines."""
    long_docs = min_docs if long_docs is None else long_docs
    lines, docs = [], defaultdict(set)  # a line is (leaf, tokens, words); passages have a leaf of their own
    for k, (doc, text, *_) in enumerate(rows):
        for n, line in enumerate(text.split("\n") if text else ()):
            raw, tokens = tuple(line.split()), tuple(masked(line))
            words = sum(t != templates.WILDCARD for t in tokens) if re.search(r"\d", line) else len(tokens)
            if words < templates.WORD_SHARE * len(raw):
                tokens, words = raw, len(raw)
            if len(raw) < templates.MIN_TOKENS:
                continue
            forms = [((len(raw), tokens[: templates.DEPTH]), tokens, words)]
            if long_docs < min_docs and words < len(raw) and len(raw) >= templates.LONG_TOKENS:
                forms.append((raw, raw, len(raw)))
            for form in forms:
                lines.append((k, (doc is not None, doc or 0, n), n, form))
                docs[form].add(k)
    in_leaf = defaultdict(list)
    for form in docs:
        in_leaf[form[0]].append(form)
    name = {form: form for form in docs}
    for leaf, forms in in_leaf.items():
        if len(forms) < 2 or len(forms[0][1]) < templates.MIN_VARIABLE_TOKENS or sum(len(docs[f]) for f in forms) < min_docs:
            continue
        at = Counter()
        for form in forms:
            for place in fields(form):
                at[place] += len(docs[form])
        for form in forms:
            held = [p for p in fields(form) if at[p] >= min_docs]
            share = math.ceil(templates.CONSTANT_SHARE * form[2])
            if len(held) >= share:
                least = sorted((at[p] for p in held), reverse=True)[share - 1]
                core = tuple(p for p in held if at[p] >= least)
                name[form] = ("core", leaf, core, len(core) < form[2])
    general = {f: name[f][0] == "core" and name[f][3] for f in docs}
    total, first = Counter(), {}
    for form, held in docs.items():
        if general[form] or len(held) >= min_docs:
            total[name[form]] += len(held)
    for _, place, _, form in lines:
        if general[form] or len(docs[form]) >= min_docs:
            first[name[form]] = min(first.get(name[form], place), place)
        first[form, "own"] = min(first.get((form, "own"), place), place)
    out = defaultdict(set)
    for k, place, n, form in lines:
        if (general[form] or len(docs[form]) >= min_docs) and total[name[form]] >= min_docs and place != first[name[form]]:
            out[k].add(n)
        passage = form[2] == len(form[1]) >= templates.LONG_TOKENS and long_docs <= len(docs[form]) < min_docs
        if passage and place != first[form, "own"]:
            out[k].add(n)
    return defaultdict(list, {k: sorted(v) for k, v in out.items()})


def fields(form):
    return [(i, t) for i, t in enumerate(form[1]) if form[2] == len(form[1]) or t != templates.WILDCARD]


def check(df, rows, long_docs=None):
    got = drop_recurring_lines(df.withColumn("before", df.text), long_docs=long_docs).collect()
    wanted = brute(rows, long_docs=long_docs)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.before), r.dropped_lines) for r in got) == sorted((str(d), str(t), wanted[k]) for k, (d, t, *_) in enumerate(rows))
    for r in got:
        if r.before is None:
            assert r.text is None
        else:
            assert r.text == "\n".join(x for n, x in enumerate(r.before.split("\n")) if n not in r.dropped_lines)
    return got


@pytest.mark.parametrize("long_docs", [None, templates.LONG_DOCS])
def test_whole_table(small, small_rows, long_docs):
    assert sum(len(r.dropped_lines) for r in check(small, small_rows, long_docs)) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_templates(frame, seed):
    """Cores of several frequencies, numbers, ties between first places, long lines in two documents."""
    draw = random.Random(seed)
    rows = []
    for k in range(60):
        lines = []
        for _ in range(draw.randrange(1, 6)):
            words = f"it is the line {draw.choice('ab')} {draw.choice('abc')} of {draw.choice('abcdefgh')} {draw.choice(['x', 'y', '7', '8'])} end".split()
            words += draw.choice([[], ["more"] * 3, [str(k)] * 2, [f"w{x}" if x % 6 else "7" for x in range(14)], list("abcdefghijklmn")])
            if draw.random() < 0.2:
                words = [str(draw.randrange(3)) for _ in words]
            lines.append(draw.choice([" ", "  "]).join(words))
        rows.append((k, "\n".join(lines)))
    check(frame(rows + rows[:2]), rows + rows[:2], long_docs=2)
    check(frame(rows), rows)


def test_variable_fields(frame):
    people = ["ann", "bob", "eve", "joe", "kim"]
    rows = [(k, f"own words {p} {p[::-1]} alone {p}\nposted by the user {p} at 1{k}:00 on the site\nshort line") for k, p in enumerate(people)]
    rows += [(50, "posted by the user is a thing that differs wholly here"), (51, "session 17 of 99 was closed"), (52, "session 3 of 4 was closed"), (53, "session 5 of 6 was closed")]
    got = {r.doc_id: r.dropped_lines for r in check(frame(rows), rows)}
    assert got[0] == [] and all(got[k] == [1] for k in range(1, 5)) and got[50] == [] and got[51] == [] and got[52] == [0] == got[53]


def test_passages_and_clean_documents(frame):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"{'abcdefgh'[k]} clean {'ijklmnop'[k]} line {'qrstuvwx'[k]} here\n{passage}\nlast") for k in range(8)] + [(20, "nothing here is seen twice at all")]
    got = {r.doc_id: r for r in check(frame(rows), rows)}
    assert passage in got[0].text and all(passage not in got[k].text and " clean " in got[k].text for k in range(1, 8))
    assert got[20].dropped_lines == []


@pytest.mark.parametrize("rows", [
    [(1, None), (2, ""), (3, "\n\n"), (None, "one two three four five\n"), (4, "one two three four five"), (5, "one two three four five"), (5, "one two three four five")],
    [],
    [(1, "w " * 200000), (2, "w " * 200000), (3, "w " * 200000 + "\nx"), (4, "same line of five words\n" * 50)],
])
def test_edges(frame, rows):
    check(frame(rows), rows)
