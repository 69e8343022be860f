import random

import pytest

from locusflow.llm.licences import TEMPLATES, THRESHOLD, Matcher, find_licences, normal


def brute(text, templates, threshold):
    """All passages between two template bigrams, by descending coefficient."""
    words = normal(text)
    grams = list(zip(words, words[1:]))
    sets = {n: set(zip(normal(t), normal(t)[1:])) for n, t in templates.items()}
    widest = max(len(normal(t)) - 1 for t in templates.values()) * (2 - threshold) / threshold
    every = set().union(*sets.values())
    found = []
    for i in range(len(grams)):
        for j in range(i, min(len(grams), i + int(widest))):
            if grams[i] in every and grams[j] in every:
                own = set(grams[i : j + 1])
                for name, other in sets.items():
                    dice = 2 * len(own & other) / (len(own) + len(other))
                    if dice >= threshold:
                        found.append((-dice, i - j, i, name, j))
    out, used = [], set()
    for score, _, i, name, j in sorted(found):
        if not used & set(range(i, j + 2)):
            used |= set(range(i, j + 2))
            out.append((name, i, -score))
    return sorted(out, key=lambda x: x[1])


SHORT = {k: v for k, v in TEMPLATES.items() if len(v) < 200}


@pytest.mark.parametrize("seed", range(6))
def test_brute_force(seed):
    draw = random.Random(seed)
    matcher = Matcher(SHORT, 0.7)
    for _ in range(15):
        parts = []
        for _ in range(draw.randint(1, 4)):
            words = draw.choice(list(SHORT.values())).split()
            if draw.random() < 0.6:
                words[draw.randrange(len(words))] = draw.choice(["the", "", "other words", "License,"])
            parts += [" ".join(words), draw.choice(["", "some prose", "licensed under", "the license"])]
        text = draw.choice([" ", "\n"]).join(parts)
        got = matcher.passages(text)
        assert [(n, round(d, 9)) for n, _, _, d in got] == [(n, round(d, 9)) for n, _, d in brute(text, SHORT, 0.7)]
        assert matcher.hit_texts([text])[0]


def test_full_notices(frame):
    rows = [(k, f"Intro line\n{text.upper()}\nend of it") for k, text in enumerate(TEMPLATES.values())]
    rows += [(50, None), (51, ""), (52, "the license of the work is under the sea"), (53, "word " * 100000 + "\nReleased under the MIT License."), (None, "Released under\nthe MIT License"), (0, rows[0][1])]
    found = find_licences(frame(rows), as_column="found").collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    for k, name in enumerate(TEMPLATES):
        hits = got[k].found
        assert [h.template for h in hits] == [name] and hits[0].dice == 1 and normal(got[k].text[hits[0].start : hits[0].end]) == normal(TEMPLATES[name])
    assert [len(got[k].found) for k in (50, 51, 52, 53, None)] == [0, 0, 0, 1, 1]
    assert find_licences(frame([])).count() == 0 and THRESHOLD > 0.8


def test_no_hit_costs_no_scan(small_rows):
    matcher = Matcher(TEMPLATES, THRESHOLD)
    texts = [t for _, t, _ in small_rows]
    for text, hit in zip(texts, matcher.hit_texts(texts)):
        assert hit or matcher.passages(text) == []


@pytest.mark.parametrize("line", ["Released under the MIT License.", "of the Software ", "the License of the License "])
def test_repeated_lines_cost_in_proportion(line):
    import time

    matcher = Matcher(TEMPLATES, THRESHOLD)
    took = []
    for n in (500, 4000):
        start = time.process_time()
        found = matcher.passages(" ".join([line] * n))
        took.append(time.process_time() - start)
        assert len(found) == (n if "MIT" in line else 0)
    assert took[1] < 8 * 3 * took[0] + 1


def test_repeated_short_templates():
    templates = {"a": "one two three", "b": "three one two three one"}
    for text in ("one two three " * 30, "three one " * 9 + "two three one two " * 7):
        got = Matcher(templates, 0.5).passages(text)
        assert [(n, round(d, 9)) for n, _, _, d in got] == [(n, round(d, 9)) for n, _, d in brute(text, templates, 0.5)]
