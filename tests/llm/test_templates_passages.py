"""Long lines word for word in two documents, as the query and the pipeline drop them."""

import corpus_pipeline
from pyspark.sql import functions as F

from locusflow.llm.queries import QUERIES
from locusflow.llm.templates import LONG_DOCS, LONG_TOKENS, drop_recurring_lines

PASSAGE = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
NUMBERED = " ".join(f"word{chr(97 + k)}" if k % 5 else f"no{k}" for k in range(25))


def test_passage_in_two_documents(frame):
    rows = [(1, f"one own line of five\n{PASSAGE}"), (2, f"{PASSAGE}\nanother line of its own here"), (3, f"{PASSAGE} more"), (4, "a short line in two documents"), (5, "a short line in two documents")]
    # With digits the line must be the same word for word; equal but for the numbers in two documents is no passage yet.
    other = NUMBERED.replace("word", "term")
    rows += [(6, NUMBERED), (7, NUMBERED + "\n" + NUMBERED), (8, other), (9, other.replace("no5", "no7"))]
    rows += [(10, f"in one document only\n{PASSAGE[::-1]}\n{PASSAGE[::-1]}")]
    got = {r.doc_id: r.dropped_lines for r in drop_recurring_lines(frame(rows), long_docs=LONG_DOCS).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [], 5: [], 6: [], 7: [0, 1], 8: [], 9: [], 10: []}


def test_stage(spark, sf_dir, frame):
    docs = frame([(1, PASSAGE + "\nend"), (2, "begin\n" + PASSAGE)]).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_recurring_lines(spark, docs, sf_dir).collect()}
    assert got == {1: (PASSAGE + "\nend", len(PASSAGE) + 4), 2: ("begin", 5)}


def test_query_leaves_no_long_line_twice(spark, sf_dir, small_rows):
    left = QUERIES["op10_line_templates"](spark, sf_dir).collect()
    assert len(left) == len(small_rows)
    held = {}
    for r in left:
        for line in set((r.text or "").split("\n")):
            if len(line.split()) >= LONG_TOKENS:
                held.setdefault(" ".join(line.split()), []).append(r.doc_id)
    assert [v for v in held.values() if len(v) > 1] == []
