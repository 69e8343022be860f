import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from locusflow.llm.language import has_letter
from locusflow.llm.packing import encoder
from locusflow.llm.templates import LONG_DOCS

from .test_contamination import brute as passages
from .test_setsketch import brute as near
from .test_templates import brute as lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if "text" in docs.columns:
            docs = docs.persist()
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_each_stage(spark, sf_dir, stages):
    start, spoken, deduped, single, clean, packed = stages
    assert sorted(rows(spoken), key=str) == sorted((r for r in rows(start) if has_letter(r[1])), key=str)
    before = rows(spoken)
    gone = lines(before, long_docs=LONG_DOCS)
    wanted = {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, (d, t, _) in enumerate(before)}
    assert {d: t for d, t, _ in rows(deduped)} == wanted
    assert deduped.where(F.col("n_chars") != F.length("text")).count() == spoken.where(F.col("n_chars") != F.length("text")).count()
    _, label = near(rows(deduped), 5)
    assert {d for d, *_ in rows(single)} == {d for d in label if label[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {d: passages(t, items)[:2] for d, t, _ in rows(single) if d < 60}
    assert {d for d, *_ in rows(clean) if d < 60} == {d for d, (n, hit) in windows.items() if not (hit and 20 * hit >= n)}
    total = sum(len(encoder().ids(t or "")) + 1 for _, t, _ in rows(clean))
    assert packed.agg(F.sum("length")).first()[0] == total


def test_odd_documents(spark, sf_dir):
    odd = [(1, None), (2, ""), (3, "!! 12"), (None, "a text without an id"), (None, "another text without an id"), (4, "word " * 50000), (4, "word " * 50000), (5, "x")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    assert docs.where("doc_id is null").count() == 2 and docs.where("doc_id = 5").count() == 1 and docs.where("doc_id in (1, 2, 3)").count() == 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_repeated_ids_lose_no_text(spark, sf_dir):
    """A text that is no copy of anything stays, whatever other rows have its id; of copies with one id one stays."""
    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(3, base[0]), (5, base[0]), (5, base[1]), (7, base[2]), (9, base[3]), (9, base[3] + " more"), (None, base[0]), (None, base[0]), (2**60 + 1, "p q r"), (2**60 + 3, "s t u")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()}
    nines = {x for x in got if x[0] == 9}
    assert len(nines) == 1
    assert got - nines == {(3, base[0]), (5, base[1]), (7, base[2]), (None, base[0]), (2**60 + 1, "p q r"), (2**60 + 3, "s t u")}
