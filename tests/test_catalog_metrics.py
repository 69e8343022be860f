from itertools import combinations

import numpy as np
import pytest
from locusflow.functions import genotype as G
from locusflow.operators import calls as P
from locusflow.operators import catalog as A
from locusflow.operators import metrics as M
from locusflow.operators import reshape as RS
from locusflow.operators import sampling as Q
from pyspark.sql import functions as F

CALLS = "sampleId string, contig string, start long, end long, ref string, alt string, alleles array<string>"


@pytest.fixture(scope="module")
def hot(spark):
    """Calls with one site and one sample that each hold about a third of all rows."""
    rng = np.random.default_rng(0)
    codes = ["Ref", "Alt", "OtherAlt", "NoCall"]
    rows = []
    for k in range(900):
        start = 5 if k % 3 == 0 else int(rng.integers(0, 40))
        sample = "s0" if k % 3 == 1 else f"s{rng.integers(0, 30)}"
        alleles = [codes[i] for i in rng.integers(0, 4, int(rng.integers(1, 3)))]
        rows.append((sample, str(k % 2), start, start + 1, "A", "CG"[int(rng.integers(0, 2))], alleles))
    return spark.createDataFrame(rows, CALLS).persist(), rows


def dose(alleles):
    return sum(a == "Alt" for a in alleles[:2])


def test_allele_codings(spark):
    cases = [(["Alt", "Alt"], 2, 2), (["Ref", "Alt"], 1, 1), (["OtherAlt", "NoCall"], 0, 2), (["Alt"], 1, 1), ([], 0, 0), (["Alt", "Ref", "Alt"], 1, 2)]
    df = spark.createDataFrame([(c[0],) for c in cases], "alleles array<string>")
    got = [tuple(r) for r in df.select(G.dosage(), G.alt_count_nonref()).collect()]
    assert got == [c[1:] for c in cases]


def test_hot_site_sums_equal_the_plain_join(hot):
    calls, rows = hot
    catalog = A.freq_dosage(calls)
    got = {(r["sampleId"], r["variantId"]): r["altCount"] for r in A.sample_variant_dosage(calls, catalog, 0.0, 9.0).collect()}
    sites = {}
    for _, c, s, _, _, alt, _ in rows:
        sites.setdefault((c, s), set()).add(alt)
    want = {}
    for sample, c, s, _, _, _, a in rows:
        first, second = a[0], a[1] if len(a) > 1 else None
        passes = first != "OtherAlt" or (second is not None and second != "OtherAlt")
        if passes:
            key = (sample, f"{c}:{s}")
            want[key] = want.get(key, 0) + dose(a) * len(sites[c, s])
    assert got == want


@pytest.mark.parametrize("chunk", [3, 1000])
def test_chunked_lists_hold_everything(hot, chunk):
    calls, rows = hot
    lists = A.genotype_list(calls, chunk).collect()
    got = sorted((r["contig"], r["start"], r["alt"], g) for r in lists for g in r["genotype"])
    assert got == sorted({(c, s, alt, f"{sample}:{dose(a)}") for sample, c, s, _, _, alt, a in rows})
    vectors = A.sample_vectors(P.sample_variants(calls), chunk=chunk).collect()
    entries = sorted((r["sampleId"], v["variant"], v["value"]) for r in vectors for v in r["variants"])
    assert len(entries) == P.sample_variants(calls).count()
    if chunk == 3:
        assert max(r["chunk"] for r in lists) > 0 and max(r["chunk"] for r in vectors) > 0


def joined_chunks(rows, keys, column, chunk):
    """Lists put together, after a check that chunks are consecutive and full but for the last."""
    parts = {}
    for r in rows:
        parts.setdefault(tuple(r[k] for k in keys), {})[r["chunk"]] = r[column]
    for chunks in parts.values():
        assert sorted(chunks) == list(range(len(chunks)))
        assert all(len(chunks[c]) == chunk for c in range(len(chunks) - 1)) and 0 < len(chunks[len(chunks) - 1]) <= chunk
    return {k: [x for c in sorted(chunks) for x in chunks[c]] for k, chunks in parts.items()}


@pytest.mark.parametrize("chunk", [1, 3, 20, 1000])
def test_chunks_keep_the_order(spark, chunk):
    """Several values per key, repeated rows, null keys and a sample that holds a third of the rows."""
    rng = np.random.default_rng(8)
    rows = [(f"s{int(s)}", f"v{int(v):02d}", int(d)) for s, v, d in zip(rng.integers(0, 9, 200), rng.integers(0, 40, 200), rng.integers(0, 3, 200))]
    rows += [("s0", f"v{v:02d}", v % 3) for v in range(40)] * 3 + [("s1", None, 1), (None, "v01", 2)]
    long = spark.createDataFrame(rows, "sampleId string, variantId string, altCount int")
    got = joined_chunks(A.sample_vectors(long, chunk=chunk).collect(), ["sampleId"], "variants", chunk)
    order = lambda pair: (pair[0] is not None, pair[0] or "", pair[1])
    assert {k: [tuple(e) for e in v] for k, v in got.items()} == {
        (s,): sorted({(v, d) for t, v, d in rows if t == s}, key=order) for s in {r[0] for r in rows}
    }
    calls = long.select(
        F.lit("1").alias("contig"), F.lit(5).cast("long").alias("start"), F.lit("A").alias("ref"), F.col("variantId").alias("alt"), "sampleId",
        F.array(*[F.when(F.col("altCount") > k, "Alt").otherwise("Ref") for k in (0, 1)]).alias("alleles"),
    ).where("sampleId is not null")
    got = joined_chunks(A.genotype_list(calls, chunk).collect(), P.VARIANT, "genotype", chunk)
    assert got == {
        ("1", 5, "A", v): [f"{s}:{d}" for s, d in sorted({(s, d) for s, w, d in rows if w == v and s is not None})] for v in {r[1] for r in rows}
    }


@pytest.mark.parametrize("span", [1, 7, 1 << 16])
def test_snp_index_is_dense_and_ordered(hot, span):
    calls, _ = hot
    got = A.snp_index(calls.select(*P.VARIANT).distinct(), span).orderBy(*P.VARIANT).collect()
    assert [r["snpIdx"] for r in got] == list(range(len(got)))


def test_sample_index_is_dense_and_repeatable(hot):
    calls, _ = hot
    runs = [{r["sampleId"]: r["sidx"] for r in A.sample_index(calls.repartition(n)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]
    assert sorted(runs[0].values()) == list(range(len(runs[0])))


def test_row_index_follows_the_order(hot):
    calls, _ = hot
    got = A.row_index(calls.select("sampleId").distinct(), "sampleId").collect()
    assert [r["rowIdx"] for r in sorted(got, key=lambda r: r["sampleId"])] == list(range(len(got)))


def test_long_sample_lists_become_a_semi_join(hot):
    calls, rows = hot
    wanted = [f"s{i}" for i in range(0, 3000, 2)]
    assert P.sample_in(calls, wanted).count() == sum(r[0] in set(wanted) for r in rows)


def test_split_keeps_null_rows(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    passes, fails = P.split_by(df, F.col("x") > 0)
    assert (passes.count(), fails.count()) == (1, 2)


def test_off_switches(hot):
    calls, _ = hot
    freq = A.allele_frequency(calls)
    assert P.maf_filter(freq, float("nan")) is freq and P.maf_filter(freq, None) is freq
    assert P.frequency_range(freq, 0.0, 1.0, "alleleFrequency", skip_full_range=True) is freq


def test_wide_table_needs_a_bounded_width(hot, monkeypatch):
    calls, _ = hot
    monkeypatch.setattr(RS, "MAX_COLUMNS", 3)
    with pytest.raises(ValueError):
        RS.pivot_wide(P.sample_variants(calls))


def test_transpose_chunks(spark):
    m = np.arange(35).reshape(7, 5)
    rows = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(m)], "rowIdx long, values array<int>")
    got = RS.transpose(rows, chunk=3).orderBy("colIdx", "chunk").collect()
    assert max(len(r["values"]) for r in got) == 3
    columns = {}
    for r in got:
        columns.setdefault(r["colIdx"], []).extend(r["values"])
    assert [columns[c] for c in range(5)] == m.T.tolist()


def test_splits_partition_the_rows(hot):
    calls, _ = hot
    samples = calls.select("sampleId").distinct()
    for rep in range(3):
        train, test = Q.train_test_split(samples, rep=rep)
        assert train.unionByName(test).distinct().count() == samples.count()
        assert train.join(test, "sampleId").count() == 0
    halves = Q.half_subsamples(samples).groupBy("rep").count().collect()
    n = samples.count()
    assert len(halves) == n // 2 and {r["count"] for r in halves} == {n // 2}


# ---------------------------------------------------------------- metrics


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 4, 200)
    p = np.where(rng.random(200) < 0.6, y, rng.integers(0, 5, 200))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, p int")
    return y, p, M.confusion_matrix(df).persist()


def test_pair_counts_by_loop(labelled):
    y, p, cm = labelled
    r = M.pair_agreement(cm).first()
    want = {"yy": 0, "yn": 0, "ny": 0, "nn": 0}
    for a, b in combinations(range(200), 2):
        want[("y" if y[a] == y[b] else "n") + ("y" if p[a] == p[b] else "n")] += 1
    assert {k: r[k] for k in want} == want


def test_purity_accuracy_and_class_rates(labelled):
    y, p, cm = labelled
    table = np.array([[((y == i) & (p == j)).sum() for j in range(5)] for i in range(5)])
    assert M.purity(cm).first()[0] == pytest.approx(table.max(axis=0).sum() / 200)
    assert M.accuracy(cm).first()[0] == pytest.approx(round(np.trace(table) / 2, 2))
    for r in M.per_class_prf(cm, percent=False).collect():
        c = r["class"]
        precision = table[c, c] / table[:, c].sum()
        assert r["precision"] == pytest.approx(precision)
        if table[c].sum() == 0:
            assert r["recall"] is None
            continue
        recall = table[c, c] / table[c].sum()
        assert r["recall"] == pytest.approx(recall)
        assert r["f1"] == pytest.approx(2 * precision * recall / (precision + recall))


def test_cluster_names_do_not_matter(labelled):
    _, _, cm = labelled
    renamed = cm.withColumn("p", (F.col("p") * 7 + 3) % 11)
    for index in (M.purity, M.rand_index, M.external_indices):
        assert tuple(index(cm).first()) == pytest.approx(tuple(index(renamed).first()))


def test_perfect_labelling(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b")], "y string, p string")
    cm = M.confusion_matrix(df)
    assert M.kappa(cm).first()[0] == 1.0
    assert M.rand_index(cm).first()[0] == 1.0
    assert M.micro_prf(cm).first()[0] == 100.0
