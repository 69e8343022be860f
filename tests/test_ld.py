import numpy as np
import pytest
from locusflow.functions import ld as LDF
from locusflow.operators import ld as L
from pyspark.sql import functions as F

MISSING = 3

# Golden pairs (first, second, composite, r, D').
GOLDEN = {
    "ref": ([0] * 14 + [1, 0, 0, 0], [0, 2, 0, 2, 2, 1, 1, 1, 0, 0, 2, 0, 2, 2, 1, 1, 1, 3], -0.0183308894, -0.1846277427, 0.9999485816),
    "hwe": ([0, 1, 2, 1, 0, 2, 1, 1, 0, 2], [0, 1, 2, 1, 1, 2, 0, 1, 0, 1], 0.7377111136, 0.6845064611, 0.7567503660),
    "anti": ([0, 0, 1, 1, 2, 2, 0, 2], [2, 2, 1, 1, 0, 0, 2, 0], -1.0, -1.0, 1.0),
    "miss": ([0, 1, 3, 2, 1, 0], [0, 1, 2, 3, 2, 1], 0.7071067812, 0.5773502108, 0.9999998989),
    "mono": ([0, 0, 0, 0], [0, 1, 2, 1], np.nan, np.nan, np.nan),
    "allmiss": ([3, 3], [0, 1], np.nan, np.nan, np.nan),
}


def calls_from(spark, matrices):
    """{contig: samples x SNPs} → long dosage table, positions 1000 apart."""
    rows = [
        (f"s{s:03d}", contig, i, i * 1000, int(g))
        for contig, m in matrices.items() for s, row in enumerate(m) for i, g in enumerate(row)
    ]
    return spark.createDataFrame(rows, "sampleId string, contig string, idx long, start long, dosage int")


def numpy_corr(x, y):
    ok = (x != MISSING) & (y != MISSING)
    if ok.sum() == 0 or x[ok].std() == 0 or y[ok].std() == 0:
        return np.nan
    return np.corrcoef(x[ok], y[ok])[0, 1]


def greedy(matrix, threshold, max_bp, max_n, start=None, cross=False):
    n = matrix.shape[1]
    start = 0 if start is None else start

    def scan(order, kept_before):
        kept = []
        for i in order:
            window = [j for j in kept + kept_before if abs(i - j) <= max_n and abs(i - j) * 1000 <= max_bp]
            if all(abs(numpy_corr(matrix[:, i], matrix[:, j])) <= threshold for j in window):
                kept.append(i)
        return kept

    up = scan(range(start, n), [])
    down = scan(range(start - 1, -1, -1), up if cross else [])
    return sorted(up + down)


@pytest.fixture(scope="module")
def golden_counts(spark):
    calls = calls_from(spark, {k: np.array([v[1], v[0]]).T for k, v in GOLDEN.items()})
    return L.pair_counts(L.snp_vectors(calls)).persist()


@pytest.mark.parametrize("method, column", [("composite", 2), ("corr", 2), ("r", 3), ("dprime", 4)])
def test_golden_values(golden_counts, method, column):
    got = {r["contig"]: r["ld"] for r in L.ld_value(golden_counts, method).collect()}
    assert set(got) == set(GOLDEN)
    for name, row in GOLDEN.items():
        assert got[name] == pytest.approx(row[column], abs=1e-6, nan_ok=True), name


def test_composite_is_correlation_and_em_is_a_distribution(spark):
    rng = np.random.default_rng(5)
    calls = calls_from(spark, {"a": rng.integers(0, 4, (60, 12)), "b": rng.integers(0, 3, (60, 7))})
    counts = L.pair_counts(L.snp_vectors(calls))
    rows = L.ld_value(L.ld_value(L.ld_value(counts, "composite", "a"), "corr", "b"), "dprime", "d")
    rows = L.haplotypes(rows).select("a", "b", "d", "hap").collect()
    assert len(rows) == 66 + 21
    for r in rows:
        assert r["a"] == pytest.approx(r["b"], abs=1e-12)
        assert -1e-12 <= r["d"] <= 1 + 1e-12
        assert sum(r["hap"]) == pytest.approx(1.0, abs=1e-9)


def test_unknown_method(golden_counts):
    with pytest.raises(ValueError):
        L.ld_value(golden_counts, "cosine")


@pytest.mark.parametrize("max_bp, max_n, tile, chunk", [(4000, None, 3, 1000), (None, 5, 4, 7), (6000, 3, 2, 16), (None, None, 100, 9)])
def test_pair_counts_by_brute_force(spark, max_bp, max_n, tile, chunk):
    rng = np.random.default_rng(11)
    matrices = {"x": rng.integers(0, 4, (30, 17)), "y": rng.integers(0, 4, (30, 9))}
    vectors = L.snp_vectors(calls_from(spark, matrices), chunk=chunk)
    got = {(r["contig"], r["i"], r["j"]): [r[c] for c in LDF.CELLS] for r in L.pair_counts(vectors, max_bp, max_n, tile).collect()}
    want = {}
    for contig, m in matrices.items():
        for i in range(m.shape[1]):
            for j in range(i):
                if (max_n is None or i - j <= max_n) and (max_bp is None or (i - j) * 1000 <= max_bp):
                    want[contig, i, j] = [int(((m[:, i] == x) & (m[:, j] == y)).sum()) for x in range(3) for y in range(3)]
    assert got == want


@pytest.mark.parametrize(
    "threshold, max_bp, max_n, start, cross",
    [(0.2, 10**9, 10**9, None, False), (0.1, 5000, 10**9, None, False), (0.15, 10**9, 6, 9, False), (0.15, 8000, 10**9, 9, True)],
)
def test_pruning_by_brute_force(spark, monkeypatch, threshold, max_bp, max_n, start, cross):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, (40, 26))
    for i in range(1, 26, 2):  # copies with noise, some monomorphic and some missing columns
        base[:, i] = np.where(rng.random(40) < 0.7, base[:, i - 1], base[:, i])
    base[:, 8] = 1
    base[:, 15] = MISSING
    base[rng.random(base.shape) < 0.03] = MISSING
    vectors = L.snp_vectors(calls_from(spark, {"c": base}))
    pairs = L.ld_value(L.pair_counts(vectors, max_bp, max_n, tile=5), "corr").select("contig", "i", "j", "ld")
    conflicts = L.orient(pairs.filter(LDF.is_conflict(F.col("ld"), threshold)), start, cross)
    for segment, most in ((4, 1), (4, 20), (1000, 1 << 18)):  # segments that wait for each other, wider groups, and one
        dropped = {r["node"] for r in L.greedy_dropped(conflicts, start, segment, most).collect()}
        assert sorted(set(range(26)) - dropped) == greedy(base, threshold, max_bp, max_n, start, cross)


def test_pruning_keeps_an_independent_maximal_set(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(0, 3, (50, 30))
    kept = {r["idx"] for r in L.ld_prune(calls_from(spark, {"c": m}), "composite", 0.12, max_bp=12_000).collect()}

    def clash(i, j):
        return abs(i - j) <= 12 and not abs(numpy_corr(m[:, i], m[:, j])) <= 0.12

    assert not any(clash(i, j) for i in kept for j in kept if i < j)
    assert all(any(clash(i, j) for j in kept if j < i) for i in set(range(30)) - kept)


def test_chain_over_many_segments_settles_in_few_rounds(spark, monkeypatch):
    """Every SNP of 100 segments conflicts with the one before it: each waits for the whole chain below."""
    rounds = []
    settle = L._settle
    monkeypatch.setattr(L, "_settle", lambda start: rounds.append(start) or settle(start))
    edges = spark.range(1, 1000).selectExpr("'c' AS scan", "id AS later", "id - 1 AS earlier")
    dropped = L.greedy_dropped(edges, segment=10, most=40)
    assert sorted(r["node"] for r in dropped.collect()) == list(range(1, 1000, 2))
    assert len(rounds) <= 30  # a round settles one group of the chain, 4 segments and more
    rounds.clear()
    dropped = L.greedy_dropped(edges, segment=10)
    assert sorted(r["node"] for r in dropped.collect()) == list(range(1, 1000, 2)) and len(rounds) == 1
    plan = dropped._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan


def test_no_edges(spark):
    edges = spark.createDataFrame([], "scan string, later long, earlier long")
    assert L.greedy_dropped(edges).collect() == []


@pytest.mark.parametrize("bits", [62, 3])
def test_grid_equals_separate_runs(spark, monkeypatch, bits):
    """All points in one mask, and in several words of three bits."""
    monkeypatch.setattr(L, "MASK_BITS", bits)
    rng = np.random.default_rng(21)
    base = rng.integers(0, 3, (30, 20))
    for i in range(1, 20, 2):
        base[:, i] = np.where(rng.random(30) < 0.7, base[:, i - 1], base[:, i])
    base[:, 4] = 0
    calls = calls_from(spark, {"c": base, "d": base[:, ::-1]})
    thresholds, mafs = (0.05, 0.2, 0.6), (None, 0.45)
    got = {tuple(r) for r in L.ld_prune_grid(calls, thresholds, mafs, "corr", max_bp=9000).collect()}
    want = set()
    share = calls.groupBy("contig", "idx").agg((F.sum("dosage") / (2 * F.count("dosage"))).alias("f"))
    for maf in mafs:
        some = calls if maf is None else calls.join(share.filter(F.least("f", 1 - F.col("f")) >= maf), ["contig", "idx"], "left_semi")
        for t in thresholds:
            want |= {(r["contig"], r["idx"], t, maf) for r in L.ld_prune(some, "corr", t, max_bp=9000).collect()}
    assert got == want


def test_pruning_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(9)
    calls = calls_from(spark, {"c": rng.integers(0, 3, (30, 24)), "d": rng.integers(0, 3, (30, 24))})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = set()
    try:
        for parts in ("1", "4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            kept = L.ld_prune(calls.repartition(int(parts)), "corr", 0.15).collect()
            found.add(tuple(sorted((r["contig"], r["idx"]) for r in kept)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_window_join_equals_all_pairs_filter(spark):
    rng = np.random.default_rng(2)
    pos = np.sort(rng.integers(0, 5000, 60))
    snps = spark.createDataFrame([("c", i, int(p)) for i, p in enumerate(pos)], "contig string, idx long, start long")
    got = {(r["i"], r["j"]) for r in L.window_pair_join(snps, 300, 7).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i) if pos[i] - pos[j] <= 300 and i - j <= 7}


# ---------------------------------------------------------------- routing and tile width


def _calls(spark, positions, samples=6, seed=11):
    rng = np.random.default_rng(seed)
    rows = [("1", k, int(p), f"s{s}", int(rng.integers(0, 3))) for k, p in enumerate(positions) for s in range(samples)]
    return spark.createDataFrame(rows, "contig string, idx int, start long, sampleId string, dosage int")


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_pairs_do_not_depend_on_number_order(spark, order):
    positions = np.sort(np.random.default_rng(7).choice(20_000, 40, replace=False))
    if order == "falling":
        positions = positions[::-1]
    if order == "shuffled":
        positions = np.random.default_rng(8).permutation(positions)
    got = L.pair_counts(L.snp_vectors(_calls(spark, positions)), 5_000, tile=8).select("i", "j").collect()
    wanted = {(i, j) for i in range(40) for j in range(i) if abs(positions[i] - positions[j]) <= 5_000}
    assert {(r.i, r.j) for r in got} == wanted and len(got) == len(wanted)


def test_tile_size_follows_the_highest_sample_number(spark, monkeypatch):
    """Few known calls among a million sample numbers: the rows of a tile shrink accordingly."""
    sizes = []
    monkeypatch.setattr(L.TL, "tile_size", lambda rows, width: sizes.append(width) or 8)
    rows = [("1", k, 100 * k, 0, [5, 999_999], [1, 2]) for k in range(4)]
    vectors = spark.createDataFrame(rows, "contig string, idx long, pos long, chunk int, s array<int>, d array<tinyint>")
    assert L.pair_counts(vectors, 500_000).count() == 6 and sizes == [1_000_000]


def test_contradicting_calls_do_not_depend_on_row_order(spark):
    rows = [("1", 0, 5, "a", 0), ("1", 0, 5, "a", 2), ("1", 1, 9, "a", 1), ("1", 1, 9, "b", 1), ("1", 0, 5, "b", 1)]
    schema = "contig string, idx int, start long, sampleId string, dosage int"
    found = [L.pair_counts(L.snp_vectors(spark.createDataFrame(r, schema).coalesce(1)), 100).collect() for r in (rows, rows[::-1])]
    assert found[0] == found[1]


@pytest.mark.parametrize("max_n", [None, 6])
@pytest.mark.parametrize("tile", [1, 5, 1024])
def test_pair_join_in_crowded_and_empty_stretches(spark, tile, max_n):
    """Most sites in a few positions, wide gaps, equal positions, numbers against the order of positions, nulls."""
    rng = np.random.default_rng(31)
    rows = []
    for contig, n in (("1", 90), ("2", 7), ("3", 1)):
        spots = np.where(rng.random(n) < 0.6, rng.integers(5000, 5040, n), rng.integers(0, 200_000, n))
        rows += [(contig, int(i), int(p)) for i, p in zip(rng.permutation(n), spots)]
    df = spark.createDataFrame([*rows, ("1", None, 5000), ("1", 500, None), (None, 3, 5000)], "contig string, idx long, start long")
    got = sorted(tuple(r) for r in L.window_pair_join(df, 25, max_n, tile=tile).collect())
    assert got == sorted(
        (c, i, p, j, q) for c, i, p in rows for d, j, q in rows if c == d and i > j and abs(p - q) <= 25 and (max_n is None or i - j <= max_n)
    )


def test_crowded_stretch_is_split_by_count(spark):
    """No key of the join holds more than two tiles of sites, and tiles beyond the halo do not meet."""
    rows = [("1", k, 1000 + k // 50) for k in range(1000)] + [("1", 1000 + k, 10_000_000 * (k + 1)) for k in range(200)]
    tiled = L.position_tiles(spark.createDataFrame(rows, "contig string, idx long, pos long"), 20)
    assert {r["count"] for r in tiled.groupBy("contig", "tile").count().collect()} == {20}
    pairs = {(r["t"], r["u"]) for r in L.neighbour_tiles(tiled, 3).collect()}
    ends = {t: (min(p), max(p)) for t in range(60) for p in [[r[2] for r in rows[20 * t : 20 * t + 20]]]}
    assert pairs == {(t, u) for t in ends for u in range(t + 1) if t == u or ends[t][0] - ends[u][1] <= 3}
    assert len(pairs) < 50 * 12 + 11
