"""Operators of the base-modification engine on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import kernels
from strandlake.functions.codes import ModSpec, measures
from strandlake.operators import calls as call_ops
from strandlake.operators import collapse, diff, intervals, qc, summarize
from strandlake.sources import ingest, stats

CALLS = "sample_name string, read_id string, chrom string, start bigint, `end` bigint, read_position bigint, query_kmer string, call_code string, read_length bigint, call_prob double, base_qual bigint, flag int"


def call(sample="A", read="r1", chrom="chr1", start=10, code="m", end=None, position=5, length=100, prob=0.95, qual=20):
    return (sample, read, chrom, start, start + 2 if end is None else end, position, "CG", code, length, prob, qual, 0)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, CALLS)


# (sample, start, calls, modified calls) of two sites
SITES = [("t1", 5000, 14, 9), ("t2", 5000, 6, 5), ("u1", 5000, 9, 2), ("u2", 5000, 13, 4), ("t1", 5400, 7, 1), ("t2", 5400, 16, 3), ("u1", 5400, 10, 6), ("u2", 5400, 5, 2)]


@pytest.fixture(scope="module")
def two_loci(spark):
    return spark.createDataFrame([(s, "chr1", a, a + 1, n, m) for s, a, n, m in SITES], "sample_name string, chrom string, start bigint, `end` bigint, num_calls bigint, mh_counts bigint")


def by_counting(case, control):
    """(mid-p, exact p) of two (calls, modified calls), over all ways to draw the case's calls."""
    (n, a), (m, b) = case, control
    ways = {x: math.comb(a + b, x) * math.comb(n + m - a - b, n - x) for x in range(n + 1) if 0 <= a + b - x <= m}
    total = sum(ways.values())
    right, left = sum(w for x, w in ways.items() if x > a), sum(w for x, w in ways.items() if x < a)
    return (2 * min(right, left) + ways[a]) / total, sum(w for w in ways.values() if w <= ways[a]) / total


POOLED = {start: [tuple(sum(x[k] for x in SITES if x[1] == start and x[0][0] == g) for k in (2, 3)) for g in "tu"] for start in (5000, 5400)}


# --- kernels ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", [(9, 4, 2, 11), (5, 5, 6, 4), (13, 0, 1, 9), (20, 7, 11, 16)])
def test_exact_tests(table):
    """Modified and other calls of the case, then of the control."""
    a, b, c, d = table
    mid, exact = by_counting((a + b, a), (c + d, c))
    assert kernels.mid_p([a], [a + c], [b + d], [a + b])[0] == pytest.approx(mid, rel=1e-9)
    assert kernels.fisher_exact([a], [a + c], [b + d], [a + b])[0] == pytest.approx(exact, rel=1e-9)


def test_empty_case_has_p_one():
    assert kernels.mid_p([0], [4], [6], [0])[0] == pytest.approx(1.0)


def test_large_counts_and_blocks(monkeypatch):
    assert kernels.log_factorial(np.array([70_000]))[0] == pytest.approx(math.lgamma(70_001), rel=1e-13)
    whole = kernels.mid_p([5, 90, 3], [50, 200, 9], [60, 300, 9], [20, 210, 8])
    monkeypatch.setattr(kernels, "LAID_OUT", 10)
    assert kernels.mid_p([5, 90, 3], [50, 200, 9], [60, 300, 9], [20, 210, 8]) == pytest.approx(whole)


def test_wilcoxon():
    assert kernels.wilcoxon([1, 2, 3], [4, 5, 6]) == pytest.approx(0.1)
    assert kernels.wilcoxon([1.0], []) is None and kernels.wilcoxon([2, 2], [2, 2]) is None
    assert kernels.wilcoxon([1, 2, None, math.nan], [3]) == pytest.approx(2 / 3)
    assert 0 < kernels.wilcoxon([1, 2, 2, 3], [2, 4, 5, 6]) < 0.2
    x = kernels.wilcoxon(range(60), range(30, 90))
    assert 0 < x < 1e-6


def test_likelihood_ratio():
    g, p = kernels.log_likelihood_ratio([7, 5, 0], [3, 5, 0], [3, 5, 4], [7, 5, 6])
    assert g[0] == pytest.approx(3.291315, abs=1e-5) and p[0] == pytest.approx(0.069647, abs=1e-5)
    assert (g[1], p[1]) == (pytest.approx(0), pytest.approx(1)) and p[2] == 1


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_mid_p_is_at_most_exact_scale(tables):
    a, b, c, d = np.array(tables).T
    p = kernels.mid_p(a, a + b, c + d, a + c)
    assert ((p > 0) & (p <= 1 + 1e-9)).all()


# --- codes ----------------------------------------------------------------------------------------------------


def test_specs():
    assert ModSpec.parse(" m + h ") == ModSpec("mh", ("m", "h")) and ModSpec.parse("21839").label == "m_21839"
    assert [m.label for m in measures()] == ["c", "m", "h", "mh"]
    with pytest.raises(ValueError, match="repeat"):
        measures(["m", "m"])
    with pytest.raises(ValueError, match="empty"):
        ModSpec.parse(" + ")


# --- summaries --------------------------------------------------------------------------------------------------


def test_positions(frame):
    rows = [call(code="m"), call(code="-"), call(code="h", start=12), call(start=0), call(chrom="X"), call(sample="B", code="21839")]
    out = {(r.sample_name, r.start): r for r in summarize.positions(frame(rows), mod_code=["m", "h", "m + h", "21839"]).collect()}
    assert set(out) == {("A", 10), ("A", 12), ("B", 10)}
    assert out["A", 10].num_calls == 2 and out["A", 10].m_frac == 0.5 and out["A", 10].end == 10 and out["B", 10].m_21839_counts == 1
    assert summarize.positions(frame(rows), chrs=None).where("chrom = 'X'").count() == 1
    with pytest.raises(ValueError, match="none"):
        summarize.positions(frame(rows), samples=["Z"])


def loop_windows(positions, size, step):
    """One tiling after another."""
    out = {}
    for offset in range(1, size, step):
        for start, n in positions:
            d = start - offset
            at = start - int(math.copysign(abs(d) % size, d))
            k = out.setdefault((at, at + size - 1), [0, 0])
            k[0] += 1
            k[1] += n
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize(("size", "step"), [(100, 10), (100, 100), (60, 20), (90, 40), (2, 1), (10, 50)])
def test_windows_equal_the_loop(frame, size, step):
    starts = [1, 3, 7, 40, 41, 99, 100, 101, 205, 333]
    rows = [call(start=s, read=f"r{i}") for s in starts for i in range(s % 3 + 1)]
    want = loop_windows([(s, s % 3 + 1) for s in starts], size, step)
    for prebin in (True, False):
        got = {(r.start, r.end): (r.num_CpGs, r.num_calls) for r in summarize.windows(frame(rows), window_size=size, step_size=step, prebin=prebin).collect()}
        assert got == want


def test_window_edges_and_arguments(frame):
    rows = frame([call(start=40)])
    assert {r.start for r in summarize.windows(rows, window_size=100, step_size=50).collect()} == {1, 51}
    assert {r.start for r in summarize.windows(rows, window_size=100, step_size=50, edge="floor").collect()} == {1, -49}
    for bad in ({"window_size": 1}, {"step_size": 0}, {"edge": "x"}):
        with pytest.raises(ValueError):
            summarize.windows(rows, **bad)


def regions_of(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start bigint, `end` bigint, region_name string")


def test_regions(spark, frame):
    rows = frame([call(start=10), call(start=20, code="-"), call(start=500), call(sample="B", start=10)])
    where = regions_of(spark, [("chr1", 5, 20, "a"), ("chr1", 15, 30, "b"), ("chr2", 1, 9, "none")])
    inner = {(r.sample_name, r.region_name): (r.num_CpGs, r.num_calls, r.m_frac) for r in summarize.regions(rows, where).collect()}
    assert inner == {("A", "a"): (2, 2, 0.5), ("A", "b"): (1, 1, 0.0), ("B", "a"): (1, 1, 1.0)}
    left = [(r.sample_name, r.region_name) for r in summarize.regions(rows, where, "left").collect()]
    assert sorted(left, key=str) == sorted([*inner, ("A", None)], key=str)
    right = summarize.regions(rows, where, "right", min_num_calls=0).collect()
    assert sorted((str(r.sample_name), r.region_name, r.num_CpGs, r.num_calls) for r in right if r.sample_name is None) == [("None", "b", 1, 0), ("None", "none", 1, 0), ("None", "none", 1, 0)]
    half = summarize.regions(rows, where, half_open=True).where("region_name = 'a' AND sample_name = 'A'").first()
    assert half.num_calls == 1
    bare = regions_of(spark, [("1", 5, 20, "a")])
    assert summarize.regions(rows, bare).count() == 2 and summarize.regions(rows, bare, harmonize=False).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_interval_joins_broadcast_or_bucketed(spark, limit):
    points = spark.createDataFrame([("c", p) for p in (5, 9_999, 10_000, 25_000, 60_000)], "chrom string, start bigint")
    where = spark.createDataFrame([("c", 0, 30_000), ("c", 9_999, 10_000), ("d", 0, 99_999)], "r_chrom string, r_start bigint, r_end bigint")
    found = intervals.points_in_regions(points, where, broadcast_rows=limit).select("start", "r_start").collect()
    assert sorted(map(tuple, found)) == [(5, 0), (9_999, 0), (9_999, 9_999), (10_000, 0), (10_000, 9_999), (25_000, 0)]
    assert intervals.points_in_regions(points, where, "left", broadcast_rows=limit).where("r_start IS NULL").count() == 1
    reads = spark.createDataFrame([(1, "c", 5, 25_000), (2, "c", 31_000, 31_001), (3, "c", 10_001, 40_000)], "id int, chrom string, a bigint, b bigint")
    keys = where.selectExpr("r_chrom AS k_chrom", "r_start AS k_start", "r_end AS k_end")
    pairs = intervals.overlapping(reads, "a", "b", keys, broadcast_rows=limit).select("id", "k_start").collect()
    assert sorted(map(tuple, pairs)) == [(1, 0), (1, 9_999), (3, 0)]


def test_reads(spark, frame):
    rows = [call(start=s, code=c) for s, c in ((9_000, "m"), (9_500, "h"), (12_000, "-"), (13_000, "m"), (14_000, "m"))]
    one = summarize.reads(frame(rows)).first()
    assert (one.total_calls, one.first_cpg_pos, one.last_cpg_pos, one.mh_counts, one.m_frac) == (5, 9_000, 14_002, 4, 0.6)
    where = regions_of(spark, [("chr1", 9_000, 13_500, "a")])
    assert summarize.reads(frame(rows), where, min_CGs=1).first().total_calls == 4
    assert summarize.reads(frame(rows), where, min_CGs=1, legacy_bucket=True).first().total_calls == 2
    assert summarize.reads(frame(rows), min_length=101).count() == 0


# --- calls --------------------------------------------------------------------------------------------------------


def test_trim_is_decimal(frame):
    rows = frame([call(position=p) for p in (6, 7, 92, 93)])
    assert sorted(r.read_position for r in call_ops.trim(rows, 0.07, trim_start=True).collect()) == [7, 92]
    for bad in ({"by_frac": 0}, {"by_frac": 1}, {"trim_end": False}):
        with pytest.raises(ValueError):
            call_ops.trim(rows, **bad)


def test_rename(frame):
    rows = frame([call(sample=s) for s in "ABC"])
    names = lambda df: sorted(r.sample_name for r in df.collect())
    assert names(call_ops.rename_samples(rows, {"A": "B", "B": "A"})) == ["A", "B", "C"]
    for bad in ({"A": ""}, {"Z": "Q"}, [("A", "x"), ("A", "y")]):
        with pytest.raises(ValueError):
            call_ops.rename_samples(rows, bad)
        with pytest.warns(UserWarning):
            call_ops.rename_samples(rows, bad, strict=False)
    with pytest.warns(UserWarning, match="merged"):
        assert names(call_ops.rename_samples(rows, {"A": "x", "B": "x"})) == ["C", "x", "x"]


def test_filter_and_sample(frame):
    rows = frame([call(start=s) for s in range(1, 9)])
    assert call_ops.filter_rows(rows, "start > 2", F.col("start") < 5).count() == 2
    with pytest.raises(ValueError, match="can't be applied"):
        call_ops.filter_rows(rows, "nothing > 1")
    assert call_ops.sample_rows(rows, 3).count() == 3 and call_ops.sample_rows(rows, 30).count() == 8
    with pytest.raises(ValueError):
        call_ops.sample_rows(rows, 30, strict=True)


# --- differences -------------------------------------------------------------------------------------------------------

CASES, CONTROLS = ["t1", "t2"], ["u1", "u2"]


@pytest.mark.parametrize(("test", "kind"), [("fast_fisher", 0), ("r_fisher", 1)])
def test_two_loci(two_loci, test, kind):
    rows = diff.calc_diff(two_loci, CASES, CONTROLS, "mh", test).orderBy("start").collect()
    p = [by_counting(*POOLED[r.start])[kind] for r in rows]
    assert [r.p_val for r in rows] == pytest.approx(p, rel=1e-9)
    assert [r.meth_diff for r in rows] == pytest.approx([a / n - b / m for (n, a), (m, b) in POOLED.values()])
    assert [r.p_adjust for r in rows] == pytest.approx([min(2 * min(p), max(p)) if x == min(p) else x for x in p])
    assert {"mh_counts_case", "c_counts_control", "mh_frac_case", "num_calls_control"} <= set(rows[0].asDict())


def test_diff_choices_and_errors(spark, two_loci):
    assert diff.chosen_test(CASES, CONTROLS) == "fast_fisher" and diff.chosen_test(range(5), range(5)) == "wilcox"
    w = diff.calc_diff(two_loci, CASES, CONTROLS, "mh", "wilcox").orderBy("start").collect()
    assert w[0].num_samples_case == 2 and w[0].meth_diff == pytest.approx((9 / 14 + 5 / 6) / 2 - (2 / 9 + 4 / 13) / 2) and w[0].p_val == pytest.approx(1 / 3)
    assert 0 < diff.calc_diff(two_loci, CASES, CONTROLS, "mh", "log_reg").first().p_val < 1
    for args, text in ((["nobody"], "case"), (CASES, "no measure"), (CASES, "unknown calc_type")):
        with pytest.raises(ValueError, match=text):
            diff.calc_diff(two_loci, args, CONTROLS, "h" if text == "no measure" else "mh", "x" if "unknown" in text else "fast_fisher").collect()
    with pytest.raises(ValueError, match="control"):
        diff.calc_diff(two_loci, CASES, ["nobody"], "mh", "fast_fisher")
    c = two_loci.withColumnRenamed("mh_counts", "c_counts")
    assert {"c_counts_case", "other_counts_case"} <= set(diff.calc_diff(c, CASES, CONTROLS, "c", "fast_fisher").columns)
    alone = diff.calc_diff(two_loci.where("sample_name NOT IN ('u1', 'u2') OR start = 5000"), CASES, CONTROLS, "mh", "fast_fisher").where("start = 5400").first()
    assert alone.meth_diff is None and alone.mh_frac_control is None


@given(st.lists(st.one_of(st.none(), st.floats(0, 1), st.sampled_from([0.0, 0.01, 0.5, 1e-9, 1.0])), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None)
def test_bh(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p_val double")
    p = [v for v in values if v is not None]
    want = {}
    for v in p:
        want[v] = min([1.0, *(u * len(p) / sum(x <= u for x in p) for u in p if u >= v)])
    for r in diff.bh_adjust(df).collect():
        assert r.p_adjust is None if r.p_val is None else r.p_adjust == pytest.approx(want[r.p_val], rel=1e-12)


def test_collapse_and_classify(spark):
    rows = [("c", 1, 100, 0.01, 0.6), ("c", 51, 150, 0.01, 0.8), ("c", 300, 399, 0.01, -0.7), ("c", 1401, 1500, 0.01, -0.6), ("c", 9000, 9099, 0.01, -0.9), ("c", 9100, 9199, 0.2, -0.9), ("d", 1, 100, 0.01, 0.4)]
    df = spark.createDataFrame([(*r, r[4] + 0.1, 0.1) for r in rows], "chrom string, start bigint, `end` bigint, p_adjust double, meth_diff double, mh_frac_case double, mh_frac_control double")
    out = collapse.collapse_windows(df).orderBy("start").collect()
    assert [(r.start, r.end, r.num_windows) for r in out] == [(1, 150, 2), (300, 399, 1), (1401, 1500, 1), (9000, 9099, 1)]
    assert out[0].avg_meth_diff == pytest.approx(0.7) and out[0].avg_mh_frac_control == pytest.approx(0.1)
    assert collapse.collapse_windows(df, max_distance=1002).count() == 3


@pytest.mark.parametrize("block", [1, 70, 400, 1 << 30])
def test_islands_go_on_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(collapse, "BLOCK", block)
    rng = np.random.default_rng(3)
    starts = {c: np.unique(rng.integers(0, 4000, 90)).tolist() for c in "ab"}
    rows = [(c, s, s + 20, 0.01, float(rng.choice([0.6, 0.7, -0.8], p=[0.6, 0.3, 0.1]))) for c in "ab" for s in starts[c]]
    want = []
    for c, s, e, _, d in rows:
        if want and want[-1][0] == c and s - want[-1][2] <= 30 and (want[-1][4] > 0) == (d > 0):
            want[-1] = [c, want[-1][1], e, want[-1][3] + 1, d]
        else:
            want.append([c, s, e, 1, d])
    df = spark.createDataFrame(rows, "chrom string, start bigint, `end` bigint, p_adjust double, meth_diff double")
    got = sorted((r.chrom, r.start, r.end, r.num_windows) for r in collapse.collapse_windows(df, max_distance=30).collect())
    assert got == sorted(tuple(w[:4]) for w in want)


def test_classify(spark):
    reads = spark.createDataFrame([("A", "r1", "c", 10, 20, 0.15), ("A", "r2", "c", 140, 310, 0.75), ("A", "r3", "c", 700, 800, 0.5)], "sample_name string, read_id string, chrom string, first_cpg_pos bigint, last_cpg_pos bigint, mh_frac double")
    key = spark.createDataFrame([("c", 1, 150, 0.1, 0.8, 0.7), ("c", 300, 399, 0.4, 0.0, -0.4)], "chrom string, start bigint, `end` bigint, avg_mh_frac_control double, avg_mh_frac_case double, avg_meth_diff double")
    got = sorted((r.read_id, r.classification) for r in collapse.classify_reads(reads, key, "case", "control").collect())
    assert got == [("r1", "control"), ("r2", "case"), ("r2", "unknown")]
    with pytest.raises(ValueError, match="half"):
        collapse.classify_reads(reads, key, "case", "control", 0.2)


# --- quality control -------------------------------------------------------------------------------------------------------


def test_qc(spark):
    rng = np.random.default_rng(1)
    base = rng.random(30)
    rows = [(s, "c", i, i, 1 + i % 4, float(np.clip(base[i] + rng.normal(0, 0.1), 0, 1)) if s != "flat" else 0.5) for s in ("a", "b", "flat") for i in range(30) if (s, i) != ("b", 3)]
    df = spark.createDataFrame(rows, "sample_name string, chrom string, start bigint, `end` bigint, num_calls bigint, m_frac double")
    r = {(x.sample_1, x.sample_2): x.correlation for x in qc.sample_correlation(df).collect()}
    both = [(x[5], y[5]) for x in rows for y in rows if x[0] == "a" and y[0] == "b" and x[2] == y[2]]
    assert r["a", "b"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1]) and r["a", "flat"] is None
    pair = df.where("sample_name <> 'flat'").unionByName(df.where("sample_name = 'a'").withColumn("sample_name", F.lit("c")).withColumn("m_frac", F.col("m_frac") * F.col("m_frac")))
    scores, meta = qc.pca(pair)
    x = np.array([[v[5] for v in rows if v[0] == "a" and v[2] == i] + [v[5] for v in rows if v[0] == "b" and v[2] == i] for i in range(30) if i != 3])
    x = np.column_stack([x, x[:, 0] ** 2])
    z = ((x - x.mean(0)) / x.std(0, ddof=1)).T
    z = z - z.mean(0)
    s = np.linalg.svd(z, compute_uv=False)
    assert meta["sdev"][:2] == pytest.approx((s / math.sqrt(2))[:2]) and scores.columns == ["sample_name", "PC1", "PC2", "PC3"]
    q = {p.probability: p.value for p in qc.quantiles(df, F.col("num_calls")).collect()}
    assert q[0.0] == 1 and q[1.0] == 4 and q[0.5] == np.median([v[4] for v in rows])
    assert {h.center: h.n for h in qc.histogram(spark.createDataFrame([(5.0,), (15.0,), (15.1,), (0.0,)], "v double"), F.col("v"), 10).collect()} == {0.0: 2, 10.0: 1, 20.0: 1}
    d = spark.createDataFrame([(float(a), float(b)) for a, b in rng.random((40, 2))], "mh_frac_case double, mh_frac_control double")
    z, m = qc.diff_density(d, n_kde=30)
    assert z.count() == 900 and 0.5 < z.agg(F.sum("z")).first()[0] / 29**2 < 1.05
    with pytest.raises(ValueError, match="20"):
        qc.diff_density(d.limit(10))


# --- sources ---------------------------------------------------------------------------------------------------------------


def test_strand_folding(spark):
    rows = [("x-1", "+", "CG", 5), ("x-2", "-", "CG", 5), ("x-3", "+", "CA", 5), ("x-4", "-", "CA", 5), ("x-5", "-", "CG", 0), ("x-6", None, "CG", 7), ("x-7", None, "CG", 0)]
    df = spark.createDataFrame([(a, "c", 1, p, s, 9, k, 0.9, "m", 10, 0) for a, s, k, p in rows], "read_id string, chrom string, forward_read_position bigint, ref_position bigint, ref_mod_strand string, read_length bigint, query_kmer string, call_prob double, call_code string, base_qual int, flag int")
    got = {r.read_id: (r.start, r.end) for r in ingest.archived(df, "S").collect()}
    assert {k: got[k] for k in "1234"} == {"1": (5, 7), "2": (4, 6), "3": (5, 6), "4": (5, 6)} and set(got) == set("12346")


def test_sample_names_and_inputs(spark, tmp_path):
    assert [ingest.sample_of_file(f) for f in ("/a/S1-0.ch3", "S1-12.CH3", "M1.combined.ch3")] == ["S1", "S1", "M1.combined"]
    with pytest.raises(FileNotFoundError):
        ingest.resolve_inputs(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        ingest.resolve_inputs(spark, str(tmp_path))


def test_stats(frame):
    rows = frame([call(), call(read="r2", prob=0.5), call(start=11, qual=5)])
    t = stats.totals(rows).first()
    assert (t.num_calls, t.num_reads, t.high_conf_calls, t.high_qual_calls) == (3, 2, 2, 2)
    assert [tuple(r) for r in stats.site_coverage(rows, (1, 2)).orderBy("min_reads").collect()] == [(1, 2, 100.0), (2, 1, 50.0)]
    assert stats.site_count(frame([call(), call(chrom="chr2")])).first()[0] == 1
    assert stats.site_count(frame([call(), call(chrom="chr2")]), by_chrom=True).first()[0] == 2
