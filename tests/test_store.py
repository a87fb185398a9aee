"""Archive, load, store, analysis and stream, end to end in a temporary folder."""

import pytest
from pyspark.sql import functions as F

from strandlake import catalog
from strandlake.plans import analysis
from strandlake.plans.store import ModStore
from strandlake.sources import ingest, stats
from strandlake.streaming import append

HEAD = "read_id\tchrom\tforward_read_position\tref_position\tref_mod_strand\tread_length\tquery_kmer\tcall_prob\tcall_code\tbase_qual\tflag\textra"


def tsv(path, sample, n=40):
    lines = [HEAD]
    for i in range(n):
        code = "m" if (i * 7 + len(sample) + (sample.startswith("case")) * 3) % 10 < (8 if sample.startswith("case") else 3) else "-"
        lines.append(f"a-b-r{i % 8}\tchr1\t{i}\t{100 + i % 10 * 50}\t{'+-'[i % 2]}\t120\tCG\t0.95\t{code}\t20\t0\tz")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("archive")
    for s in ("case1", "case2", "ctrl1", "ctrl2"):
        ingest.make_archive(spark, tsv(at / f"{s}.tsv", s), s, str(at / "ch3"))
    return at


@pytest.fixture
def store(spark, archive, tmp_path):
    return ModStore(spark, str(tmp_path / "own")).load(str(archive / "ch3"))


def test_archive_and_load(spark, archive, tmp_path):
    names = sorted(p.name for p in (archive / "ch3").glob("*.ch3"))
    assert names == [f"{s}-0.ch3" for s in ("case1", "case2", "ctrl1", "ctrl2")]
    calls = ingest.load_calls(spark, [f"new={archive}/ch3/case1-0.ch3", f"{archive}/ch3/ctrl1-0.ch3"])
    assert {r.sample_name: r.n for r in stats.sample_counts(calls).collect()} == {"new": 40, "ctrl1": 40}
    assert calls.columns[0] == "sample_name" and calls.where("read_id = 'r3'").count() == 10
    assert ingest.load_calls(spark, {"x": f"{archive}/ch3"}, min_call_prob=0.96).count() == 0
    seen = stats.file_stats(spark, f"{archive}/ch3/case1-0.ch3", log_file=str(tmp_path / "log.txt"), silently=True)
    assert seen["num_calls"] == 40 and seen["num_reads"] == 8 and "num_calls: 40" in (tmp_path / "log.txt").read_text()
    with pytest.raises(FileNotFoundError):
        ingest.make_archive(spark, str(tmp_path / "no.tsv"), "s", str(tmp_path))


def test_store_tables(spark, store, tmp_path):
    assert store.tables() == ["calls"] and store.info()["samples"] == ["case1", "case2", "ctrl1", "ctrl2"]
    store.summarize_positions()
    n = store.read("positions").count()
    store.summarize_positions(overwrite=False)
    assert store.read("positions").count() == 2 * n and store.current_table == "positions"
    store.filter_table("positions", "positions", "sample_name = 'case1'")
    assert store.table_info("positions")["samples"] == {"case1": 2 * n // 4}
    store.rename_samples("positions", {"case1": "renamed"}, preview=False)
    assert store.sql("SELECT DISTINCT sample_name FROM positions").first()[0] == "renamed"
    store.sql("CREATE TABLE mine USING parquet AS SELECT chrom, count(*) AS n FROM calls GROUP BY chrom")
    assert store.read("mine").first().n == 160
    target = store.export("mine", str(tmp_path))
    assert (tmp_path / "mine.csv").read_text() == "chrom,n\nchr1,160\n" and target.endswith("mine.csv")
    assert store.get("absent") is None and store.export("absent", str(tmp_path)) is None
    assert store.remove("mine") and not store.remove("mine") and not store.exists("mine")
    again = ModStore(spark, store.path)
    assert again.tables() == store.tables() and again.columns("positions")[0] == "sample_name" and "positions" in repr(again)
    with pytest.raises(ValueError, match="does not exist"):
        again.read("absent")
    with pytest.raises(ValueError, match="not empty"):
        again.load("x")
    assert again.transform("calls", lambda df: df.groupBy("chrom").count()).first()[1] == 160
    assert again.trim_reads().read("calls_trimmed").count() == 160 and again.site_count() == 10
    with pytest.raises(ValueError, match="fewer"):
        again.sampled("calls", 10_000)


def test_analysis_and_qc(spark, store, tmp_path):
    regions = tmp_path / "r.bed"
    regions.write_text("chrom\tstart\tend\nchr1\t90\t300\nchr1\t301\t700\n")
    for kind in ("positions", "windows", "regions"):
        out = analysis.run_analysis(store, str(tmp_path / kind), ["case1", "case2"], ["ctrl1", "ctrl2"], kind, str(regions), 200, 50, "m", p_val_max=0.9)
        for f in out.values():
            assert open(f).readline().strip()
    assert {"mod_diff_positions", "mod_diff_windows", "mod_diff_regions", "collapsed_windows"} <= set(store.tables())
    assert {r.region_name for r in store.read("regions").select("region_name").distinct().collect()} == {"chr1_90_300", "chr1_301_700"}
    qc = analysis.run_qc(store, "calls")
    assert qc["pca"].count() == 4 and qc["correlation"].count() == 16 and qc["coverage"]["quantiles"].count() == 15
    with pytest.raises(ValueError, match="exists"):
        store.calc_diff(["case1"], ["ctrl1"], mod_type="m", overwrite=False)
    store.summarize_reads(min_CGs=1)
    store.summarize_windows(window_size=200, step_size=50)
    store.calc_diff(["case1", "case2"], ["ctrl1", "ctrl2"], "windows", mod_type="mh")
    assert store.volcano("mod_diff_windows").count() > 0
    key = tmp_path / "key.csv"
    key.write_text("chrom,start,end,avg_mh_frac_control,avg_mh_frac_case,avg_meth_diff\nchr1,1,900,0.2,0.9,0.7\n")
    assert store.classify_reads(str(key), "case", "control").read("classified_reads").count() == store.read("reads").count()


def test_stream_merges_batches_once(spark, archive, tmp_path):
    import shutil

    folder = tmp_path / "arriving"
    folder.mkdir()
    schema = spark.read.parquet(f"{archive}/ch3/case1-0.ch3").schema
    store = ModStore(spark, str(tmp_path / "live"))
    for name in ("case1-0.ch3", "ctrl1-0.ch3"):
        shutil.copy(archive / "ch3" / name, folder / name)
        append.follow(store, str(folder), schema, str(tmp_path / "cp")).awaitTermination()
    shutil.copy(archive / "ch3" / "case1-0.ch3", folder / "case1-1.ch3")
    append.follow(store, str(folder), schema, str(tmp_path / "cp")).awaitTermination()
    total = {r.sample_name: r.n for r in store.read("positions").groupBy("sample_name").agg(F.sum("num_calls").alias("n")).collect()}
    assert total == {"case1": 80, "ctrl1": 40}


def test_stream_keeps_the_old_table_and_replaces_a_batch(spark, archive, tmp_path):
    import shutil

    folder = tmp_path / "arriving"
    folder.mkdir()
    shutil.copy(archive / "ch3" / "case1-0.ch3", folder / "case1-0.ch3")
    schema = spark.read.parquet(f"{archive}/ch3/case1-0.ch3").schema
    store = ModStore(spark, str(tmp_path / "broken"))
    store.write(ingest.load_calls(spark, str(folder)), "calls").summarize_positions()
    (tmp_path / "broken.mod.db" / "positions_batches" / "batch=before").mkdir(parents=True)  # a write that broke off
    n = store.read("positions").agg(F.sum("num_calls")).first()[0]
    append.follow(store, str(folder), schema, str(tmp_path / "cp")).awaitTermination()
    assert store.read("positions").agg(F.sum("num_calls")).first()[0] == 2 * n
    commits = tmp_path / "cp" / "commits"
    for f in [*commits.glob("0"), *commits.glob(".0.crc")]:
        f.unlink()  # the batch is run again
    append.follow(store, str(folder), schema, str(tmp_path / "cp")).awaitTermination()
    assert store.read("positions").agg(F.sum("num_calls")).first()[0] == 2 * n


def test_region_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("chr1,1,5,x\nchr2,3,9,y\n")
    assert [r.region_name for r in ingest.read_regions(spark, str(tmp_path / "a.csv")).orderBy("chrom").collect()] == ["x", "y"]
    (tmp_path / "b.bed").write_text("chr1\t1\t5\n")
    assert ingest.read_regions(spark, str(tmp_path / "b.bed")).first().region_name == "chr1_1_5"
    with pytest.raises(ValueError, match="CSV"):
        ingest.read_regions(spark, str(tmp_path / "a.txt"))
    (tmp_path / "c.csv").write_text("chrom,start\nchr1,1\n")
    with pytest.raises(ValueError, match="end"):
        ingest.read_filter_regions(spark, str(tmp_path / "c.csv"))


def test_flagship_golden(spark):
    rows = [tuple(r) for r in catalog.QUERIES["collapse_windows"](spark, "/root/testdata/sf0.001").select("chrom", "start", "end", "avg_meth_diff", "num_windows").orderBy("chrom").collect()]
    assert rows == [("chr2", 701, 3000, -0.837005, 14), ("chr4", 1, 2300, 0.7444, 14)]
    assert all((b - a + 1 - 1000) / 100 + 1 == n for _, a, b, _, n in rows)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
