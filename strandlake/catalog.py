"""Registered queries of the base-modification engine, and their SQL twins.

The queries run on calls that are projected from the table lineitem: 12 samples, 5 chromosomes of 100
sites each, with a negative effect on chr2 and a positive one on chr4 for the samples S00 to S05.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.codes import ModSpec, safe_label
from strandlake.operators import calls as call_ops
from strandlake.operators import collapse, diff, intervals, qc, summarize
from strandlake.plans import analysis
from strandlake.plans.store import SUFFIX, ModStore
from strandlake.schema import KEY_COLUMNS
from strandlake.sources import ingest, stats
from strandlake.sources.folders import new_folder, remove_at_exit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CASES = [f"S{i:02d}" for i in range(6)]
CONTROLS = [f"S{i:02d}" for i in range(6, 12)]
REGIONS = [("chr2", 1000, 2600, "neg"), ("chr4", 400, 1800, "pos"), ("chr1", 0, 4000, "all1"), ("chr1", 500, 900, "nested"), ("chr9", 1, 100, "empty")]

SITE = "(l_partkey % 100) * {step}"
RAW = """SELECT 'S' || lpad(CAST(l_orderkey % 12 AS {text}), 2, '0') AS sample_name,
  'r' || CAST(l_orderkey AS {text}) AS read_id, 'chr' || CAST(l_orderkey % 5 + 1 AS {text}) AS chrom,
  {site} AS start, {site} + 2 AS {end}, (l_linenumber - 1) * 20 + CAST(l_quantity AS BIGINT) % 20 AS read_position, 'CG' AS query_kmer,
  CASE WHEN l_orderkey % 5 = 1 AND (l_partkey % 100) * 40 BETWEEN 1000 AND 2600 THEN CASE WHEN l_orderkey % 12 < 6 THEN '-' ELSE 'm' END
       WHEN l_orderkey % 5 = 3 AND (l_partkey % 100) * 40 BETWEEN 400 AND 1800 THEN CASE WHEN l_orderkey % 12 < 6 THEN 'h' ELSE '-' END
       WHEN l_returnflag = 'A' THEN 'm' WHEN l_returnflag = 'R' THEN 'h' ELSE '-' END AS call_code,
  40 + l_orderkey % 160 AS read_length, 1 - l_discount * 1.5 AS call_prob, CAST(l_quantity AS BIGINT) AS base_qual,
  CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END AS flag FROM {source}"""


def raw_calls(spark: SparkSession, sf_dir: str, step: int = 40) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(RAW.format(text="STRING", site=SITE.format(step=step), end="`end`", source="{lines}"), lines=lines)


def calls(spark: SparkSession, sf_dir: str, step: int = 40) -> DataFrame:
    return ingest.call_filter(raw_calls(spark, sf_dir, step))


def regions(spark: SparkSession, bare: bool = False) -> DataFrame:
    rows = [(c[3:] if bare else c, a, b, n) for c, a, b, n in REGIONS]
    return spark.createDataFrame(rows, "chrom string, start bigint, `end` bigint, region_name string")


# --- SQL fragments --------------------------------------------------------------------------------------

KEPT = "read_length >= 50 AND call_prob >= 0.9 AND base_qual >= 10"
LABELS = {"c": "call_code = '-'", "m": "call_code = 'm'", "h": "call_code = 'h'", "mh": "call_code IN ('m', 'h')"}
VALUES = ", ".join(f"('{c}', {a}, {b}, '{n}')" for c, a, b, n in REGIONS)


def names(quoted: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in quoted)


def cte(*more: str, step: int = 40) -> str:
    raw = RAW.format(text="VARCHAR", site=SITE.format(step=step), end='"end"', source="lineitem")
    return f"WITH raw_calls AS ({raw}), calls AS (SELECT * FROM raw_calls WHERE {KEPT})" + "".join(f", {m}" for m in more) + " "


def counted(labels: dict[str, str] = LABELS) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {x}_counts" for x, c in labels.items())


def summed(labels=LABELS, prefix: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum({prefix}{x}_counts), 0) AS BIGINT) AS {x}_counts" for x in labels)


def listed(labels=LABELS, calls_: str = "num_calls", only=None) -> str:
    counts = ", ".join(f"{x}_counts" for x in labels)
    return counts + ", " + ", ".join(f"round(CAST({x}_counts AS DOUBLE) / nullif({calls_}, 0), 6) AS {x}_frac" for x in (only or labels))


def pos(labels: dict[str, str] = LABELS, where: str = "", more: str = "") -> str:
    return f"pos AS (SELECT sample_name, chrom, start{more}, count(*) AS num_calls, {counted(labels)} FROM calls WHERE start > 0{where} GROUP BY sample_name, chrom, start{more})"


def win(size: int, step: int, edge: str = "compat", labels=LABELS) -> str:
    at = f"start - ((start - o) % {size})" if edge == "compat" else f"start - ((((start - o) % {size}) + {size}) % {size})"
    return f"""win AS (SELECT sample_name, chrom, ws AS start, ws + {size - 1} AS "end", count(*) AS num_CpGs, CAST(sum(num_calls) AS BIGINT) AS num_calls, {summed(labels)}
      FROM (SELECT *, {at} AS ws FROM pos, (SELECT unnest(range(1, {size}, {step})) AS o) AS offs) AS spread GROUP BY sample_name, chrom, ws)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparisons that don't depend on the order of sums."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


POS_OUT = f'SELECT sample_name, chrom, start, start AS "end", num_calls, {listed()} FROM pos'
WIN_OUT = f'SELECT sample_name, chrom, start, "end", num_CpGs, num_calls, {listed()} FROM win'

# --- calls ------------------------------------------------------------------------------------------------

CALL_OUT = 'SELECT sample_name, read_id, chrom, start, "end", read_position, query_kmer, call_code, read_length, round(call_prob, 6) AS call_prob, base_qual, flag'


@register("load_calls_filtered", cte() + CALL_OUT + " FROM calls WHERE flag = 16 AND chrom IN ('chr1', 'chr3')")
def _(spark, sf_dir):
    return ingest.call_filter(raw_calls(spark, sf_dir), chrom=["chr1", "chr3"], flag=16)


ARCHIVE = """SELECT 'S1' AS sample_name, CAST(l_orderkey AS VARCHAR) AS read_id, 'chr1' AS chrom, CASE WHEN strand = '-' AND kmer = 'CG' THEN p - 1 ELSE p END AS start,
  CASE WHEN strand = '+' AND kmer = 'CG' THEN p + 2 ELSE p + 1 END AS "end", CAST(l_linenumber AS BIGINT) AS read_position, CAST(100 AS BIGINT) AS read_length, kmer AS query_kmer, CAST(0.95 AS DOUBLE) AS call_prob, 'm' AS call_code, 20 AS base_qual, 0 AS flag
  FROM (SELECT *, l_partkey % 50 AS p, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN l_suppkey % 3 = 0 THEN 'CA' ELSE 'CG' END AS kmer FROM lineitem) AS x WHERE NOT (strand = '-' AND p = 0)"""


def modkit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "'ab-cd-' || CAST(l_orderkey AS STRING) AS read_id", "'chr1' AS chrom", "CAST(l_linenumber AS BIGINT) AS forward_read_position", "l_partkey % 50 AS ref_position",
        "CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS ref_mod_strand", "CAST(100 AS BIGINT) AS read_length", "CASE WHEN l_suppkey % 3 = 0 THEN 'CA' ELSE 'CG' END AS query_kmer",
        "CAST(0.95 AS DOUBLE) AS call_prob", "'m' AS call_code", "20 AS base_qual", "0 AS flag",
    )


@register("archive_strand_fold", ARCHIVE)
def _(spark, sf_dir):
    return ingest.archived(modkit_rows(spark, sf_dir), "S1")


FILES = ["/a/S1-0.ch3", "/a/S1-12.CH3", "/b/M1.combined.ch3", "x-1-2.ch3"]


@register("sample_name_from_file", "SELECT f AS file, regexp_replace(regexp_replace(regexp_extract(f, '[^/]*$'), '(?i)\\.ch3$', ''), '-[0-9]+$', '') AS sample_name FROM (VALUES " + ", ".join(f"('{f}')" for f in FILES) + ") AS t(f)")
def _(spark, sf_dir):
    return spark.createDataFrame([(f, ingest.sample_of_file(f)) for f in FILES], "file string, sample_name string")


@register("trim_end_10", cte() + CALL_OUT + " FROM calls WHERE read_position < read_length * 0.9")
def _(spark, sf_dir):
    return call_ops.trim(calls(spark, sf_dir))


@register("trim_both_05", cte() + CALL_OUT + " FROM calls WHERE read_position >= read_length * 0.05 AND read_position < read_length * 0.95")
def _(spark, sf_dir):
    return call_ops.trim(calls(spark, sf_dir), "0.05", trim_start=True)


@register("filter_table", cte() + CALL_OUT + " FROM calls WHERE call_code = 'm' AND base_qual > 30")
def _(spark, sf_dir):
    return call_ops.filter_rows(calls(spark, sf_dir), F.col("call_code") == "m", "base_qual > 30")


@register("rename_samples", cte() + "SELECT CASE sample_name WHEN 'S00' THEN 'S01' WHEN 'S01' THEN 'S00' WHEN 'S02' THEN 'new' ELSE sample_name END AS sample_name, count(*) AS n FROM calls GROUP BY 1")
def _(spark, sf_dir):
    return stats.sample_counts(call_ops.rename_samples(calls(spark, sf_dir), {"S00": "S01", "S01": "S00", "S02": "new"}))


@register("sample_rows")
def _(spark, sf_dir):
    return call_ops.sample_rows(calls(spark, sf_dir), 100, seed=1)


@register("sample_rows_members", cte() + "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_found, CAST(0 AS BIGINT) AS n_excess FROM calls")
def _(spark, sf_dir):
    """How many rows a sample has, how many of them the table has, and how many are drawn more often than it has them."""
    table = calls(spark, sf_dir)
    drawn = call_ops.sample_rows(table, 100, seed=1).groupBy(table.columns).agg(F.count("*").alias("n"))
    there = drawn.join(table.groupBy(table.columns).agg(F.count("*").alias("m")), table.columns, "left")
    return there.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("m").isNotNull(), F.col("n")).otherwise(0)).alias("n_found"), F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("n_excess"))


@register("mod_spec_labels", "SELECT * FROM (VALUES ('m', 'm', 1), ('m + h', 'mh', 2), ('21839', 'm_21839', 1), ('a', 'a', 1)) AS t(spec, label, n_codes)")
def _(spark, sf_dir):
    parsed = [(s, ModSpec.parse(s)) for s in ("m", "m + h", "21839", "a")]
    return spark.createDataFrame([(s, p.label, len(p.codes)) for s, p in parsed], "spec string, label string, n_codes int")


# --- summaries ------------------------------------------------------------------------------------------------


@register("positions_default", cte(pos()) + POS_OUT)
def _(spark, sf_dir):
    return summarize.positions(calls(spark, sf_dir))


CUSTOM = {safe_label("u"): "call_code = '-'", "h": "call_code = 'h'", "hm": "call_code IN ('h', 'm')"}


@register("positions_custom_codes", cte(pos(CUSTOM)) + f'SELECT sample_name, chrom, start, start AS "end", num_calls, {listed(CUSTOM)} FROM pos')
def _(spark, sf_dir):
    return summarize.positions(calls(spark, sf_dir), mod_code=["h", "h + m"], unmod_label="u")


@register("positions_min_calls", cte(pos()) + POS_OUT + " WHERE num_calls >= 6")
def _(spark, sf_dir):
    return summarize.positions(calls(spark, sf_dir), min_num_calls=6)


@register("positions_samples_chroms", cte(pos(where=" AND chrom IN ('chr2', 'chr4') AND sample_name IN ('S00', 'S07')")) + POS_OUT)
def _(spark, sf_dir):
    return summarize.positions(calls(spark, sf_dir), chrs=["chr2", "chr4"], samples=["S00", "S07", "absent"])


def _windows(name: str, size: int, step: int, edge: str = "compat") -> None:
    @register(name, cte(pos(), win(size, step, edge)) + WIN_OUT)
    def _(spark, sf_dir):
        return summarize.windows(calls(spark, sf_dir), window_size=size, step_size=step, edge=edge)


_windows("windows_1000_100", 1000, 100)
_windows("windows_nonoverlap_100", 100, 100)
_windows("windows_default_1000_10", 1000, 10)
_windows("windows_floor_edge", 1000, 100, "floor")
_windows("windows_uneven_step", 900, 400)

REG_KEYS = "a.region_name, a.chrom, a.start, a.\"end\""
FINE = pos(more=', "end"')


def _region_sql(join: str, least: int, bare: str = "") -> str:
    sums = f"count(*) AS num_CpGs, CAST(coalesce(sum(p.num_calls), 0) AS BIGINT) AS num_calls, {summed(prefix='p.')}"
    ann = f'ann AS (SELECT * FROM (VALUES {VALUES}) AS t(chrom, start, "end", region_name))'
    if join == "RIGHT":
        body = f"""reg AS (SELECT p.sample_name, {REG_KEYS}, {sums} FROM (SELECT DISTINCT sample_name AS s FROM calls) AS n CROSS JOIN ann AS a
          LEFT JOIN pos AS p ON p.sample_name = n.s AND p.chrom = a.chrom AND p.start BETWEEN a.start AND a."end" GROUP BY n.s, p.sample_name, {REG_KEYS} HAVING coalesce(sum(p.num_calls), 0) >= {least})"""
    else:
        body = f"""reg AS (SELECT p.sample_name, {REG_KEYS}, {sums} FROM pos AS p {join} JOIN ann AS a ON p.chrom = a.chrom AND p.start BETWEEN a.start AND a."end"
          GROUP BY p.sample_name, {REG_KEYS} HAVING coalesce(sum(p.num_calls), 0) >= {least})"""
    return cte(FINE, ann, body) + f'SELECT sample_name, region_name, chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", num_CpGs, num_calls, {listed()} FROM reg'


@register("regions_inner", _region_sql("INNER", 1))
def _(spark, sf_dir):
    return summarize.regions(calls(spark, sf_dir), regions(spark))


@register("regions_left", _region_sql("LEFT", 1))
def _(spark, sf_dir):
    return summarize.regions(calls(spark, sf_dir), regions(spark), join="left")


@register("regions_right_zero", _region_sql("RIGHT", 0))
def _(spark, sf_dir):
    return summarize.regions(calls(spark, sf_dir), regions(spark), join="right", min_num_calls=0)


@register("regions_chr_harmonize", _region_sql("INNER", 1))
def _(spark, sf_dir):
    return summarize.regions(calls(spark, sf_dir), regions(spark, bare=True))


def _reads_sql(source: str, step: int = 40, more: str = "") -> str:
    return cte(more, step=step) if more else cte(step=step)


READS = f"""reads AS (SELECT min(c.sample_name) AS sample_name, c.read_id, min(c.chrom) AS chrom, count(*) AS total_calls, min(c.start) AS first_cpg_pos, max(c."end") AS last_cpg_pos, min(c.read_length) AS read_length, {counted()}
  FROM {{source}} GROUP BY c.read_id HAVING count(*) >= 5 AND min(c.read_length) >= 100)"""
READS_OUT = f"SELECT sample_name, read_id, chrom, total_calls, first_cpg_pos, last_cpg_pos, read_length, {listed(calls_='total_calls', only=['m', 'h', 'mh'])} FROM reads"
WIDE = [("chr1", 8000, 15000, "a"), ("chr2", 0, 39600, "b"), ("chr1", 9000, 10000, "c")]
WIDE_VALUES = ", ".join(f"('{c}', {a}, {b}, '{n}')" for c, a, b, n in WIDE)
IN_WIDE = f'calls AS c JOIN (VALUES {WIDE_VALUES}) AS k(chrom, start, "end", region_name) ON c.chrom = k.chrom AND c.start BETWEEN k.start AND k."end"'


@register("reads_default", cte(READS.format(source="calls AS c")) + READS_OUT)
def _(spark, sf_dir):
    return summarize.reads(calls(spark, sf_dir))


def _wide(spark) -> DataFrame:
    return spark.createDataFrame(WIDE, "chrom string, start bigint, `end` bigint, region_name string")


@register("reads_in_regions", cte(READS.format(source=IN_WIDE), step=400) + READS_OUT)
def _(spark, sf_dir):
    return summarize.reads(calls(spark, sf_dir, 400), _wide(spark))


@register("reads_legacy_bucket", cte(READS.format(source=IN_WIDE + " AND c.start // 10000 = k.start // 10000"), step=400) + READS_OUT)
def _(spark, sf_dir):
    return summarize.reads(calls(spark, sf_dir, 400), _wide(spark), legacy_bucket=True)


def _hits(spark, sf_dir, broadcast_rows: int) -> DataFrame:
    r = _wide(spark).select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "region_name")
    found = intervals.points_in_regions(calls(spark, sf_dir, 400), r, broadcast_rows=broadcast_rows)
    return found.groupBy("region_name").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


@register("points_in_regions_shuffled", cte(step=400) + f"SELECT region_name, count(*) AS n, CAST(sum(c.start) AS BIGINT) AS places FROM {IN_WIDE} GROUP BY region_name")
def _(spark, sf_dir):
    """No broadcast: both sides shuffled by (chromosome, bucket)."""
    return _hits(spark, sf_dir, 0)


@register("overlaps_shuffled", cte(READS.format(source="calls AS c"), step=400) + f'SELECT r.read_id, k.region_name, r.first_cpg_pos, r.last_cpg_pos FROM reads AS r JOIN (VALUES {WIDE_VALUES}) AS k(chrom, start, "end", region_name) ON r.chrom = k.chrom AND r.first_cpg_pos <= k."end" AND r.last_cpg_pos >= k.start')
def _(spark, sf_dir):
    k = _wide(spark).select(F.col("chrom").alias("k_chrom"), F.col("start").alias("k_start"), F.col("end").alias("k_end"), "region_name")
    found = intervals.overlapping(summarize.reads(calls(spark, sf_dir, 400)), "first_cpg_pos", "last_cpg_pos", k, broadcast_rows=0)
    return found.select("read_id", "region_name", "first_cpg_pos", "last_cpg_pos")


# --- differences ------------------------------------------------------------------------------------------------


def _pooled_sql(source: str, keys: str, group: str = "mh") -> str:
    side = lambda v, g, a: f"CAST(sum(CASE WHEN sample_name IN ({names(g)}) THEN {v} ELSE 0 END) AS BIGINT) AS {a}"
    return f"""pooled AS (SELECT {keys}, {side('num_calls', CASES, 'kc')}, {side('num_calls', CONTROLS, 'kn')}, {side(f'{group}_counts', CASES, 'mc')}, {side(f'{group}_counts', CONTROLS, 'mn')} FROM {source} GROUP BY {keys})"""


LOGP = "lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n + 1) - lgamma(k - x + 1) - lgamma(n - k + x + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1)"
SUPPORT = "range(greatest(0, k - n), least(m, k) + 1)"
TAIL = lambda cond: f"coalesce(list_sum(list_transform(list_filter({SUPPORT}, lambda x: {cond}), lambda x: exp({LOGP}))), 0)"
MIDP = f"2 * least({TAIL('x > q')} + 0.5 * {TAIL('x = q')}, {TAIL('x < q')} + 0.5 * {TAIL('x = q')})"
EXACT = f"least(1, list_sum(list_transform({SUPPORT}, lambda x: CASE WHEN {LOGP} <= {LOGP.replace('x', 'q')} + ln(1 + 1e-7) THEN exp({LOGP}) ELSE 0 END)))"
EXACT = EXACT.replace("eqp(", "exp(")


def _tested_sql(p: str) -> str:
    return f"tested AS (SELECT *, {p} AS p_val FROM (SELECT *, mc AS q, mc + mn AS m, kc - mc + kn - mn AS n, kc AS k FROM pooled) AS t)"


BH = """adjusted AS (SELECT * EXCLUDE (raw), least(1, min(raw) OVER (ORDER BY p_val DESC ROWS UNBOUNDED PRECEDING)) AS p_adjust
  FROM (SELECT *, p_val * count(*) OVER () / count(*) OVER (ORDER BY p_val RANGE UNBOUNDED PRECEDING) AS raw FROM tested) AS b)"""
DIFFED = """diffed AS (SELECT *, CAST(mc AS DOUBLE) / nullif(kc, 0) AS fc, CAST(mn AS DOUBLE) / nullif(kn, 0) AS fn FROM adjusted)"""


def _diff_out(keys: str, group: str = "mh") -> str:
    return f"""SELECT {keys}, kc AS num_calls_case, kn AS num_calls_control, mc AS {group}_counts_case, mn AS {group}_counts_control, kc - mc AS c_counts_case, kn - mn AS c_counts_control,
      round(fc, 6) AS {group}_frac_case, round(fn, 6) AS {group}_frac_control, round(fc - fn, 6) AS meth_diff, round(p_val, 6) AS p_val, round(p_adjust, 6) AS p_adjust FROM diffed"""


SITES = 'chrom, start, "end"'
ENDED = 'ended AS (SELECT *, start AS "end" FROM pos)'
FLAGSHIP = (pos(), win(1000, 100), _pooled_sql("win", SITES), _tested_sql(MIDP), BH, DIFFED)


@register("diff_fast_fisher", cte(*FLAGSHIP) + _diff_out(SITES))
def _(spark, sf_dir):
    return flagship_diff(spark, sf_dir)


def flagship_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.calc_diff(summarize.windows(calls(spark, sf_dir), window_size=1000, step_size=100), CASES, CONTROLS, "mh", "fast_fisher")


@register("diff_fast_fisher_regions", cte(FINE, f'ann AS (SELECT * FROM (VALUES {VALUES}) AS t(chrom, start, "end", region_name))', f"""reg AS (SELECT p.sample_name, {REG_KEYS}, CAST(sum(p.num_calls) AS BIGINT) AS num_calls, CAST(sum(p.m_counts) AS BIGINT) AS m_counts
  FROM pos AS p JOIN ann AS a ON p.chrom = a.chrom AND p.start BETWEEN a.start AND a."end" GROUP BY p.sample_name, {REG_KEYS})""", _pooled_sql("reg", f"region_name, {SITES}", "m"), _tested_sql(MIDP), BH, DIFFED) + _diff_out('region_name, chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end"', "m"))  # fmt: skip
def _(spark, sf_dir):
    return diff.calc_diff(summarize.regions(calls(spark, sf_dir), regions(spark)), CASES, CONTROLS, "m", "fast_fisher")


@register("diff_r_fisher", cte(pos(), ENDED, _pooled_sql("ended", SITES), _tested_sql(EXACT), BH, DIFFED) + _diff_out(SITES))
def _(spark, sf_dir):
    return diff.calc_diff(summarize.positions(calls(spark, sf_dir)), CASES, CONTROLS, "mh", "r_fisher")


# erfc by the series of positive terms x^(2n+1) / gamma(n + 3/2), which cancels nothing
ERFC = lambda x: f"CASE WHEN {x} > 8 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 400), lambda n: exp((2 * n + 1) * ln(greatest({x}, 1e-30)) - ({x}) * ({x}) - lgamma(n + 1.5)))) END"
CELLS = (("mc", "kc", "mc + mn"), ("kc - mc", "kc", "kc - mc + kn - mn"), ("mn", "kn", "mc + mn"), ("kn - mn", "kn", "kc - mc + kn - mn"))
LR = "greatest(0, " + " + ".join(f"CASE WHEN {c} > 0 THEN 2 * ({c}) * ln(({c}) * CAST(kc + kn AS DOUBLE) / (CAST({r} AS DOUBLE) * ({k}))) ELSE 0 END" for c, r, k in CELLS) + ")"
LRT = f"CASE WHEN kc = 0 OR kn = 0 THEN 1 ELSE {ERFC(f'sqrt({LR} / 2)')} END"


@register("diff_log_reg", cte(pos(), ENDED, _pooled_sql("ended", SITES), _tested_sql(LRT), BH, DIFFED) + _diff_out(SITES))
def _(spark, sf_dir):
    return diff.calc_diff(summarize.positions(calls(spark, sf_dir)), CASES, CONTROLS, "mh", "log_reg")


TINY = (("diff_p_magnitude", "fast_fisher", MIDP), ("diff_exact_p_magnitude", "r_fisher", EXACT))


def _magnitude(name: str, test: str, p: str) -> None:
    """The p-values on a logarithmic scale, which tells small ones apart."""

    @register(name, cte(pos(), win(1000, 100), _pooled_sql("win", SITES), _tested_sql(p)) + f"SELECT {SITES}, round(-log10(p_val), 6) AS magnitude FROM tested WHERE p_val > 0")
    def _(spark, sf_dir):
        found = diff.calc_diff(summarize.windows(calls(spark, sf_dir), window_size=1000, step_size=100), CASES, CONTROLS, "mh", test)
        return found.where("p_val > 0").select("chrom", "start", "end", (-F.log10("p_val")).alias("magnitude"))


for _tiny in TINY:
    _magnitude(*_tiny)


def _wilcox_effects() -> str:
    parts = []
    for g, who in (("case", CASES), ("control", CONTROLS)):
        mine = f"sample_name IN ({names(who)})"
        parts += [f"CAST(sum(CASE WHEN {mine} THEN 1 ELSE 0 END) AS BIGINT) AS num_samples_{g}", f"CAST(sum(CASE WHEN {mine} THEN num_calls ELSE 0 END) AS BIGINT) AS num_calls_{g}", f"CAST(sum(CASE WHEN {mine} THEN mh_counts ELSE 0 END) AS BIGINT) AS mh_counts_{g}", f"round(avg(CASE WHEN {mine} THEN CAST(mh_counts AS DOUBLE) / num_calls END), 6) AS mh_frac_{g}"]
    return cte(pos(), win(1000, 100)) + f"SELECT {SITES}, {', '.join(parts)} FROM win GROUP BY {SITES}"


@register("diff_wilcox_effects", _wilcox_effects())
def _(spark, sf_dir):
    return diff.calc_diff(summarize.windows(calls(spark, sf_dir), window_size=1000, step_size=100), CASES, CONTROLS, "mh", "wilcox").drop("meth_diff", "p_val", "p_adjust")


# Rank sums: all arrangements of the ranks without ties, else the normal approximation with both corrections.
RANKS = f"""side AS (SELECT {SITES}, CASE WHEN sample_name IN ({names(CASES)}) THEN 1 ELSE 0 END AS g, CAST(mh_counts AS DOUBLE) / num_calls AS v FROM win),
  rk AS (SELECT *, rank() OVER (PARTITION BY {SITES} ORDER BY v) AS r, count(*) OVER (PARTITION BY {SITES}, v) AS t FROM side),
  st AS (SELECT {SITES}, CAST(sum(g) AS BIGINT) AS a, CAST(sum(1 - g) AS BIGINT) AS b, sum(g * (r + (t - 1) / 2.0)) - sum(g) * (sum(g) + 1) / 2.0 AS w, max(t) AS most, CAST(sum(t * t - 1) AS DOUBLE) AS tied FROM rk GROUP BY {SITES}),
  arr AS (SELECT a, b, CAST(list_sum(list_transform(list_filter(range(0, a + b), lambda i: (m >> i) & 1 = 1), lambda i: i + 1)) AS DOUBLE) - a * (a + 1) / 2.0 AS s
    FROM (SELECT DISTINCT a, b FROM st WHERE most = 1 AND a > 0 AND b > 0) AS d, (SELECT unnest(range(0, 4096)) AS m) AS masks WHERE m < CAST(pow(2, a + b) AS BIGINT) AND bit_count(m) = a),
  exact AS (SELECT st.chrom, st.start, least(1, 2 * CAST(sum(CASE WHEN (w <= st.a * st.b / 2.0 AND s <= w) OR (w > st.a * st.b / 2.0 AND s >= w) THEN 1 ELSE 0 END) AS DOUBLE) / count(*)) AS p FROM st JOIN arr ON st.a = arr.a AND st.b = arr.b WHERE most = 1 GROUP BY st.chrom, st.start),
  near AS (SELECT *, sqrt(greatest(0, a * b / 12.0 * (a + b + 1 - tied / ((a + b) * (a + b - 1))))) AS spread, greatest(0, abs(w - a * b / 2.0) - CASE WHEN w = a * b / 2.0 THEN 0 ELSE 0.5 END) AS z FROM st WHERE most > 1 AND a > 0 AND b > 0),
  normal AS (SELECT chrom, start, CASE WHEN spread > 0 THEN least(1, {ERFC("(z / spread / sqrt(2))")}) END AS p FROM near)"""
RANKED_BH = BH.replace("count(*) OVER", "count(p_val) OVER").replace("least(1, min(raw)", "CASE WHEN p_val IS NOT NULL THEN least(1, min(raw)").replace("PRECEDING)) AS p_adjust", "PRECEDING)) END AS p_adjust")


def _wilcox_sql() -> str:
    effects, body = _wilcox_effects().removeprefix(cte(pos(), win(1000, 100))), cte(pos(), win(1000, 100), RANKS)
    tested = "tested AS (SELECT e.*, e.mh_frac_case - e.mh_frac_control AS meth_diff, coalesce(x.p, n.p) AS p_val FROM eff AS e LEFT JOIN exact AS x ON e.chrom = x.chrom AND e.start = x.start LEFT JOIN normal AS n ON e.chrom = n.chrom AND e.start = n.start)"
    exact = effects.replace("round(avg(", "(avg(").replace(", 6) AS mh_frac", ") AS mh_frac")
    places = ", ".join(f"round({c}, 6) AS {c}" for c in ("mh_frac_case", "mh_frac_control", "meth_diff", "p_val", "p_adjust"))
    return f"{body}, eff AS ({exact}), {tested}, {RANKED_BH} SELECT * REPLACE ({places}) FROM adjusted"


@register("diff_wilcox", _wilcox_sql())
def _(spark, sf_dir):
    return diff.calc_diff(summarize.windows(calls(spark, sf_dir), window_size=1000, step_size=100), CASES, CONTROLS)


@register("bh_adjust", "WITH tested AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * l_tax * l_tax * 10 END AS p FROM lineitem), " + """adjusted AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q
  FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM tested WHERE p IS NOT NULL) AS b) SELECT l_orderkey, l_linenumber, l_partkey, round(q, 6) AS p_adjust FROM adjusted UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL FROM tested WHERE p IS NULL""")  # fmt: skip
def _(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "IF(l_linenumber = 7, NULL, l_discount * l_tax * l_tax * 10) AS p_val")
    return diff.bh_adjust(p).select("l_orderkey", "l_linenumber", "l_partkey", "p_adjust")


MEANS = ", ".join(f"round(avg({c}), 6) AS avg_{n}" for c, n in (("mc", "mh_counts_case"), ("mn", "mh_counts_control"), ("kc - mc", "c_counts_case"), ("kn - mn", "c_counts_control"), ("fc", "mh_frac_case"), ("fn", "mh_frac_control")))
ISLANDS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start) AS r FROM diffed WHERE p_adjust <= 0.05 AND abs(fc - fn) >= 0.5),
  heads AS (SELECT b.chrom, b.r FROM ranked AS b WHERE NOT EXISTS (SELECT 1 FROM ranked AS a WHERE a.chrom = b.chrom AND a.r = b.r - 1 AND b.start - a."end" <= 1000 AND (a.fc > a.fn) = (b.fc > b.fn))),
  merged AS (SELECT chrom, min(start) AS start, max("end") AS "end", {MEANS}, round(avg(fc - fn), 6) AS avg_meth_diff, count(*) AS num_windows
    FROM (SELECT w.*, (SELECT max(h.r) FROM heads AS h WHERE h.chrom = w.chrom AND h.r <= w.r) AS head FROM ranked AS w) AS k GROUP BY chrom, head)"""


@register("collapse_windows", cte(*FLAGSHIP, ISLANDS) + "SELECT * FROM merged")
def _(spark, sf_dir):
    return collapse.collapse_windows(flagship_diff(spark, sf_dir))


KEY = [("chr2", 1001, 3100, 0.9, 0.02, -0.88), ("chr4", 1, 2300, 0.1, 0.8, 0.7), ("chr4", 2000, 3000, 0.3, 0.8, 0.5)]
KEY_SQL = ", ".join(f"('{c}', {a}, {b}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for c, a, b, x, y, _ in KEY)


@register("classify_reads", cte(READS.format(source="calls AS c"), f'k AS (SELECT * FROM (VALUES {KEY_SQL}) AS t(chrom, start, "end", control, "case"))', f"fr AS (SELECT *, CAST(mh_counts AS DOUBLE) / total_calls AS mh_frac FROM reads)") + """SELECT r.sample_name, r.read_id, r.first_cpg_pos, r.last_cpg_pos, round(r.mh_frac, 6) AS mh_frac,
  CASE WHEN abs(r.mh_frac - k.control) <= 0.1 THEN 'control' WHEN abs(r.mh_frac - k."case") <= 0.1 THEN 'case' ELSE 'unknown' END AS classification
  FROM fr AS r JOIN k ON r.chrom = k.chrom AND r.first_cpg_pos <= k."end" AND r.last_cpg_pos >= k.start""")  # fmt: skip
def _(spark, sf_dir):
    key = spark.createDataFrame(KEY, "chrom string, start bigint, `end` bigint, avg_mh_frac_control double, avg_mh_frac_case double, avg_meth_diff double")
    return collapse.classify_reads(summarize.reads(calls(spark, sf_dir)), key, "case", "control")


# --- statistics and quality control ------------------------------------------------------------------------------


@register("cpg_count", cte() + 'SELECT count(*) AS num_sites FROM (SELECT DISTINCT start, "end" FROM calls) AS d')
def _(spark, sf_dir):
    return stats.site_count(calls(spark, sf_dir))


@register("table_info", cte() + "SELECT sample_name, count(*) AS n FROM calls GROUP BY sample_name")
def _(spark, sf_dir):
    return stats.sample_counts(calls(spark, sf_dir))


@register("db_samples", cte() + "SELECT DISTINCT sample_name FROM calls")
def _(spark, sf_dir):
    return calls(spark, sf_dir).select("sample_name").distinct()


@register("stats_flags", cte() + "SELECT flag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM raw_calls GROUP BY flag")
def _(spark, sf_dir):
    return stats.flag_counts(raw_calls(spark, sf_dir))


@register("stats_coverage", cte("sites AS (SELECT chrom, start, count(*) AS n FROM raw_calls GROUP BY chrom, start)") + "SELECT t.k AS min_reads, CAST(sum(CASE WHEN n >= t.k THEN 1 ELSE 0 END) AS BIGINT) AS covered, round(CAST(sum(CASE WHEN n >= t.k THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 6) AS percent FROM sites, (VALUES (1), (5), (10), (15)) AS t(k) GROUP BY t.k")
def _(spark, sf_dir):
    return stats.site_coverage(raw_calls(spark, sf_dir))


@register("stats_quality", cte() + "SELECT count(*) AS num_calls, count(DISTINCT read_id) AS num_reads, round(avg(read_length), 6) AS avg_read_length, CAST(sum(CASE WHEN call_prob >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS high_conf_calls, CAST(sum(CASE WHEN base_qual >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS high_qual_calls FROM raw_calls")
def _(spark, sf_dir):
    return stats.totals(raw_calls(spark, sf_dir))


PROBS = ", ".join(f"{p}" for p in qc.PROBABILITIES)


def _quantiles_sql(value: str) -> str:
    return f"SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in qc.PROBABILITIES)}]) AS probability, round(unnest(quantile_cont({value}, [{PROBS}])), 6) AS value FROM pos"


@register("cov_quantiles", cte(pos()) + _quantiles_sql("CAST(num_calls AS DOUBLE)"))
def _(spark, sf_dir):
    return qc.coverage(summarize.positions(calls(spark, sf_dir)))["quantiles"]


@register("modfrac_quantiles", cte(pos()) + _quantiles_sql("100 * (CAST(mh_counts AS DOUBLE) / num_calls)"))
def _(spark, sf_dir):
    return qc.modfrac(summarize.positions(calls(spark, sf_dir)))["quantiles"]


def _summary_sql(v: str) -> str:
    q = lambda p: f"round(quantile_cont({v}, {p}), 6)"
    return f"SELECT round(min({v}), 6) AS \"min\", {q(0.25)} AS q1, {q(0.5)} AS median, round(avg({v}), 6) AS mean, {q(0.75)} AS q3, round(max({v}), 6) AS \"max\", CAST(0 AS BIGINT) AS n_null FROM pos"


@register("cov_summary", cte(pos()) + _summary_sql("CAST(num_calls AS DOUBLE)"))
def _(spark, sf_dir):
    return qc.coverage(summarize.positions(calls(spark, sf_dir)))["summary"]


@register("modfrac_summary", cte(pos()) + _summary_sql("(100 * (CAST(mh_counts AS DOUBLE) / num_calls))"))
def _(spark, sf_dir):
    return qc.modfrac(summarize.positions(calls(spark, sf_dir)))["summary"]


@register("cov_hist", cte(pos()) + "SELECT CAST(ceil(log10(num_calls) / 0.25 - 0.5) * 0.25 AS DOUBLE) AS center, count(*) AS n FROM pos GROUP BY 1")
def _(spark, sf_dir):
    return qc.coverage(summarize.positions(calls(spark, sf_dir)))["histogram"]


@register("modfrac_hist", cte(pos()) + "SELECT CAST(ceil(100 * (CAST(mh_counts AS DOUBLE) / num_calls) / 10 - 0.5) * 10 AS DOUBLE) AS center, count(*) AS n FROM pos GROUP BY 1")
def _(spark, sf_dir):
    return qc.modfrac(summarize.positions(calls(spark, sf_dir)))["histogram"]


@register("volcano_raster", cte(*FLAGSHIP, "points AS (SELECT fc - fn AS x, -log10(p_val) AS y FROM diffed WHERE p_val > 0)", "edges AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points)") + """SELECT x_bin, y_bin, round(x0 + x_bin * (x1 - x0) / 20, 6) AS x, round(y0 + y_bin * (y1 - y0) / 20, 6) AS y, count(*) AS n FROM (SELECT *,
  CAST(least(19, floor((x - x0) / (x1 - x0) * 20)) AS INTEGER) AS x_bin, CAST(least(19, floor((y - y0) / (y1 - y0) * 20)) AS INTEGER) AS y_bin FROM points, edges) AS b GROUP BY x_bin, y_bin, x0, x1, y0, y1""")  # fmt: skip
def _(spark, sf_dir):
    return qc.volcano(flagship_diff(spark, sf_dir), bins=20)


FRACS = "fr AS (SELECT sample_name, chrom, start, {value} AS v FROM {source})"
CORR = "SELECT a.sample_name AS sample_1, b.sample_name AS sample_2, round(corr(a.v, b.v), 6) AS correlation FROM fr AS a JOIN fr AS b ON a.chrom = b.chrom AND a.start = b.start GROUP BY 1, 2"


@register("samplecor_positions", cte(pos(), FRACS.format(value="CAST(m_counts AS DOUBLE) / num_calls", source="pos")) + CORR)
def _(spark, sf_dir):
    return qc.sample_correlation(summarize.positions(calls(spark, sf_dir)))


@register("samplecor_windows_zero_fill", cte(pos(), win(300, 100), """fr AS (SELECT s.sample_name, l.chrom, l.start, coalesce(CAST(w.m_counts AS DOUBLE) / w.num_calls, 0) AS v FROM (SELECT DISTINCT chrom, start FROM win) AS l
  CROSS JOIN (SELECT DISTINCT sample_name FROM win) AS s LEFT JOIN win AS w ON w.sample_name = s.sample_name AND w.chrom = l.chrom AND w.start = l.start)""") + CORR)  # fmt: skip
def _(spark, sf_dir):
    return qc.sample_correlation(summarize.windows(calls(spark, sf_dir), window_size=300, step_size=100), "windows")


@register("pca_scores")
def _(spark, sf_dir):
    return qc.pca(summarize.windows(calls(spark, sf_dir), window_size=1000, step_size=100), "windows")[0]


KDE = """points AS (SELECT fc AS x, fn AS y FROM diffed WHERE fc IS NOT NULL AND fn IS NOT NULL),
  h AS (SELECT count(*) AS n, 1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS hx, 1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS hy FROM points),
  grid AS (SELECT unnest(range(0, 50)) / 49.0 AS v)"""


@register("density_kde", cte(*FLAGSHIP, KDE) + "SELECT round(a.v, 6) AS x, round(b.v, 6) AS y, round(sum(exp(-0.5 * (pow((a.v - p.x) / hx, 2) + pow((b.v - p.y) / hy, 2)))) / (2 * pi() * any_value(n * hx * hy)), 6) AS z FROM grid AS a, grid AS b, points AS p, h GROUP BY a.v, b.v")
def _(spark, sf_dir):
    return qc.diff_density(flagship_diff(spark, sf_dir), n_kde=50)[0]


# --- plans over a store --------------------------------------------------------------------------------------------


def _store(spark: SparkSession) -> ModStore:
    """A new store in the shared folder of spark.checkpoint.dir."""
    store = ModStore(spark, new_folder(spark, "store") + SUFFIX)
    remove_at_exit(spark, store.path)
    return store


@register("sig_export_join", cte(pos(), ENDED, _pooled_sql("ended", SITES), _tested_sql(MIDP)) + f'SELECT p.sample_name, p.chrom, p.start, p."end", p.num_calls, {listed()} FROM (SELECT e.* FROM ended AS e JOIN tested AS t ON e.chrom = t.chrom AND e.start = t.start WHERE t.p_val <= 0.05) AS p')
def _(spark, sf_dir):
    places = summarize.positions(calls(spark, sf_dir))
    return analysis.significant(places, diff.calc_diff(places, CASES, CONTROLS, "mh", "fast_fisher"))


@register("export_roundtrip", cte(pos()) + 'SELECT sample_name, chrom, start, start AS "end", num_calls, mh_counts FROM pos')
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls").summarize_positions()
    schema = ", ".join(f"`{c}` {t}" for c, t in store.read("positions").dtypes)
    return spark.read.option("header", True).schema(schema).csv(store.export("positions", store.path)).select("sample_name", "chrom", "start", "end", "num_calls", "mh_counts")


@register("user_transform", cte(pos()) + "SELECT chrom, CAST(sum(num_calls) AS BIGINT) AS total FROM pos GROUP BY chrom")
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls").summarize_positions()
    return store.transform("positions", lambda df: df.groupBy("chrom").agg(F.sum("num_calls").alias("total")))


@register("user_sql", cte() + "SELECT chrom, call_code, count(*) AS n FROM calls GROUP BY chrom, call_code")
def _(spark, sf_dir):
    return _store(spark).write(calls(spark, sf_dir), "calls").sql("SELECT chrom, call_code, count(*) AS n FROM calls GROUP BY chrom, call_code")


# --- files, stores and analyses, end to end ---------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    made = new_folder(spark, "files")
    fs_of, path = ingest.files(spark)
    fs_of(made).mkdirs(path(made))
    remove_at_exit(spark, made)
    return made


def _archived(spark: SparkSession, rows: DataFrame, folder: str) -> list[str]:
    """Call files S1-<i>.ch3 of a folder, by way of delimited files."""
    rows.write.option("sep", "\t").option("header", True).csv(f"{folder}/tsv")
    return ingest.make_archive(spark, f"{folder}/tsv", "S1", folder)


def _headed(df: DataFrame, path: str, header: bool = True) -> str:
    df.coalesce(1).write.option("sep", "," if path.endswith("csv") else "\t").option("header", header).csv(path)
    return path


def _read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.option("header", True).schema(like.schema).csv(path)


@register("archive_files", ARCHIVE)
def _(spark, sf_dir):
    return spark.read.parquet(*_archived(spark, modkit_rows(spark, sf_dir), _folder(spark)))


def _two_folders(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Two folders whose files have equal names."""
    base, rows = _folder(spark), modkit_rows(spark, sf_dir)
    for name, kmer in (("a", "CG"), ("b", "CA")):
        _archived(spark, rows.where(F.col("query_kmer") == kmer), f"{base}/{name}")
    return f"{base}/a", f"{base}/b"


TWO = f"SELECT * REPLACE (CASE query_kmer WHEN 'CG' THEN 'first' ELSE 'second' END AS sample_name) FROM ({ARCHIVE}) AS f"


@register("load_named_folders", TWO)
def _(spark, sf_dir):
    a, b = _two_folders(spark, sf_dir)
    return ingest.load_calls(spark, [f"first={a}", f"second={b}"])


@register("load_store_by_map", f"SELECT sample_name, count(*) AS n FROM ({TWO}) AS t GROUP BY sample_name")
def _(spark, sf_dir):
    a, b = _two_folders(spark, sf_dir)
    return stats.sample_counts(_store(spark).load({"first": a, "second": b}).read("calls"))


@register("file_stats", f"SELECT count(*) AS num_calls, count(DISTINCT read_id) AS num_reads, round(avg(read_length), 6) AS avg_read_length, count(*) AS high_conf_calls, count(*) AS high_qual_calls, CAST(8 AS BIGINT) AS log_lines FROM ({ARCHIVE}) AS f")
def _(spark, sf_dir):
    folder = _folder(spark)
    _archived(spark, modkit_rows(spark, sf_dir), f"{folder}/calls")
    found = stats.file_stats(spark, f"{folder}/calls/*{ingest.SUFFIX}", f"{folder}/log.txt", silently=True)
    names_ = ("num_calls", "num_reads", "avg_read_length", "high_conf_calls", "high_qual_calls")
    row = (*[found[n] for n in names_], spark.read.text(f"{folder}/log.txt").count())
    return spark.createDataFrame([row], "num_calls bigint, num_reads bigint, avg_read_length double, high_conf_calls bigint, high_qual_calls bigint, log_lines bigint")


@register("regions_from_file", _region_sql("INNER", 1))
def _(spark, sf_dir):
    bed = _headed(regions(spark), f"{_folder(spark)}/regions.bed", header=False)
    return _store(spark).write(calls(spark, sf_dir), "calls").summarize_regions(bed).read("regions")


@register("reads_in_regions_from_file", cte(READS.format(source=IN_WIDE), step=400) + READS_OUT)
def _(spark, sf_dir):
    tsv = _headed(_wide(spark), f"{_folder(spark)}/wide.tsv")
    return _store(spark).write(calls(spark, sf_dir, 400), "calls").summarize_reads(regions_table=tsv).read("reads")


@register("classify_reads_from_file", ORACLES["classify_reads"])
def _(spark, sf_dir):
    key = spark.createDataFrame(KEY, "chrom string, start bigint, `end` bigint, avg_mh_frac_control double, avg_mh_frac_case double, avg_meth_diff double")
    # columns that a key table has and the classes don't need
    key = key.withColumns({c: F.lit(1.0) for c in KEY_COLUMNS if c not in key.columns}).select(*KEY_COLUMNS)
    store = _store(spark).write(calls(spark, sf_dir), "calls").summarize_reads()
    return store.classify_reads(_headed(key, f"{_folder(spark)}/key.csv"), "case", "control").read("classified_reads")


@register("run_analysis_diff", cte(pos(), ENDED, _pooled_sql("ended", SITES), _tested_sql(MIDP), BH, DIFFED) + _diff_out(SITES))
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls")
    made = analysis.run_analysis(store, store.path, CASES, CONTROLS)
    return _read_csv(spark, made["diff"], store.read("mod_diff_positions"))


@register("run_analysis_windows", cte(*FLAGSHIP, ISLANDS) + "SELECT * FROM merged")
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls")
    made = analysis.run_analysis(store, store.path, CASES, CONTROLS, "windows", step_size=100)
    return _read_csv(spark, made["significant"], store.read("collapsed_windows"))


@register("run_qc_correlation", ORACLES["samplecor_positions"])
def _(spark, sf_dir):
    return analysis.run_qc(_store(spark).write(calls(spark, sf_dir), "calls"), "calls")["correlation"]


@register("run_qc_coverage", ORACLES["cov_quantiles"])
def _(spark, sf_dir):
    return analysis.run_qc(_store(spark).write(calls(spark, sf_dir), "calls"), "calls")["coverage"]["quantiles"]


@register("store_append", cte(pos()) + f"{POS_OUT} UNION ALL {POS_OUT}")
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls").summarize_positions()
    return store.summarize_positions(overwrite=False).read("positions")


@register("store_listing", cte() + "SELECT 'sample' AS kind, sample_name AS name FROM (SELECT DISTINCT sample_name FROM calls) AS s UNION ALL SELECT * FROM (VALUES ('table', 'calls'), ('table', 'reads'), ('removed', 'true'), ('removed again', 'false'), ('column', 'chrom'), ('column', 'n')) AS t(kind, name)")
def _(spark, sf_dir):
    store = _store(spark).write(calls(spark, sf_dir), "calls").summarize_positions().summarize_reads()
    store.transform("calls", lambda df: df.groupBy("chrom").agg(F.count("*").alias("n")), "counts")
    found = [("column", c) for c in store.columns("counts")]
    found += [(kind, str(store.remove("positions")).lower()) for kind in ("removed", "removed again")]
    store.remove("counts")
    info = store.info()
    found += [("table", t) for t in info["tables"]] + [("sample", n) for n in info["samples"]]
    return spark.createDataFrame(found, "kind string, name string")
