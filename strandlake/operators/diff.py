"""Case-against-control differences per locus, and Benjamini-Hochberg adjustment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import kernels
from strandlake.schema import require

KEYS = ("region_name", "chrom", "start", "end")
TESTS = ("fast_fisher", "r_fisher", "wilcox", "log_reg")
TUPLE = ["num_calls_case", "num_calls_control", "mod_counts_case", "mod_counts_control"]


def chosen_test(cases: Sequence[str], controls: Sequence[str]) -> str:
    return "wilcox" if min(len(cases), len(controls)) >= 5 else "fast_fisher"


def grouped(df: DataFrame, cases: Sequence[str], controls: Sequence[str], mod_type: str) -> DataFrame:
    """Rows of cases and controls with ``exp_group`` and ``mod_counts``; a name in both is a case."""
    column = f"{mod_type}_counts"
    if column not in df.columns:
        labels = [c.removesuffix("_counts") for c in df.columns if c.endswith("_counts")]
        raise ValueError(f"no measure {mod_type!r}; there are: {', '.join(labels)}")
    require(df, "sample_name", "num_calls")
    group = F.when(F.col("sample_name").isin(*cases), "case").when(F.col("sample_name").isin(*controls), "control")
    kept = df.select("sample_name", *[c for c in KEYS if c in df.columns], "num_calls", F.col(column).alias("mod_counts"), group.alias("exp_group")).where("exp_group IS NOT NULL")
    seen = {r[0] for r in kept.select("sample_name").distinct().collect()}
    for names, kind in ((cases, "case"), (controls, "control")):
        if missing := [n for n in names if n not in seen]:
            raise ValueError(f"{kind} samples that are not in the data: {', '.join(missing)}")
    return kept


def with_p_values(dat: DataFrame, test: str) -> DataFrame:
    """The rows with p_val, in Arrow batches; the equal counts of a batch are tested once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in TUPLE])
            (kc, kn, mc, mn), which = np.unique(counts, axis=1, return_inverse=True)
            oc, on = kc - mc, kn - mn
            if test == "log_reg":
                p = kernels.log_likelihood_ratio(mc, oc, mn, on)[1]
            else:
                p = (kernels.mid_p if test == "fast_fisher" else kernels.fisher_exact)(mc, mc + mn, oc + on, kc)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[which.reshape(-1)], pa.float64())], names=[*b.schema.names, "p_val"])

    return dat.mapInArrow(run, T.StructType([*dat.schema.fields, T.StructField("p_val", T.DoubleType())]))


def _side(value: str, group: str):
    return F.sum(F.when(F.col("exp_group") == group, F.col(value)).otherwise(0)).cast("long").alias(f"{value}_{group}")


def pooled(kept: DataFrame, test: str) -> DataFrame:
    """Fisher tests and the likelihood-ratio test, on counts that are pooled by group."""
    keys = [c for c in KEYS if c in kept.columns]
    dat = kept.groupBy(*keys).agg(*[_side(v, g) for v in ("num_calls", "mod_counts") for g in ("case", "control")])
    dat = with_p_values(dat, test)
    share = lambda g: F.try_divide(F.col(f"mod_counts_{g}").cast("double"), F.nullif(F.col(f"num_calls_{g}"), F.lit(0)).cast("double"))
    return dat.select(
        *keys, "num_calls_case", "num_calls_control", "mod_counts_case", "mod_counts_control",
        *[(F.col(f"num_calls_{g}") - F.col(f"mod_counts_{g}")).alias(f"other_counts_{g}") for g in ("case", "control")],
        share("case").alias("mod_frac_case"), share("control").alias("mod_frac_control"), (share("case") - share("control")).alias("meth_diff"), "p_val",
    )


def ranked(kept: DataFrame) -> DataFrame:
    """Wilcoxon tests on the samples' fractions; the difference is that of the mean fractions."""
    keys = [c for c in KEYS if c in kept.columns]
    frac = F.when(F.col("num_calls") > 0, F.try_divide(F.col("mod_counts").cast("double"), F.col("num_calls").cast("double")))
    kept = kept.withColumn("frac", frac)
    side = lambda g, f, v: f(F.when(F.col("exp_group") == g, v))
    dat = kept.groupBy(*keys).agg(
        *[F.count(F.when(F.col("exp_group") == g, 1)).alias(f"num_samples_{g}") for g in ("case", "control")],
        *[_side(v, g) for v in ("num_calls", "mod_counts") for g in ("case", "control")],
        *[side(g, F.avg, F.col("frac")).alias(f"mod_frac_{g}") for g in ("case", "control")],
        *[F.array_sort(side(g, F.collect_list, F.col("frac"))).alias(f"_{g}") for g in ("case", "control")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            p = [kernels.wilcoxon(x or [], y or []) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(p, pa.float64())], names=[*b.schema.names[:-2], "p_val"])

    schema = T.StructType([*dat.schema.fields[:-2], T.StructField("p_val", T.DoubleType())])
    out = dat.mapInArrow(run, schema).withColumn("meth_diff", F.col("mod_frac_case") - F.col("mod_frac_control"))
    names = [f"{v}_{g}" for v in ("num_samples", "num_calls", "mod_counts", "mod_frac") for g in ("case", "control")]
    return out.select(*keys, *names, "meth_diff", "p_val")


def bh_adjust(df: DataFrame, p: str = "p_val", adjusted: str = "p_adjust") -> DataFrame:
    """Benjamini-Hochberg: nulls stay null and don't count.

    Tied p-values are counted together first. Ranks and the running minimum from the largest p down are
    found within buckets that follow the order of p, and across the buckets, of which there are a
    bounded number; so no task sorts all p-values.
    """
    ties = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    band = F.when(F.col("_p") >= 0.001, F.floor(F.col("_p") * 1000)).otherwise(-F.floor(-F.log10(F.greatest(F.col("_p"), F.lit(1e-320))) * 10)).cast("int")
    ties = ties.withColumn("_band", band)
    bands = ties.groupBy("_band").agg(F.sum("_n").alias("_in_band"))
    # at most some 4,300 bands: one small partition
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_before", F.coalesce(F.sum("_in_band").over(before), F.lit(0))).withColumn("_all", F.sum("_in_band").over(Window.partitionBy()))
    up = Window.partitionBy("_band").orderBy("_p")
    placed = ties.join(F.broadcast(bands), "_band").withColumn("_rank", F.col("_before") + F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_q", F.col("_p") * F.col("_all") / F.col("_rank"))
    least = placed.groupBy("_band").agg(F.min("_q").alias("_least"))
    after = least.withColumn("_after", F.min("_least").over(Window.orderBy("_band").rowsBetween(1, Window.unboundedFollowing))).select("_band", "_after")
    placed = placed.join(F.broadcast(after), "_band").withColumn("_down", F.min("_q").over(up.rowsBetween(0, Window.unboundedFollowing)))
    placed = placed.select("_p", F.least(F.lit(1.0), "_down", F.coalesce("_after", F.lit(1.0))).alias(adjusted))
    # rows without a p-value meet nothing; a key below 0 of their own deals them over all tasks
    keyed = df.withColumn("_key", F.coalesce(F.col(p), -1.0 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20))))
    return keyed.join(placed, F.col("_key") == F.col("_p"), "left").drop("_p", "_key")


def calc_diff(df: DataFrame, cases: Sequence[str], controls: Sequence[str], mod_type: str = "mh", calc_type: str | None = None) -> DataFrame:
    """Difference table of a summary of positions, windows or regions."""
    test = calc_type or chosen_test(cases, controls)
    if test not in TESTS:
        raise ValueError(f"unknown calc_type {test!r}; one of {', '.join(TESTS)}")
    kept = grouped(df, list(cases), list(controls), mod_type)
    found = bh_adjust(ranked(kept) if test == "wilcox" else pooled(kept, test))
    names = {c: f"{mod_type}{c[3:]}" for c in found.columns if c.startswith("mod_")}
    # the complement is named c, unless c itself is the measure
    names |= {f"other_counts_{g}": f"c_counts_{g}" for g in ("case", "control") if mod_type != "c"}
    return found.withColumnsRenamed(names)
