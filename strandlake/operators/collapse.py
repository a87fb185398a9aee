"""Merging significant windows, and classifying reads by the merged regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.intervals import BROADCAST_ROWS, overlapping
from strandlake.schema import KEY_COLUMNS, require

AVERAGED = ("_counts_control", "_counts_case", "_frac_control", "_frac_case")


#: Stretch of a chromosome that one task merges.
BLOCK = 1_000_000


def collapse_windows(diff: DataFrame, max_distance: int = 1000, sig_cutoff: float = 0.05, min_diff: float = 0.5) -> DataFrame:
    """Islands of significant windows of one chromosome and sign whose gaps are at most ``max_distance``.

    Islands are found within blocks of a chromosome. One that goes on in the next block takes its name, the
    start of its first window, along over the table of the blocks' edges, which is small.
    """
    require(diff, "chrom", "start", "end", "meth_diff", "p_adjust")
    kept = diff.where((F.col("p_adjust") <= sig_cutoff) & (F.abs("meth_diff") >= min_diff))
    kept = kept.withColumns({"_sign": F.signum("meth_diff"), "_block": F.floor(F.col("start") / BLOCK)})
    apart = lambda end, sign, start, own: (end + max_distance < start) | (sign != own)
    inside, along = Window.partitionBy("chrom", "_block").orderBy("start"), Window.partitionBy("chrom").orderBy("_block")
    kept = kept.withColumn("_head", F.when(apart(F.lag("end").over(inside), F.lag("_sign").over(inside), F.col("start"), F.col("_sign")), F.col("start")))
    edges = kept.groupBy("chrom", "_block").agg(F.min("start").alias("start"), F.min_by("_sign", "start").alias("own"), F.max_by(F.struct("end", "_sign"), "start").alias("last"), F.max("_head").alias("head"))
    before = F.lag("last").over(along)
    edges = edges.withColumn("opens", F.when(before.isNull() | apart(before["end"], before["_sign"], F.col("start"), F.col("own")), F.col("start")))
    going = F.last(F.coalesce("head", "opens"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("chrom", "_block", F.coalesce("opens", going).alias("_first"))
    found = kept.withColumn("_own", F.last("_head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(edges, ["chrom", "_block"])
    means = [F.avg(c).alias(f"avg_{c}") for c in diff.columns if c.endswith(AVERAGED)]
    merged = found.groupBy("chrom", F.coalesce("_own", "_first").alias("_island")).agg(F.min("start").alias("start"), F.max("end").alias("end"), *means, F.avg("meth_diff").alias("avg_meth_diff"), F.count("*").alias("num_windows"))
    return merged.drop("_island")


def classify_reads(reads: DataFrame, key: DataFrame, case: str, control: str, meth_diff_threshold: float = 0.1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each read once per key region that it overlaps: control, case or unknown, by its distance from their means."""
    require(key, *KEY_COLUMNS)
    if key.where(F.lit(meth_diff_threshold) >= F.abs("avg_meth_diff") / 2).limit(1).count():
        raise ValueError("meth_diff_threshold must be less than half of every avg_meth_diff")
    k = key.select(F.col("chrom").alias("k_chrom"), F.col("start").alias("k_start"), F.col("end").alias("k_end"), F.col("avg_mh_frac_control").alias("k_control"), F.col("avg_mh_frac_case").alias("k_case"))
    near = lambda c: F.abs(F.col("mh_frac") - F.col(c)) <= meth_diff_threshold
    label = F.when(near("k_control"), control).when(near("k_case"), case).otherwise("unknown")
    found = overlapping(reads, "first_cpg_pos", "last_cpg_pos", k, broadcast_rows)
    return found.select("sample_name", "read_id", "first_cpg_pos", "last_cpg_pos", "mh_frac", label.alias("classification"))
