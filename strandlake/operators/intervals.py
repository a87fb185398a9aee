"""Interval joins: points in regions, and overlapping intervals.

Intervals are cut at multiples of the genomic width ``BUCKET`` and joined by (chromosome, bucket), so that
a place only meets what lies near it. Below ``BROADCAST_ROWS`` pieces, which are counted first, they are
broadcast; beyond that both sides are shuffled, and a chromosome is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 10_000
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has no more rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket(column: Column) -> Column:
    return F.floor(column.cast("double") / BUCKET).cast("long")


def pieces(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row for each bucket that an interval touches; empty intervals have none."""
    return df.where(F.col(first) <= F.col(last)).withColumn(name, F.explode(F.sequence(bucket(F.col(first)), bucket(F.col(last)))))


def points_in_regions(points: DataFrame, regions: DataFrame, how: str = "inner", half_open: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join points (chrom, start) to regions (r_chrom, r_start, r_end); both ends belong to a region unless half_open."""
    at = F.col("start").cast("double")
    inside = (at >= F.col("r_start")) & ((at < F.col("r_end")) if half_open else (at <= F.col("r_end")))
    cut = pieces(regions, "r_start", "r_end", "r_bucket")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("p_bucket") == F.col("r_bucket")) & inside
    return points.withColumn("p_bucket", bucket(F.col("start"))).join(sized(cut, broadcast_rows), on, how).drop("p_bucket", "r_bucket")


def in_region(calls: DataFrame, annotation: DataFrame, legacy_bucket: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Calls that lie in a region, once per region. ``legacy_bucket``: only those in the first bucket of the region."""
    r = annotation.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = points_in_regions(calls, r, "inner", False, broadcast_rows)
    if legacy_bucket:
        found = found.where(bucket(F.col("start")) == bucket(F.col("r_start")))
    return found.select(*[F.col(f"`{c}`") for c in calls.columns])


def overlapping(left: DataFrame, first: str, last: str, right: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join intervals [first, last] of ``left`` (chrom) to the overlapping ones of ``right`` (k_chrom, k_start, k_end)."""
    touch = (F.col("chrom") == F.col("k_chrom")) & (F.col(first) <= F.col("k_end")) & (F.col(last) >= F.col("k_start"))
    right = sized(pieces(right, "k_start", "k_end", "k_bucket"), broadcast_rows)
    joined = pieces(left, first, last, "l_bucket").join(right, touch & (F.col("l_bucket") == F.col("k_bucket")))
    # a pair meets in several buckets; it counts in the first that both have
    return joined.where(F.col("l_bucket") == F.greatest(bucket(F.col(first)), bucket(F.col("k_start")))).drop("l_bucket", "k_bucket")
