"""Summaries of calls by position, window, region and read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.codes import DEFAULT_SPECS, count_columns, frac_columns, measures, sum_columns
from strandlake.operators.intervals import in_region, points_in_regions
from strandlake.schema import DEFAULT_CHROMS, require


def selected_calls(calls: DataFrame, chrs: Sequence[str] | None = DEFAULT_CHROMS, samples: Sequence[str] | None = None) -> DataFrame:
    """Calls after position 0 of the wanted chromosomes and samples; unknown sample names are ignored."""
    require(calls, "sample_name", "chrom", "start", "call_code")
    kept = calls.where((F.col("start") > 0) & F.col("sample_name").isNotNull())
    if chrs:
        kept = kept.where(F.col("chrom").isin(*chrs))
    if samples is not None:
        kept = kept.where(F.col("sample_name").isin(*samples))
        if not calls.where(F.col("sample_name").isin(*samples)).limit(1).count():
            raise ValueError("none of the requested samples is in the table")
    return kept


def _counted(calls: DataFrame, keys: list[str], specs) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("num_calls"), *count_columns(specs))


def positions(calls: DataFrame, chrs: Sequence[str] | None = DEFAULT_CHROMS, samples: Sequence[str] | None = None, mod_code=DEFAULT_SPECS, unmod_code: str = "-", unmod_label: str = "c", min_num_calls: int = 1) -> DataFrame:
    """Calls per (sample, chrom, start); the end is the start."""
    specs = measures(mod_code, unmod_code, unmod_label)
    labels = [m.label for m in specs]
    found = _counted(selected_calls(calls, chrs, samples), ["sample_name", "chrom", "start"], specs)
    found = found.where(F.col("num_calls") >= min_num_calls)
    return found.select("sample_name", "chrom", "start", F.col("start").alias("end"), "num_calls", *[f"{x}_counts" for x in labels], *frac_columns(labels))


def window_start(start: Column, offset: Column, window_size: int, edge: str = "compat") -> Column:
    """First position of the tile that holds a position, for tiles that begin at offset modulo the size.

    "compat": positions before the offset belong to the tile that begins at it; "floor": to the one before.
    """
    step = F.pmod(start - offset, F.lit(window_size)) if edge == "floor" else (start - offset) % window_size
    return start - step


def windows(calls: DataFrame, chrs: Sequence[str] | None = DEFAULT_CHROMS, samples: Sequence[str] | None = None, window_size: int = 1000, step_size: int = 10, mod_code=DEFAULT_SPECS, unmod_code: str = "-", unmod_label: str = "c", min_num_calls: int = 1, edge: str = "compat", prebin: bool = True) -> DataFrame:
    """Staggered tilings of positions, all offsets in one pass.

    If the step divides the size, positions are first summed into step-wide bins, which no tile's edge
    cuts; the fan-out to offsets then starts from the bins.
    """
    if window_size < 2 or step_size < 1:
        raise ValueError("window_size must be 2 or more, step_size 1 or more")
    if edge not in ("compat", "floor"):
        raise ValueError("edge must be 'compat' or 'floor'")
    specs = measures(mod_code, unmod_code, unmod_label)
    labels = [m.label for m in specs]
    sums = sum_columns(labels)
    keys = ["sample_name", "chrom"]
    found = _counted(selected_calls(calls, chrs, samples), [*keys, "start"], specs).withColumn("num_CpGs", F.lit(1).cast("long"))
    totals = [F.sum("num_CpGs").alias("num_CpGs"), F.sum("num_calls").alias("num_calls"), *sums]
    if prebin and step_size > 1 and window_size % step_size == 0:
        found = found.withColumn("start", F.col("start") - F.pmod(F.col("start") - 1, F.lit(step_size))).groupBy(*keys, "start").agg(*totals)
    offsets = F.sequence(F.lit(1), F.lit(window_size - 1), F.lit(step_size))
    spread = found.withColumn("offset", F.explode(offsets)).withColumn("start", window_start(F.col("start"), F.col("offset"), window_size, edge).cast("long"))
    tiles = spread.groupBy(*keys, "start").agg(*totals).where(F.col("num_calls") >= min_num_calls)
    return tiles.select(*keys, "start", (F.col("start") + window_size - 1).alias("end"), "num_CpGs", "num_calls", *[f"{x}_counts" for x in labels], *frac_columns(labels))


def regions(calls: DataFrame, annotation: DataFrame, join: str = "inner", chrs: Sequence[str] | None = DEFAULT_CHROMS, samples: Sequence[str] | None = None, mod_code=DEFAULT_SPECS, unmod_code: str = "-", unmod_label: str = "c", min_num_calls: int = 1, half_open: bool = False, harmonize: bool = True) -> DataFrame:
    """Positions summed over annotated regions.

    "left" keeps positions outside all regions (one row without a region per sample), "right" regions
    without positions (per sample; they have no calls, so they need min_num_calls = 0 to stay).
    """
    if join not in ("inner", "left", "right"):
        raise ValueError("join must be 'inner', 'left' or 'right'")
    specs = measures(mod_code, unmod_code, unmod_label)
    labels = [m.label for m in specs]
    chosen = selected_calls(calls, chrs, samples)
    places = _counted(chosen, ["sample_name", "chrom", "start", "end"], specs)
    where = annotation.select(*["chrom", "start", "end", "region_name"])
    if harmonize:
        where = harmonized(where, calls)
    r = where.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "region_name")
    total = F.coalesce(F.sum("num_calls"), F.lit(0)).cast("long").alias("num_calls")
    kept = places.select("sample_name", "chrom", "start", "num_calls", *[f"{x}_counts" for x in labels])
    if join == "right":
        # every region for every sample that has calls at all; the names are as many as there are samples
        names = calls.where(F.col("sample_name").isNotNull()).select("sample_name").distinct()
        names = [r[0] for r in (names if samples is None else names.where(F.col("sample_name").isin(*samples))).collect()]
        hits = points_in_regions(kept, r, "inner", half_open).groupBy("sample_name", "region_name", "r_chrom", "r_start", "r_end").agg(F.count("*").alias("n"), F.sum("num_calls").alias("calls"), *[F.sum(f"{x}_counts").alias(f"{x}_counts") for x in labels])
        # equal regions that repeat are one group, whose rows each count
        unit = r.groupBy("region_name", "r_chrom", "r_start", "r_end").agg(F.count("*").alias("copies"))
        grid = unit.withColumn("sample_name", F.explode(F.array(*map(F.lit, sorted(names)))))
        same = [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("sample_name", "region_name", "r_chrom", "r_start", "r_end")]
        on = same[0]
        for s in same[1:]:
            on = on & s
        both = grid.alias("g").join(hits.alias("h"), on, "left")
        found = both.select(
            F.when(F.col("h.n").isNotNull(), F.col("g.sample_name")).alias("sample_name"), F.col("g.region_name").alias("region_name"), F.col("g.r_chrom").alias("chrom"), F.col("g.r_start").alias("start"), F.col("g.r_end").alias("end"),
            F.coalesce("h.n", "g.copies").alias("num_CpGs"), F.coalesce("h.calls", F.lit(0)).cast("long").alias("num_calls"), *[F.coalesce(f"h.{x}_counts", F.lit(0)).cast("long").alias(f"{x}_counts") for x in labels],
        )
    else:
        found = points_in_regions(kept, r, join, half_open).groupBy("sample_name", "region_name", F.col("r_chrom").alias("chrom"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
        found = found.agg(F.count("*").alias("num_CpGs"), total, *sum_columns(labels))
    found = found.where(F.col("num_calls") >= min_num_calls)
    return found.select("sample_name", "region_name", "chrom", "start", "end", "num_CpGs", "num_calls", *[f"{x}_counts" for x in labels], *frac_columns(labels))


def harmonized(annotation: DataFrame, calls: DataFrame) -> DataFrame:
    """The annotation with or without the prefix "chr", as the calls have it; all names or none are changed."""
    with_prefix = bool(calls.where(F.col("chrom").like("chr%")).limit(1).count())
    has = bool(annotation.where(F.col("chrom").like("chr%")).limit(1).count())
    if with_prefix and not has:
        return annotation.withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    if has and not with_prefix:
        return annotation.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return annotation


def reads(calls: DataFrame, annotation: DataFrame | None = None, min_length: int = 100, min_CGs: int = 5, legacy_bucket: bool = False) -> DataFrame:
    """Counts and fractions per read_id; with regions, of the calls in them (once per region that holds a call)."""
    kept = calls if annotation is None else in_region(calls, annotation, legacy_bucket)
    count = lambda *codes: F.sum(F.when(F.col("call_code").isin(*codes), 1).otherwise(0)).cast("long")
    found = kept.groupBy("read_id").agg(
        F.min("sample_name").alias("sample_name"), F.min("chrom").alias("chrom"), F.count("*").alias("total_calls"), F.min("start").alias("first_cpg_pos"), F.max("end").alias("last_cpg_pos"), F.min("read_length").alias("read_length"),
        count("-").alias("c_counts"), count("m").alias("m_counts"), count("h").alias("h_counts"), count("m", "h").alias("mh_counts"),
    )
    found = found.where((F.col("total_calls") >= min_CGs) & (F.col("read_length") >= min_length))
    return found.select("sample_name", "read_id", "chrom", "total_calls", "first_cpg_pos", "last_cpg_pos", "read_length", "c_counts", "m_counts", "h_counts", "mh_counts", *frac_columns(["m", "h", "mh"], "total_calls"))
