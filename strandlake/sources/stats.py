"""Statistics of call files and tables of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(calls: DataFrame, call_prob: float = 0.9, base_qual: int = 10) -> DataFrame:
    """One row: calls, reads, mean read length, and calls that reach the two thresholds."""
    reach = lambda c, v: F.coalesce(F.sum(F.when(F.col(c) >= v, 1).otherwise(0)), F.lit(0)).cast("long")
    return calls.agg(
        F.count("*").alias("num_calls"), F.countDistinct("read_id").alias("num_reads"), F.avg("read_length").alias("avg_read_length"),
        reach("call_prob", call_prob).alias("high_conf_calls"), reach("base_qual", base_qual).alias("high_qual_calls"),
    )


def site_coverage(calls: DataFrame, min_reads=(1, 5, 10, 15)) -> DataFrame:
    """(min_reads, covered, percent) of the sites (chrom, start)."""
    sites = calls.groupBy("chrom", "start").agg(F.count("*").alias("n"))
    counted = sites.agg(F.count("*").alias("sites"), *[F.coalesce(F.sum(F.when(F.col("n") >= k, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"c{k}") for k in min_reads])
    rows = F.array(*[F.struct(F.lit(int(k)).alias("min_reads"), F.col(f"c{k}").alias("covered")) for k in min_reads])
    return counted.select("sites", F.explode(rows).alias("r")).select("r.min_reads", "r.covered", F.try_divide(F.col("r.covered") * 100.0, F.col("sites")).alias("percent"))


def flag_counts(calls: DataFrame) -> DataFrame:
    """(flag, n, percent)."""
    from pyspark.sql import Window

    return calls.groupBy("flag").agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def file_stats(spark: SparkSession, ch3_file: str, log_file: str | None = None, min_reads=(1, 5, 10, 15), call_prob_threshold: float = 0.9, base_qual_threshold: int = 10, silently: bool = False) -> dict:
    calls = spark.read.parquet(ch3_file)
    t = totals(calls, call_prob_threshold, base_qual_threshold).first().asDict()
    stats = {
        "num_calls": t["num_calls"], "num_reads": t["num_reads"], "avg_read_length": t["avg_read_length"],
        "coverage": [tuple(r) for r in site_coverage(calls, min_reads).orderBy("min_reads").collect()], "flags": [tuple(r) for r in flag_counts(calls).orderBy("flag").collect()],
        "high_conf_calls": t["high_conf_calls"], "high_qual_calls": t["high_qual_calls"],
    }
    text = "\n".join(f"{k}: {v}" for k, v in {"file": ch3_file, **stats}.items())
    if not silently:
        print(text)
    if log_file:
        from strandlake.sources.ingest import files

        fs_of, path = files(spark)
        out = fs_of(log_file).create(path(log_file), True)
        out.write(bytearray(text.encode() + b"\n"))
        out.close()
    return stats


def site_count(calls: DataFrame, by_chrom: bool = False) -> DataFrame:
    """(num_sites) distinct intervals; the chromosome doesn't tell them apart unless by_chrom."""
    return calls.select(*(["chrom"] if by_chrom else []), "start", "end").distinct().agg(F.count("*").alias("num_sites"))


def sample_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_name").agg(F.count("*").alias("n"))
