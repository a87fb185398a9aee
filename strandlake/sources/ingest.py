"""Archiving delimited calls as call files, and loading call files as one table of calls."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schema import CALL_COLUMNS, KEY_COLUMNS, REGION_COLUMNS, modkit_schema, require

SUFFIX = ".ch3"


def files(spark: SparkSession):
    """Hadoop's FileSystem and Path, which read any store that Spark reads."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(str(p))
    return (lambda p: path(p).getFileSystem(conf)), path


def read_modkit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Delimited calls with a header; columns are found by name, extra ones are ignored."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path)
    types = {f.name: f.dataType for f in modkit_schema()}
    require(header, *types)
    return header.select(*[F.col(n).try_cast(t).alias(n) for n, t in types.items()])


def archived(rows: DataFrame, sample_name: str, short_ids: bool = True) -> DataFrame:
    """Call-file columns of modkit rows: placed rows only, strands of a CG site folded onto one interval."""
    minus, plus, cg = F.col("ref_mod_strand") == "-", F.col("ref_mod_strand") == "+", F.col("query_kmer") == "CG"
    kept = rows.where(~(minus & (F.col("ref_position") == 0)))
    read_id = F.substring_index("read_id", "-", -1) if short_ids else F.col("read_id")
    return kept.select(
        F.lit(sample_name).alias("sample_name"), read_id.alias("read_id"), "chrom",
        F.when(minus & cg, F.col("ref_position") - 1).when((minus & cg).isNotNull(), F.col("ref_position")).alias("start"),
        F.when(plus & cg, F.col("ref_position") + 2).when((plus & cg).isNotNull(), F.col("ref_position") + 1).alias("end"),
        F.col("forward_read_position").alias("read_position"), "read_length", "query_kmer", "call_prob", "call_code", "base_qual", "flag",
    )


def make_archive(spark: SparkSession, file_name: str | list[str], sample_name: str, out_path: str, short_ids: bool = True) -> list[str]:
    """Write <sample>-<i>.ch3 (Parquet, zstd) from delimited calls; returns the files."""
    fs_of, path = files(spark)
    for name in [file_name] if isinstance(file_name, str) else file_name:
        if not fs_of(name).exists(path(name)):
            raise FileNotFoundError(f"no such file: {name}")
    staging = f"{out_path}/.{sample_name}-staging"
    archived(read_modkit(spark, file_name), sample_name, short_ids).write.mode("overwrite").option("compression", "zstd").parquet(staging)
    fs, made = fs_of(out_path), []
    parts = sorted(str(s.getPath()) for s in fs.listStatus(path(staging)) if s.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        target = f"{out_path}/{sample_name}-{i}{SUFFIX}"
        fs.delete(path(target), False)
        fs.rename(path(part), path(target))
        made.append(target)
    fs.delete(path(staging), True)
    return made


def sample_of_file(name: str) -> str:
    """S1 for .../S1-0.ch3."""
    stem = re.sub(r"(?i)\.ch3$", "", name.rstrip("/").rpartition("/")[2])
    return re.sub(r"-[0-9]+$", "", stem)


def resolve_inputs(spark: SparkSession, inputs: str | Iterable[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    """(file, sample) of files, folders of call files, "name=path" strings, or a map from names to paths."""
    if isinstance(inputs, Mapping):
        pairs = [(name, p) for name, p in inputs.items()]
    else:
        listed = [inputs] if isinstance(inputs, str) else list(inputs)
        pairs = [tuple(x.split("=", 1)) if "=" in x else ("", x) for x in listed]
    fs_of, path = files(spark)
    found = []
    for name, p in pairs:
        fs = fs_of(p)
        if not fs.exists(path(p)):
            raise FileNotFoundError(f"no such path: {p}")
        status = fs.getFileStatus(path(p))
        inside = [status] if status.isFile() else [s for s in fs.listStatus(path(p)) if s.isFile() and s.getPath().getName().endswith(SUFFIX)]
        if not inside:
            raise FileNotFoundError(f"no {SUFFIX} files in {p}")
        found += [(f, name.strip() or sample_of_file(f)) for f in sorted(str(s.getPath()) for s in inside)]
    return found


def call_filter(df: DataFrame, chrom=None, min_read_length: int = 50, min_call_prob: float = 0.9, min_base_qual: int = 10, flag: int | None = None) -> DataFrame:
    prob = F.lit(float(min_call_prob)).cast(df.schema["call_prob"].dataType)  # a float column compares as float
    kept = df.where((F.col("read_length") >= min_read_length) & (F.col("call_prob") >= prob) & (F.col("base_qual") >= min_base_qual))
    if chrom:
        kept = kept.where(F.col("chrom").isin(*([chrom] if isinstance(chrom, str) else chrom)))
    return kept if flag is None else kept.where(F.col("flag") == flag)


def load_calls(spark: SparkSession, inputs, chrom=None, min_read_length: int = 50, min_call_prob: float = 0.9, min_base_qual: int = 10, flag: int | None = None) -> DataFrame:
    """All calls of the files that pass the filters; the file, not its sample column, names the sample."""
    pairs = resolve_inputs(spark, inputs)
    raw = spark.read.parquet(*[f for f, _ in pairs])
    kept = call_filter(raw.withColumn("_file", F.col("_metadata.file_path")).drop("sample_name"), chrom, min_read_length, min_call_prob, min_base_qual, flag)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = spark.createDataFrame(pairs, "_path string, sample_name string").select(bare(F.col("_path")).alias("_path"), "sample_name")
    # one row per input file, and the paths are on the driver already
    joined = kept.join(F.broadcast(named), bare(F.url_decode("_file")) == F.col("_path"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in CALL_COLUMNS if c in joined.columns])


def _delimited(spark: SparkSession, path: str) -> DataFrame:
    ext = path.rpartition(".")[2].lower()
    if ext not in ("csv", "tsv", "bed"):
        raise ValueError(f"not a CSV, TSV or BED file: {path}")
    return spark.read.option("sep", "," if ext == "csv" else "\t").option("mode", "PERMISSIVE")


def with_region_names(df: DataFrame) -> DataFrame:
    """Names from the coordinates, if the table has none at all."""
    made = F.concat_ws("_", "chrom", "start", "end")
    if "region_name" not in df.columns or not df.where("region_name IS NOT NULL").limit(1).count():
        return df.withColumn("region_name", made)
    return df


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a CSV, TSV or BED file, with or without a header."""
    raw = _delimited(spark, path).schema(", ".join(f"`{c}` string" for c in REGION_COLUMNS)).csv(path)
    rows = raw.where(~F.lower(F.coalesce("chrom", F.lit(""))).isin("chr", "chrom"))
    return with_region_names(rows.select("chrom", *[F.col(c).cast("double").cast("long").alias(c) for c in ("start", "end")], "region_name"))


def read_headed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    raw = _delimited(spark, path).option("header", True).option("inferSchema", True).csv(path)
    require(raw, *columns)
    return raw


def read_filter_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_headed(spark, path, ["chrom", "start", "end"])


def read_key_table(spark: SparkSession, path: str) -> DataFrame:
    return read_headed(spark, path, KEY_COLUMNS)
