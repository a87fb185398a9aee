"""A store of named Parquet tables in one folder, which is also a Spark database.

Tables are written to a staging folder and swapped in by renames, the old one being moved aside first, so
that a table can be computed from itself; a write that breaks off leaves the old table, at the latest when
the store is opened again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import calls as call_ops
from strandlake.operators import collapse, diff, qc, summarize
from strandlake.sources import ingest, stats

SUFFIX = ".mod.db"


class ModStore:
    def __init__(self, spark: SparkSession, path: str, current_table: str | None = None):
        self.spark = spark
        self.path = path if path.endswith(SUFFIX) else path + SUFFIX
        self.current_table = current_table
        self._fs_of, self._path = ingest.files(spark)
        self.fs = self._fs_of(self.path)
        self.fs.mkdirs(self._path(self.path))
        for old in self.fs.listStatus(self._path(self.path)):  # a write that broke off between its two renames
            name = old.getPath().getName()
            if name.startswith(".old-") and not self.exists(name[5:]):
                self.fs.rename(old.getPath(), self._path(self._at(name[5:])))
        self.database = "mods_" + hashlib.sha256(self.path.encode()).hexdigest()[:12]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.path}'")
        for name in self.tables():
            self._register(name)

    def __repr__(self) -> str:
        return f"ModStore(file={self.path!r}, current_table={self.current_table!r}, tables={self.tables()})"

    # --- tables ---------------------------------------------------------------------------------

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _register(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.`{table}`")
        self.spark.sql(f"CREATE TABLE {self.database}.`{table}` USING parquet LOCATION '{self._at(table)}'")

    def tables(self) -> list[str]:
        listed = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)) if s.isDirectory()]
        return sorted(n for n in listed if not n.startswith((".", "_")))

    def exists(self, table: str) -> bool:
        return table in self.tables()

    def read(self, table: str) -> DataFrame:
        if not self.exists(table):
            raise ValueError(f"table {table!r} does not exist; there are: {', '.join(self.tables())}")
        return self.spark.read.parquet(self._at(table))

    def write(self, df: DataFrame, table: str, mode: str = "overwrite") -> ModStore:
        """overwrite, append, or error if the table exists; appended columns must be those of the table."""
        if mode == "error" and self.exists(table):
            raise ValueError(f"table {table!r} exists; set overwrite to replace it")
        if mode == "append" and self.exists(table):
            df.select(*[F.col(f"`{c}`") for c in self.read(table).columns]).write.mode("append").parquet(self._at(table))
        else:
            staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
            df.write.parquet(staging)
            aside = f"{self.path}/.old-{table}"
            self.fs.delete(self._path(aside), True)
            if self.exists(table):
                self.fs.rename(self._path(self._at(table)), self._path(aside))
            self.fs.rename(self._path(staging), self._path(self._at(table)))
            self.fs.delete(self._path(aside), True)
        self._register(table)
        self.current_table = table
        return self

    def remove(self, table: str) -> bool:
        """Whether there was such a table."""
        there = self.exists(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.`{table}`")
        if there:
            self.fs.delete(self._path(self._at(table)), True)
        print(f"Table {table!r} " + ("removed." if there else "does not exist."))
        return there

    def columns(self, table: str) -> list[str]:
        return self.read(table).columns

    def table_info(self, table: str) -> dict:
        df = self.read(table)
        per = {r[0]: r[1] for r in stats.sample_counts(df).orderBy("sample_name").collect()} if "sample_name" in df.columns else {}
        return {"table": table, "rows": df.count(), "samples": per, "columns": df.columns}

    def info(self) -> dict:
        size = self.fs.getContentSummary(self._path(self.path)).getLength()
        names = [r[0] for r in self.read("calls").select("sample_name").distinct().orderBy("sample_name").collect()] if self.exists("calls") else []
        return {"file": self.path, "size_mb": size / 1e6, "tables": self.tables(), "samples": names}

    def get(self, table: str, max_rows: int | None = None, seed: int | None = None) -> DataFrame | None:
        """The table or a random sample of it; None, with a message, if it doesn't exist."""
        if not self.exists(table):
            print(f"Table {table!r} does not exist.")
            return None
        return self.read(table) if max_rows is None else call_ops.sample_rows(self.read(table), max_rows, seed)

    def export(self, table: str = "positions", out_path: str = ".") -> str | None:
        """One CSV file with a header: out_path itself if it ends in .csv, else <out_path>/<table>.csv."""
        target = out_path if out_path.lower().endswith(".csv") else f"{out_path.rstrip('/') or ''}/{table}.csv"
        if not self.exists(table):
            print(f"Table {table!r} does not exist.")
            return None
        return write_csv(self.read(table), target)

    # --- operators over tables ------------------------------------------------------------------------

    def load(self, inputs, overwrite: bool = False, **filters) -> ModStore:
        """Replace all tables by ``calls`` from call files."""
        if self.tables() and not overwrite:
            raise ValueError(f"{self.path} is not empty; set overwrite to replace its tables")
        calls = ingest.load_calls(self.spark, inputs, **filters)
        for name in self.tables():
            self.remove(name)
        return self.write(calls, "calls")

    def _summary(self, df: DataFrame, table: str, overwrite: bool) -> ModStore:
        return self.write(df, table, "overwrite" if overwrite else "append")

    def summarize_positions(self, input_table="calls", output_table="positions", overwrite=True, **options) -> ModStore:
        return self._summary(summarize.positions(self.read(input_table), **options), output_table, overwrite)

    def summarize_windows(self, input_table="calls", output_table="windows", overwrite=True, **options) -> ModStore:
        return self._summary(summarize.windows(self.read(input_table), **options), output_table, overwrite)

    def summarize_regions(self, region_file: str | DataFrame, input_table="calls", output_table="regions", overwrite=True, **options) -> ModStore:
        annotation = ingest.read_regions(self.spark, region_file) if isinstance(region_file, str) else region_file
        return self._summary(summarize.regions(self.read(input_table), annotation, **options), output_table, overwrite)

    def summarize_reads(self, input_calls_table="calls", output_reads_table="reads", regions_table: str | DataFrame | None = None, **options) -> ModStore:
        annotation = ingest.read_filter_regions(self.spark, regions_table) if isinstance(regions_table, str) else regions_table
        return self.write(summarize.reads(self.read(input_calls_table), annotation, **options), output_reads_table)

    def calc_diff(self, cases, controls, call_type="positions", output_table=None, mod_type="mh", calc_type=None, overwrite=True) -> ModStore:
        table = output_table or f"mod_diff_{call_type}"
        if not overwrite and self.exists(table):
            raise ValueError(f"table {table!r} exists; set overwrite to replace it")
        return self.write(diff.calc_diff(self.read(call_type), cases, controls, mod_type, calc_type), table)

    def collapse_windows(self, table_name="collapsed_windows", source="mod_diff_windows", **options) -> ModStore:
        return self.write(collapse.collapse_windows(self.read(source), **options), table_name)

    def classify_reads(self, key_table: str | DataFrame, case: str, control: str, table_name="classified_reads", reads_table="reads", **options) -> ModStore:
        key = ingest.read_key_table(self.spark, key_table) if isinstance(key_table, str) else key_table
        return self.write(collapse.classify_reads(self.read(reads_table), key, case, control, **options), table_name)

    def trim_reads(self, by_frac=0.1, trim_start=False, trim_end=True, input_table="calls", output_table="calls_trimmed") -> ModStore:
        return self.write(call_ops.trim(self.read(input_table), by_frac, trim_start, trim_end), output_table)

    def filter_table(self, input_table: str, output_table: str, *conditions) -> ModStore:
        return self.write(call_ops.filter_rows(self.read(input_table), *conditions), output_table)

    def rename_samples(self, table: str, samples_map, strict=True, preview=True) -> ModStore:
        df = self.read(table)
        renamed = call_ops.rename_samples(df, samples_map, strict)
        if preview:
            print("before:", sorted(r[0] for r in df.select("sample_name").distinct().collect()), "after:", sorted(r[0] for r in renamed.select("sample_name").distinct().collect()))
        return self.write(renamed, table)

    def transform(self, table: str, expr: Callable[[DataFrame], DataFrame], output_table: str | None = None) -> DataFrame | ModStore:
        """The result of a user's function over a table, or, with an output table, the store that now has it."""
        made = self.read(table).transform(expr)
        return made if output_table is None else self.write(made, output_table)

    def sql(self, query: str) -> DataFrame:
        """A query of Spark's dialect with this store's database current; CREATE TABLE AS makes a table of the store."""
        before = self.spark.catalog.currentDatabase()
        self.spark.sql(f"USE {self.database}")
        try:
            return self.spark.sql(query)
        finally:
            self.spark.sql(f"USE {before}")

    def site_count(self, table_name: str = "calls", by_chrom: bool = False) -> int:
        return stats.site_count(self.read(table_name), by_chrom).first()[0]

    def sampled(self, table: str, max_rows: int | None = None, seed: int | None = None) -> DataFrame:
        df = self.read(table)
        return df if max_rows is None else call_ops.sample_rows(df, max_rows, seed, strict=True)

    def coverage(self, call_type="positions", max_rows=None) -> dict[str, DataFrame]:
        return qc.coverage(self.sampled(call_type, max_rows))

    def modfrac(self, call_type="positions", max_rows=None) -> dict[str, DataFrame]:
        return qc.modfrac(self.sampled(call_type, max_rows))

    def sample_correlation(self, call_type="positions", value="m_frac", agg_fun=F.avg, order=None, max_rows=None) -> DataFrame:
        return qc.sample_correlation(self.sampled(call_type, max_rows), call_type, value, agg_fun, order)

    def pca(self, call_type="positions", value="m_frac", max_rows=None) -> tuple[DataFrame, dict]:
        return qc.pca(self.sampled(call_type, max_rows), call_type, value)

    def volcano(self, table: str) -> DataFrame:
        return qc.volcano(self.read(table))

    def diff_density(self, table: str, thresh=(0.2, 0.3), n_kde: int = 250) -> tuple[DataFrame, dict]:
        return qc.diff_density(self.read(table), thresh, n_kde)


def write_csv(df: DataFrame, target: str) -> str:
    """One CSV file, differences by their adjusted p-value and merged windows by place; Spark writes a folder beside it, whose only part is then moved."""
    spark = df.sparkSession
    if "p_adjust" in df.columns:
        df = df.orderBy(F.asc_nulls_last("p_adjust"), *[c for c in diff.KEYS if c in df.columns])
    elif "num_windows" in df.columns:
        df = df.orderBy("chrom", "start")
    fs_of, path = ingest.files(spark)
    fs, staging = fs_of(target), f"{target}.staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(staging)
    part = next(s.getPath() for s in fs.listStatus(path(staging)) if s.getPath().getName().startswith("part-"))
    fs.delete(path(target), False)
    fs.rename(part, path(target))
    fs.delete(path(staging), True)
    return target
