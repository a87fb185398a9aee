"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.sources.folders import new_folder, remove_at_exit

#: Rows that a Python worker turns into Python objects at once.
SLICE_ROWS = 256
#: Byte limit of one Arrow batch between the JVM and a Python worker, and about that of a slice of it.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too, so very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def frugal() -> None:
    """Let Arrow take memory where ``give_back`` can return it to the system."""
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return a finished task's memory to the system; Python workers are used again for other tasks."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fit = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, fit):
            yield batch.slice(start, fit)


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, str]],
    start: Callable[[], Callable[[list[list]], list[list]]],
    keep: list[str] | None = None,
    binary: bool = False,
    rows: int = SLICE_ROWS,
    arrow: bool = False,
) -> DataFrame:
    """``df`` (its ``keep`` columns, all by default) with the columns that a Python function computes.

    ``start()`` runs once per task and returns the function from lists of input values (strings, or
    their UTF-8 bytes if ``binary``, or Arrow arrays if ``arrow``) to lists, or arrays, of output values. A
    column of the same name is replaced.
    """
    bounded_batches(df.sparkSession)
    names = [n for n, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    sent = kept + [c for c in inputs if c not in kept]
    made = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([df.schema[c] for c in kept] + list(made.fields))
    types = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        work = start()
        for part in sliced(batches, rows):
            columns = [part.column(part.schema.get_field_index(c)) for c in inputs]
            out = work(columns if arrow else [as_bytes(c) if binary else c.to_pylist() for c in columns])
            arrays = [part.column(i) for i in range(len(kept))] + [v.cast(types.field(i).type) if isinstance(v, pa.Array) else pa.array(v, type=types.field(i).type) for i, v in enumerate(out)]
            out = columns = None
            yield pa.RecordBatch.from_arrays(arrays, names=kept + names)
        work = None
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is done; it does so when the driver's JVM has collected the plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder of ``spark.checkpoint.dir`` and read again; removed when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path, compression=compression)
    remove_at_exit(spark, path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` has written and nothing reads again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
