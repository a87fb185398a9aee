"""File streams of call files: each batch is filtered like a load, and its position counts are added up.

A batch is aggregated on its own and written to a partition that its stream and number name, so a batch
that is tried again replaces itself. The table is the sum over these partitions; what it had before its
first stream is one of them. From then on the stream alone writes the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.codes import DEFAULT_SPECS, frac_columns, measures
from strandlake.operators import summarize
from strandlake.plans.store import ModStore
from strandlake.sources import ingest


def added(parts: DataFrame) -> DataFrame:
    """Rows of position tables with the same measures, summed by place."""
    labels = [c.removesuffix("_counts") for c in parts.columns if c.endswith("_counts")]
    sums = [F.sum(c).cast("long").alias(c) for c in ("num_calls", *[f"{x}_counts" for x in labels])]
    both = parts.groupBy("sample_name", "chrom", "start", "end").agg(*sums)
    return both.select("sample_name", "chrom", "start", "end", "num_calls", *[f"{x}_counts" for x in labels], *frac_columns(labels))


def merge_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two position tables with the same measures as one."""
    return added(old.select(*new.columns).unionByName(new))


def stream_calls(spark: SparkSession, folder: str, schema, **filters) -> DataFrame:
    """Filtered calls of a folder's call files as they arrive; the file names the sample."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"*{ingest.SUFFIX}").parquet(folder)
    name = F.regexp_replace(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"(?i)\.ch3$", ""), r"-[0-9]+$", "")
    return ingest.call_filter(raw.withColumn("sample_name", name), **filters)


def follow(store: ModStore, folder: str, schema, checkpoint: str, table: str = "positions", mod_code=DEFAULT_SPECS, **filters):
    """A query that merges the position counts of arriving files into ``table``; stop or await it as any other."""
    spark = store.spark
    measures(mod_code)

    parts, stream = f"{table}_batches", hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{store.path}/{parts}/batch={name}")

    def written() -> bool:
        """Whether any partition is whole; a write that broke off leaves no mark."""
        at = store._path
        return store.exists(parts) and any(store.fs.exists(at(f"{s.getPath()}/_SUCCESS")) for s in store.fs.listStatus(at(f"{store.path}/{parts}")))

    def merge(batch: DataFrame, number: int) -> None:
        if store.exists(table) and not written():
            put(store.read(table), "before")
        put(summarize.positions(batch, mod_code=mod_code), f"{stream}-{number}")
        store.write(added(store.read(parts).drop("batch")), table)

    return stream_calls(spark, folder, schema, **filters).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
