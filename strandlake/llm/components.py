"""Connected components of an edge table, without a driver-side graph.

Up to ``ONE_TASK`` edges, which are counted first, are united by one task; more by alternating large and
small stars until nothing changes. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import materialize

#: Edges that one task unites; 16 bytes each.
ONE_TASK = 2_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the smallest of its neighbours and itself."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = edges.unionByName(flipped) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) by repeated minima over all edges, in one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)]), return_inverse=True)
    u, v = np.split(ends, 2)
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[u], least[v])
        new = least.copy()
        for at in (least[u], least[v], u, v):
            np.minimum.at(new, at, low)
        while (shorter := new[new] < new).any():
            new[shorter] = new[new[shorter]]
        if (new == least).all():
            break
        least = new
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[least[k : k + (1 << 16)]])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) edges to (node, component), the component being its smallest node; nodes without an edge are left out.

    Nulls and self-loops are ignored, repeated edges count once; an empty table gives an empty table.
    """
    edges = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")))
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_united, "node bigint, component bigint")
    seen = None
    while True:
        edges = materialize(_stars(_stars(edges, large=True), large=False))
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.xxhash64("v", "u") % 1000003).cast("long"))).first()
        if sign == seen:
            break
        seen = sign
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
