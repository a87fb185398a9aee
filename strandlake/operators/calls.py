"""Row-level operators: trimming, filtering, renaming, sampling."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.schema import require


def trim(calls: DataFrame, by_frac: float | str = 0.1, trim_start: bool = False, trim_end: bool = True) -> DataFrame:
    """Drop calls within a fraction of the read's ends; the arithmetic is decimal."""
    f = Decimal(str(by_frac))
    if not 0 < f < 1:
        raise ValueError("by_frac must be between 0 and 1")
    if not trim_start and not trim_end:
        raise ValueError("nothing to trim: both ends are off")
    require(calls, "read_position", "read_length")
    length = F.col("read_length").cast("decimal(19,0)")
    if trim_start:
        calls = calls.where(F.col("read_position").cast("decimal(19,0)") >= length * F.lit(f))
    if trim_end:
        calls = calls.where(F.col("read_position").cast("decimal(19,0)") < length * F.lit(1 - f))
    return calls


def filter_rows(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """All conditions must hold; a condition that can't be resolved is an error that names it."""
    for c in conditions:
        try:
            df = df.where(F.expr(c) if isinstance(c, str) else c)
        except Exception as error:
            raise ValueError(f"filter can't be applied: {c}: {error}") from error
    return df


def clean_samples_map(samples_map: Mapping[str, str] | Iterable[tuple[str, str]], existing: set[str], strict: bool = True) -> dict[str, str]:
    """The valid part of an old-to-new map; what isn't valid is an error, or else a warning."""
    pairs = list(samples_map.items()) if isinstance(samples_map, Mapping) else [tuple(p) for p in samples_map]

    def bad(message: str) -> None:
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=3)

    if empty := [p for p in pairs if not p[0] or not p[1]]:
        bad(f"{len(empty)} mappings with an empty name")
        pairs = [p for p in pairs if p[0] and p[1]]
    found: dict[str, str] = {}
    for old, new in dict.fromkeys(pairs):
        if old in found:
            bad(f"several new names for {old}")
        else:
            found[old] = new
    if len(set(found.values())) < len(found):
        warnings.warn("several old names get one new name; their samples are merged", stacklevel=2)
    if missing := sorted(set(found) - existing):
        bad(f"no such sample: {', '.join(missing)}")
        found = {o: n for o, n in found.items() if o in existing}
    return found


def rename_samples(df: DataFrame, samples_map: Mapping[str, str] | Iterable[tuple[str, str]], strict: bool = True) -> DataFrame:
    """All names change at once, so names can be swapped."""
    require(df, "sample_name")
    existing = {r[0] for r in df.select("sample_name").distinct().collect()}
    names = clean_samples_map(samples_map, existing, strict)
    if not names:
        return df
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("sample_name", F.coalesce(F.try_element_at(lookup, F.col("sample_name")), "sample_name")).select(*df.columns)


def sample_rows(df: DataFrame, rows: int, seed: int | None = None, strict: bool = False) -> DataFrame:
    """That many random rows; strict: an error if there are fewer."""
    if strict and df.limit(rows).count() < rows:
        raise ValueError(f"the table has fewer than {rows} rows")
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(rows)
