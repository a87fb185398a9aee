"""The mini-language of modification codes: "m", "h", "m + h", numeric codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SPECS = ("m", "h", "m + h")


@dataclass(frozen=True)
class ModSpec:
    """One measure: calls whose code is one of ``codes`` count; ``label`` names its columns."""

    label: str
    codes: tuple[str, ...]

    @staticmethod
    def parse(spec: str) -> ModSpec:
        codes = tuple(p for p in "".join(spec.split()).split("+") if p)
        if not codes:
            raise ValueError(f"empty modification code: {spec!r}")
        return ModSpec(safe_label("".join(codes)), codes)


def safe_label(label: str) -> str:
    return f"m_{label}" if label.isascii() and label.isdigit() else label


def measures(mod_code=DEFAULT_SPECS, unmod_code: str = "-", unmod_label: str = "c") -> list[ModSpec]:
    """The unmodified measure, then one per spec; two measures of one label are an error."""
    specs = [mod_code] if isinstance(mod_code, str) else list(mod_code)
    found = [ModSpec(safe_label(unmod_label), (unmod_code,)), *map(ModSpec.parse, specs)]
    labels = [m.label for m in found]
    if len(set(labels)) != len(labels):
        raise ValueError(f"labels repeat: {labels}")
    return found


def count_columns(specs: list[ModSpec]) -> list[Column]:
    return [F.sum(F.when(F.col("call_code").isin(*m.codes), 1).otherwise(0)).cast("long").alias(f"{m.label}_counts") for m in specs]


def sum_columns(labels: list[str]) -> list[Column]:
    return [F.coalesce(F.sum(f"{x}_counts"), F.lit(0)).cast("long").alias(f"{x}_counts") for x in labels]


def frac_columns(labels: list[str], calls: str = "num_calls") -> list[Column]:
    return [F.try_divide(F.col(f"{x}_counts").cast("double"), F.nullif(F.col(calls), F.lit(0)).cast("double")).alias(f"{x}_frac") for x in labels]
