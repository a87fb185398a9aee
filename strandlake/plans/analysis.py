"""Chained analyses over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.store import ModStore, write_csv


def significant(summary: DataFrame, diff: DataFrame, p_val_max: float = 0.05) -> DataFrame:
    """Summary rows once per difference row of equal coordinates whose raw p-value is small enough."""
    at = ["chrom", "start", "end"]
    keys = diff.where(F.col("p_val") <= p_val_max).select(*at)
    return summary.join(keys, at).select(*summary.columns)


def run_analysis(store: ModStore, out_path: str, cases, controls, call_type: str = "positions", region_file=None, window_size: int = 1000, step_size: int = 10, mod_type: str = "mh", calc_type: str = "fast_fisher", p_val_max: float = 0.05) -> dict[str, str]:
    """Summarize, test, and write the differences, the summary and its significant part as CSV files."""
    if call_type == "positions":
        store.summarize_positions()
    elif call_type == "windows":
        store.summarize_windows(window_size=window_size, step_size=step_size)
    elif call_type == "regions":
        if region_file is None:
            raise ValueError("regions need a region_file")
        store.summarize_regions(region_file)
    else:
        raise ValueError(f"unknown call_type {call_type!r}")
    table = f"mod_diff_{call_type}"
    store.calc_diff(cases, controls, call_type, mod_type=mod_type, calc_type=calc_type)
    # The names of the folder and the files.
    folder = f"{out_path.rstrip('/')}/Mod_Diff_Analysis_Results"
    if call_type == "windows":
        chosen = store.collapse_windows().read("collapsed_windows")
    else:
        chosen = significant(store.read(call_type), store.read(table), p_val_max)
    return {
        "diff": write_csv(store.read(table), f"{folder}/mod_diff.csv"),
        "all": write_csv(store.read(call_type), f"{folder}/All_CpGs.csv"),
        "significant": write_csv(chosen, f"{folder}/Sig_CpGs.csv"),
    }


def run_qc(store: ModStore, call_type: str = "positions", max_rows: int | None = None, value: str = "m_frac") -> dict:
    """Coverage, fractions, correlation and principal components; calls are summarized by position first."""
    if call_type == "calls":
        store.summarize_positions()
        call_type = "positions"
    scores, meta = store.pca(call_type, value, max_rows)
    return {
        "coverage": store.coverage(call_type, max_rows), "modfrac": store.modfrac(call_type, max_rows),
        "correlation": store.sample_correlation(call_type, value, max_rows=max_rows), "pca": scores, "pca_meta": meta,
    }
