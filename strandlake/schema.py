"""Fixed schemas and the default chromosome list."""

from __future__ import annotations

from pyspark.sql import types as T

MODKIT = "read_id string, chrom string, forward_read_position bigint, ref_position bigint, ref_mod_strand string, read_length bigint, query_kmer string, call_prob double, call_code string, base_qual int, flag int"
CALL_COLUMNS = ["sample_name", "read_id", "chrom", "start", "end", "read_position", "query_kmer", "call_code", "read_length", "call_prob", "base_qual", "flag"]
REGION_COLUMNS = ["chrom", "start", "end", "region_name"]
KEY_COLUMNS = ["chrom", "start", "end", "avg_mh_frac_control", "avg_mh_frac_case", "avg_meth_diff"]

_NUMBERS = [str(i) for i in range(1, 23)]
# The default chromosomes.
#: Bare numbers, and numbers, X, Y and M with either prefix. Bare X, Y, M and contigs aren't in it.
DEFAULT_CHROMS = _NUMBERS + [f"{prefix}{c}" for prefix in ("chr", "Chr") for c in (*_NUMBERS, "X", "Y", "M")]


def modkit_schema() -> T.StructType:
    return T._parse_datatype_string(MODKIT)


def require(df, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
