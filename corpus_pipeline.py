"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; n_chars follows a
changed text. Rows with a null doc_id pass the stages that need an id unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, fmindex, lines, ngram_join, quality
from strandlake.llm.common import materialize, read
from strandlake.llm.queries import BYTE_BPE, PIECES

#: Words of a shingle and similarity in hundredths of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _documents(found: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.length("text").cast(found.schema["n_chars"].dataType))
    return found.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a fertility band rejects go.

    Null and empty texts have no words and go; repeated rows are judged alike; a null lang or source is
    no fault; ties with a bound stay; an empty table stays empty.
    """
    vocabulary, pieces = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)
    judged = quality.quality(docs, vocabulary, pieces, public_tokenizers.PATTERN)
    return judged.where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated templates go from all but their first document; documents left without a word go.

    Null texts and rows with a null doc_id stay as they are; repeated rows of one id are treated alike; of
    documents that share a line the one with the smallest id keeps it; an empty table stays empty.
    """
    found = lines.line_dedup(docs).where(r"n_dropped = 0 OR text RLIKE '[^ \\t-\\r]'")
    return _documents(found, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one of the smallest doc_id in it.

    Rows of one id are one group if their texts are linked, and stay apart if not. Of linked rows with the same
    smallest id, the one with the smallest hash of its text stays. Null and empty texts are linked with
    nothing, so only repeated rows of one id with such a text go; rows with a null doc_id stay; an empty
    table stays empty.
    """
    return ngram_join.distinct_documents(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, spans that occur in the benchmark are cut out.

    Null and empty texts stay; rows without an id, and repeated rows, are treated each by its own text; a
    document with exactly a twentieth of its words hit goes; an empty table, of either kind, changes nothing.
    """
    found = fmindex.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _documents(fmindex.remove_spans(found.where("NOT contaminated")), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their packed token ids, their number, and whether decoding gives the text back.

    A null text is the empty text, which has no ids; repeated rows get equal ids; an empty table stays empty.
    """
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(BYTE_BPE)))
    decoded = bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return decoded.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Vocabularies and near-duplicate groups can't be expressed in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
