"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count and its leading tokens; tokens with digits are variable
fields and stand as <*>. At the leaf it belongs to the template of its whole masked line and, if it is
long enough, to one template per quarter in which that quarter is a variable field: lines of one leaf
that differ within one quarter only share that template. A template that recurs in enough documents
is a repeated one. Its lines are dropped from all documents but the first (the smallest doc_id that
has it), so that one copy of a repeated passage stays in the corpus.

Templates are counted by a grouped sum over hashes of 64 bits, with partial sums before the shuffle;
no task holds a template's lines. Documents that occur in whole copies count like any others.

Defined results: a null text stays null and has no lines; lines without a token are kept; repeated rows
of one doc_id count once and are all treated alike; a null doc_id takes no part; the other columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_columns

VARIABLE = re.compile(rb"[^ \t\v\f\r]*[0-9][^ \t\v\f\r]*")
DIGITS = b"0123456789"


@dataclass(frozen=True)
class Tree:
    #: Leading tokens that lead to a leaf.
    depth: int = 3
    #: Quarters of a line may be variable from that many tokens on.
    quarters_from: int = 12
    #: Least token count, and the documents from which on a template of that many tokens is repeated.
    repeated: tuple[tuple[int, int], ...] = ((20, 2), (8, 3), (4, 6))

    def documents(self, tokens: int) -> int:
        """Documents from which on a template is repeated; 0: never."""
        return next((n for least, n in self.repeated if tokens >= least), 0)


def keys_of(line: bytes, tree: Tree) -> list[int]:
    """Signed hashes of the templates of a line; the low four bits tell how many documents repeat it."""
    from xxhash import xxh3_64_intdigest as digest

    if line.translate(None, DIGITS) != line:
        line = VARIABLE.sub(b"<*>", line)
    tokens = line.split()
    n = len(tokens)
    least = tree.documents(n)
    if not least:
        return []
    leaf = b"%d " % n + b" ".join(tokens[: tree.depth])
    found = [leaf + b"\0" + b" ".join(tokens)]
    if n >= tree.quarters_from:
        bounds = [n * q // 4 for q in range(5)]
        for q in range(4):
            kept = tokens[: bounds[q]] + [b"<*>"] + tokens[bounds[q + 1] :]
            found.append(leaf + b"\1%d " % q + b" ".join(kept))
    keys = [digest(x) & ~15 | min(least, 15) for x in found]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def templates(docs: DataFrame, tree: Tree = Tree(), text: str = "text") -> DataFrame:
    """(doc_id, keys): the distinct template keys of each document's lines."""

    def start():
        def work(columns):
            out = []
            for t in columns[0]:
                lines = dict.fromkeys((t or b"").split(b"\n"))
                out.append(list({k for line in lines for k in keys_of(line, tree)}))
            return [out]

        return work

    return append_columns(docs.where(F.col("doc_id").isNotNull()), [text], [("keys", "array<bigint>")], start, keep=["doc_id"], binary=True)


def repeated(docs: DataFrame, tree: Tree = Tree(), text: str = "text") -> DataFrame:
    """(doc_id, drop): the keys of repeated templates in each document that isn't the first with them."""
    rows = templates(docs, tree, text).select("doc_id", F.explode("keys").alias("key"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    often = counted.where("n >= (key & 15) AND first < last").select("key", "first")
    return rows.join(often, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def line_dedup(docs: DataFrame, tree: Tree = Tree(), text: str = "text") -> DataFrame:
    """``docs`` with the text's remaining lines, ``n_lines`` and ``n_dropped``."""
    marked = docs.join(repeated(docs, tree, text).withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("drop", "_drop"), F.col("doc_id") == F.col("_doc_id"), "left").drop("_doc_id")

    def start():
        def work(columns):
            texts, counts, dropped = [], [], []
            for t, drop in zip(*columns, strict=True):
                lines = t.split(b"\n") if t is not None else []
                gone = set(drop or ())
                kept = [x for x in lines if gone.isdisjoint(keys_of(x, tree))] if gone else lines
                texts.append(t if t is None or len(kept) == len(lines) else b"\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            return [[None if x is None else x.decode() for x in texts], counts, dropped]

        return work

    fields = [(text, "string"), ("n_lines", "bigint"), ("n_dropped", "bigint")]
    return append_columns(marked, [text, "_drop"], fields, start, keep=[c for c in docs.columns if c != text], binary=True)
