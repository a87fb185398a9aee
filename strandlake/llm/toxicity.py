"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words, word beginnings and word ends learns from confirmed toxic documents (P) and unlabelled ones (U),
with the class prior pi of the labelled training rows. It minimises the class-prior-corrected risk

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

and, where the second part turns negative, ascends it instead (the non-negative correction). Labels
other than "toxic" are never read. The classifier is fitted on a bounded sample (``Limits``), in the
order of a hash of doc_id; the prior is counted over all labelled training rows, and all rows are scored.

Defined results: a null or empty text has no features and gets the score of the bias; repeated label
rows of one document count once, toxic if any says so; null labels are ignored; without toxic training
rows, or without any training rows, all scores are the prior (0.5 without rows); whole texts are used.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_columns

#: Punctuation ends a word; ASCII capitals become small letters.
FOLD = bytes(32 if chr(b) in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~" or b < 32 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words whose slots a task keeps at most.
WORDS_KEPT = 300_000


@dataclass(frozen=True)
class Limits:
    """The bounds of the training sample: documents that are confirmed toxic, and unlabelled ones."""

    positive: int = 4_000
    unlabelled: int = 8_000
    bits: int = 18
    min_documents: int = 8
    steps: int = 300
    #: Only words whose share differs that many standard errors between the two samples get a weight.
    min_z: float = 5.0


def held_out(doc_id: Column, remainder: int, modulus: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % modulus == remainder


def word_slots(word: bytes, bits: int) -> tuple[int, ...]:
    """Slots of the word, of its beginnings of four to six bytes, and of its last five."""
    parts = [b"=" + word]
    if len(word) > 5:
        parts += [b"^" + word[:4], b"^" + word[:5], b"^" + word[:6], b"$" + word[-5:]]
    return tuple(zlib.crc32(p) >> (32 - bits) for p in parts)


class Slots:
    """The slots of texts, or the wanted ones of them; those of a bounded number of words are kept."""

    def __init__(self, bits: int, wanted: np.ndarray | None = None):
        self.bits = bits
        self.wanted = None if wanted is None else set(np.flatnonzero(wanted).tolist())
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = set((text or b"").translate(FOLD).split())
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for w in [w for w in words if w not in self.known]:
            slots = word_slots(w, self.bits)
            self.known[w] = slots if self.wanted is None else tuple(x for x in slots if x in self.wanted)
        found = set().union(*filter(None, map(self.known.__getitem__, words)))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, limits: Limits) -> tuple[np.ndarray, float]:
    """Weights of the hashed words, and the bias."""
    size = 1 << limits.bits
    if not positive or not unlabelled:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return np.zeros(size, np.float32), float(np.log(p / (1 - p)))
    rows = positive + unlabelled
    flat = np.concatenate(rows)
    n_p, n_u = len(positive), len(unlabelled)
    split = sum(map(len, positive))
    seen_p, seen_u = np.bincount(flat[:split], minlength=size), np.bincount(flat[split:], minlength=size)
    pooled = (seen_p + seen_u) / (n_p + n_u)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n_p + 1 / n_u))
    z = (seen_p / n_p - seen_u / n_u) / spread
    known = np.flatnonzero((seen_p + seen_u >= limits.min_documents) & (np.abs(z) >= limits.min_z))
    where = np.full(size, -1, np.int32)
    where[known] = np.arange(len(known))
    column = where[flat]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[column >= 0]
    column = column[column >= 0]
    del rows, flat
    w, bias = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, limits.steps + 1):
        g = np.bincount(owner, w[column], n_p + n_u) + bias
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # l(-g) has the slope s, l(g) the slope s - 1
        negative = np.logaddexp(0, g[n_p:]).mean() - prior * np.logaddexp(0, g[:n_p]).mean()
        slope_p, slope_u = -prior * s[:n_p] / n_p, s[n_p:] / n_u
        slope = np.concatenate([prior * (s[:n_p] - 1) / n_p + slope_p, slope_u]) if negative >= 0 else np.concatenate([-slope_p, -slope_u])
        dw = np.bincount(column, slope[owner], len(w)) + 3e-5 * w
        db = slope.sum()
        m, v = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw
        mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        rate = 0.05 * (0.5 + 0.5 * np.cos(np.pi * step / limits.steps))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), remainder: int = 0) -> tuple[np.ndarray, float]:
    """Fit on documents and labels whose ids are not held out."""
    confirmed = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), remainder)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = confirmed.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    order = F.xxhash64("doc_id")
    sample = confirmed.where("toxic = 1").select("doc_id", F.lit(1).alias("is_p")).orderBy(order, "doc_id").limit(limits.positive)
    rest = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), remainder)).select("doc_id", F.lit(0).alias("is_p")).orderBy(order, "doc_id").limit(limits.unlabelled)
    # both sides of the union are bounded by the limits, so the broadcast is too
    chosen = F.broadcast(sample.unionByName(rest))
    bits = limits.bits

    def start():
        slots = Slots(bits)
        return lambda columns: [[slots(t).tobytes() for t in columns[0]]]

    rows = append_columns(
        docs.join(chosen, "doc_id").select("text", "is_p"), ["text"], [("slots", "binary")], start, keep=["is_p"], binary=True
    ).collect()
    parts = [[np.frombuffer(bytes(r.slots), np.int32) for r in rows if r.is_p == p] for p in (1, 0)]
    return fit(*parts, prior=min(max(toxic / total, 1e-3), 1 - 1e-3) if total else 0.5, limits=limits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the model's probability that the text is toxic."""
    weights, bias = model
    bits = limits.bits

    def start():
        slots = Slots(bits, weights != 0)

        def work(columns):
            g = [min(max(float(weights[slots(t)].sum(dtype=np.float64)) + bias, -30.0), 30.0) for t in columns[0]]
            return [[float(1 / (1 + np.exp(-x))) for x in g]]

        return work

    return append_columns(docs, [text], [("score", "double")], start, binary=True)
