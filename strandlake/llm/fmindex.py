"""Benchmark decontamination with an FM-index per training shard.

Words are lower-cased runs of letters, digits and characters beyond ASCII. A phrase is a window of 13
consecutive words of a benchmark item, or the whole item if it is shorter. A shard is a slice of a
task's documents. Its words are numbered by the benchmark's vocabulary; runs of words none of whose
neighbouring pairs occurs in the benchmark can't hold a phrase and are left out, which loses no
occurrence. Over the rest stands an FM-index: Burrows-Wheeler transform, wavelet tree with ranks, and
suffix positions sampled every ``SAMPLE`` places. All phrases are searched backward at once; each
occurrence is located by steps back to a sampled position. A document's occurrences are merged into
removal spans.

The scan has no shuffle. The benchmark is counted first; beyond ``PHRASE_BYTES`` of text it is taken in
as many parts as keep each part within that bound. The rows are then written once with a key of their
own, by which the spans of the parts are merged; documents without an id, or of one id, stay apart.

Defined results: a null or empty text has no words, no hits and is not contaminated; a null or empty
item has no phrase; repeated items count each by its item_id; whole texts are searched.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_columns, materialize

WINDOW = 13
SAMPLE = 16
SHARD_DOCUMENTS = 2048
#: Text of the benchmark that one scan sends to the tasks, at most.
PHRASE_BYTES = 8 << 20
#: ASCII letters, small; digits; bytes beyond ASCII; all else is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Phrases:
    """The benchmark's vocabulary, its pairs of neighbouring words, and its distinct phrases by length."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, words in items:
            w = [self.ids.setdefault(x, len(self.ids) + 2) for x in words]  # 0 ends the text and 1 a run
            for at in range(max(1, len(w) - window + 1)) if w else ():
                owners.setdefault(tuple(w[at : at + window]), set()).add(item)
        self.sigma = len(self.ids) + 2
        self.owners = [sorted(v, key=str) for v in owners.values()]
        by_length: dict[int, list[int]] = {}
        for k, phrase in enumerate(owners):
            by_length.setdefault(len(phrase), []).append(k)
        listed = list(owners)
        self.groups = [(n, np.array(ks), np.array([listed[k] for k in ks])) for n, ks in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)
        pairs = [p[:, i] * self.sigma + p[:, i + 1] for _, _, p in self.groups for i in range(p.shape[1] - 1)]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def runs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that may lie in a phrase, each run ended by a 1 and all by a 0, and their places in w (0: unknown)."""
        n = len(w)
        linked = np.zeros(n + 1, bool)  # linked[i]: words i - 1 and i are neighbours in the benchmark
        if n > 1 and len(self.pairs):
            key = w[:-1] * self.sigma + w[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[1:n] = (self.pairs[at] == key) & (w[:-1] > 0) & (w[1:] > 0)
        inside = w > 0
        first = np.flatnonzero(inside & ~linked[:n])
        last = np.flatnonzero(inside & ~linked[1:])
        long = last - first + 1 >= self.shortest
        first, last = first[long], last[long]
        size = last - first + 2
        total = int(size.sum())
        places = np.arange(total) - np.repeat(np.cumsum(size) - size - first, size)
        ends = np.cumsum(size) - 1
        kept = np.ones(total, np.int64)
        body = np.ones(total, bool)
        body[ends] = False
        kept[body] = w[places[body]]
        return np.append(kept, 0), np.append(places, n)


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and each one's rank, by prefix doubling; of two suffixes the one that the other begins with comes first.

    With a depth, suffixes that agree in that many symbols or more may share a rank.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while rank[order[-1]] < n - 1 and (depth is None or step < depth):
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        step *= 2
    return order, rank


class WaveletTree:
    """A wavelet matrix: per level the bits of the sequence, and their running counts."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, (sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
            self.zeros.append(int(len(bit) - bit.sum()))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """Index a sequence that has a 0 at its end only, so that steps back are well defined."""
        sa, _ = suffix_array(text)
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.n = len(text)
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns of one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, column]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix ranks: steps back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            hit = live[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            live = live[~done]
            c = self.tree.access(rows[live])
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return out


def occurrences(shard: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, phrase) of all occurrences; places count the words of the joined documents, with a gap after each."""
    gap = np.zeros(1, np.int64)
    text, places = phrases.runs(np.concatenate([x for w in shard for x in (w, gap)]) if shard else gap)
    if len(text) == 1 or not phrases.groups:
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(text, phrases.sigma)
    found = []
    for length, names, patterns in phrases.groups:
        low, high = index.search(patterns)
        count = high - low
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        found.append((places[index.locate(rows)], np.full(len(rows), length), np.repeat(names, count)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(docs: DataFrame, items: list[tuple[object, bytes | None]], text: str, window: int) -> DataFrame:
    listed = [(i, words_of(t)) for i, t in items]

    def start():
        phrases = Phrases(listed, window)
        get = phrases.ids.get

        def work(columns):
            documents = [words_of(t) for t in columns[0]]
            shard = [np.fromiter((get(x, 0) for x in w), np.int64, len(w)) for w in documents]
            sizes = np.array([len(w) for w in shard], np.int64)
            place, length, phrase = occurrences(shard, phrases)
            first = np.cumsum(sizes + 1) - sizes - 1
            owner = np.searchsorted(first, place, side="right") - 1
            spans = [[] for _ in documents]
            names = [set() for _ in documents]
            for k in np.lexsort((place, owner)):
                d = owner[k]
                a = int(place[k] - first[d])
                b = a + int(length[k])
                if spans[d] and a <= spans[d][-1][1]:
                    spans[d][-1][1] = max(b, spans[d][-1][1])
                else:
                    spans[d].append([a, b])
                names[d].update(phrases.owners[phrase[k]])
            return [sizes.tolist(), spans, [sorted(map(str, x)) for x in names]]

        return work

    return append_columns(docs, [text], [("n_words", "bigint"), ("spans", "array<array<bigint>>"), ("items", "array<string>")], start, binary=True, rows=SHARD_DOCUMENTS)


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    """Sorted union of [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, removal ``spans`` in words, ``items``, ``n_hit``, ``n_items`` and ``contaminated``."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = -(-size // phrase_bytes) or 1
    fetch = lambda k: [(r[0], r[1].encode() if r[1] is not None else None) for r in benchmark.where(F.pmod(F.xxhash64(item), F.lit(parts)) == k).select(item, text).collect()]
    if parts == 1:
        found = _scan(docs, fetch(0), text, window)
    else:
        rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
        every = _scan(rows.select("_row", text), fetch(0), text, window).drop(text)
        for k in range(1, parts):
            every = every.unionByName(_scan(rows.select("_row", text), fetch(k), text, window).drop(text).where(F.size("spans") > 0))
        merged = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = append_columns(merged, ["spans"], [("spans", "array<array<bigint>>")], lambda: lambda columns: [[merge_spans(x) for x in columns[0]]]).select("_row", "n_words", "spans", "items")
        found = rows.drop("n_words", "spans", "items").join(merged, "_row").drop("_row")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    bounds = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join(out) + text[at:]


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``decontaminate`` with the spans cut out of the text; other rows are as they were."""

    def start():
        return lambda columns: [[None if t is None else (without_spans(t, s) if s else t).decode() for t, s in zip(*columns, strict=True)]]

    order = found.columns
    return append_columns(found, [text, "spans"], [(text, "string")], start, binary=True).select(*order)
