"""Byte-level BPE by corpus-level merge replay, and its inverse.

The documents of a slice are one small corpus. Its distinct pieces (matches of the split pattern) are
laid out as one array of byte tokens. An inverted index leads from each mergeable token pair to the
positions where it stands; merges are applied in rank order, each at all its positions, and only the
two neighbours of a merged pair are looked up again. The pieces' ids are kept in a dictionary of
bounded size, so that a piece is replayed once per task in the usual case.

Defined results: a null text is the empty text, which has no tokens; repeated rows are encoded alike;
no text is cut; all columns of the input are kept, and a column with the name of an output is replaced.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.common import append_columns

#: Documents whose pieces are replayed together.
SLICE = 1024
#: Pieces whose ids a task keeps at most.
PIECES_KEPT = 100_000
#: Pieces that are replayed at once, at most.
REPLAYED = 32_768
#: \s of the split pattern is the property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Splitter:
    """Pieces of a text by the split pattern, whose white space is spelt out as the property White_Space."""

    def __init__(self, pattern: str):
        import regex

        w = WHITE_SPACE
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{w}").replace(r"\s+(?!\S)", f"[{w}]+(?![^{w}])").replace(r"\s+", f"[{w}]+")).findall

    def __call__(self, text: str) -> list[str]:
        return self.find(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token; the file is read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Layout:
    """All pieces of a replay as one chain of tokens, and the inverted index from pairs to places.

    A pair is known by the rank of the token that it makes; ``pair[i]`` is that of the pair that starts
    at place i, or -1. Places are bytes of the joined pieces; those merged away have no token.
    """

    def __init__(self, pieces: list[bytes], byte_ids: np.ndarray, ranks_of):
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, ends = int(length.sum()), np.cumsum(length)
        self.starts, self.ranks_of = ends - length, ranks_of
        self.symbol = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.after[ends - 1] = self.before[self.starts] = -1
        self.pair = np.full(n, -1)
        self.index: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.look_up(np.flatnonzero(self.after >= 0))

    def look_up(self, places: np.ndarray) -> None:
        """Find the pairs that start at these places anew, and index them."""
        ranks = self.ranks_of(self.symbol[places] << 20 | self.symbol[self.after[places]])
        self.pair[places] = ranks
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else []
        bounds = [*first, len(ranks)]
        for k, at in enumerate(first):
            rank = int(ranks[at])
            if rank not in self.index:
                self.index[rank] = []
                heappush(self.heap, rank)
            self.index[rank].append(places[at : bounds[k + 1]])

    def merge(self, rank: int, at: np.ndarray) -> None:
        """Merge the pairs that start at these places, none of which overlap."""
        gone = self.after[at]
        right = self.after[gone]
        self.symbol[at], self.symbol[gone], self.after[at] = rank, -1, right
        self.pair[at] = self.pair[gone] = -1
        has = right >= 0
        self.before[right[has]] = at[has]
        left = self.before[at]
        self.look_up(np.unique(np.concatenate([at[has], left[left >= 0]])))

    def in_turn(self, rank: int, at: np.ndarray) -> bool:
        """Whether the order of these merges matters: they overlap, or make a pair that comes before them."""
        gone = self.after[at]
        if (gone[:-1] == at[1:]).any():
            return True
        right, left = self.after[gone], self.before[at]
        right, left = right[right >= 0], left[left >= 0]
        ranks = self.ranks_of(np.concatenate([rank << 20 | self.symbol[right], self.symbol[left] << 20 | rank]))
        return bool(((ranks >= 0) & (ranks < rank)).any())

    def run(self) -> list[list[int]]:
        while self.heap:
            rank = heappop(self.heap)
            parts = self.index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[self.pair[at] == rank]
            if not len(at):
                continue
            if not self.in_turn(rank, at):
                self.merge(rank, at)
                continue
            for k in range(len(at)):
                if self.pair[at[k]] == rank:
                    self.merge(rank, at[k : k + 1])
                    if self.heap and self.heap[0] < rank:  # a new pair that comes first: the other places wait
                        if rank not in self.index:
                            self.index[rank] = []
                            heappush(self.heap, rank)
                        self.index[rank].append(at[k + 1 :])
                        break
        left = np.flatnonzero(self.symbol >= 0)
        return np.split(self.symbol[left], np.searchsorted(left, self.starts[1:]))


class Vocabulary:
    """The tokens of a rank file, and all pairs of tokens that make one, as sorted arrays that tasks share by value."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        #: A pair's key is its first id * 2**20 + the second; the last key ends the table.
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int32)[order], -1)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that the pairs make, or -1."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.made[at], -1).astype(np.int64)


class MergeReplay:
    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.byte, self.ranks_of = vocabulary.ranks, vocabulary.byte, vocabulary.ranks_of
        self.ids: dict[str, bytes] = {}

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, after all merges in rank order over all pieces at once."""
        return Layout(pieces, self.byte, self.ranks_of).run() if pieces else []

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > PIECES_KEPT:
            self.ids = {p: self.ids[p] for p in pieces if p in self.ids}
        whole, parts = [], []
        for p in new:
            b = p.encode()
            rank = self.ranks.get(b)
            if rank is None:
                whole.append(p)
                parts.append(b)
            else:
                self.ids[p] = rank.to_bytes(4, "little")
        for at in range(0, len(parts), REPLAYED):
            for p, ids in zip(whole[at : at + REPLAYED], self.replay(parts[at : at + REPLAYED]), strict=True):
                self.ids[p] = ids.astype("<u4").tobytes()


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.token = {rank: token for token, rank in vocabulary.ranks.items()}

    def __call__(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _whole(text: str | None) -> str:
    return text or ""


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids``, the ids packed as little-endian unsigned 32-bit integers."""

    def start():
        split, bpe = Splitter(pattern), MergeReplay(vocabulary)

        def work(columns):
            pieces = [split(_whole(t)) for t in columns[0]]
            bpe.learn(set().union(*pieces))
            ids = [b"".join(map(bpe.ids.__getitem__, p)) for p in pieces]
            return [[len(x) // 4 for x in ids], ids]

        return work

    return append_columns(docs, [text], [("n_tokens", "bigint"), ("token_ids", "binary")], start, rows=SLICE)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its packed ids stand for; null ids give no bytes."""

    def start():
        back = Decoder(vocabulary)
        return lambda columns: [[back(x or b"") for x in columns[0]]]

    return append_columns(encoded, [ids], [("decoded", "binary")], start)
