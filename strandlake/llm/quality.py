"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated three-word windows. The fertility rule
then encodes the whole text by two public vocabularies and measures characters per token (byte-level
BPE), byte-fallback share and token entropy (piece BPE). A document is kept if no base rule fails and
each measure lies in the band of its language, or of the script of most of its letters if the
language has no band.

Defined results: a null or empty text has no words and fails; repeated rows get equal results; a text
is measured whole, however long, and with runs of white space of any length; a document exactly on a
bound is kept; an empty table gives an empty table; columns of the input stay, except those named as an
output, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.bpe import MergeReplay, Splitter, Vocabulary, read_ranks
from strandlake.llm.common import append_columns

# Rejection bands. Per language or script: least and most characters per token, most
# byte-fallback share, least token entropy in bits. The least characters per token hold for a text of
# unbounded length; a text of n tokens may lie SLACK / sqrt(n) lower, as short texts scatter more.
BANDS = {
    "en": (2.50, 6.5, 0.15, 2.5),
    "de": (2.54, 6.5, 0.15, 2.5),
    "fr": (2.35, 6.5, 0.15, 2.5),
    "es": (2.35, 6.5, 0.15, 2.5),
    "Latin": (1.60, 7.0, 0.25, 2.5),
    "Cyrillic": (1.20, 6.5, 0.25, 2.5),
    "Greek": (0.90, 6.5, 0.60, 2.5),
    "Arabic": (0.90, 6.5, 0.60, 2.5),
    "Hebrew": (0.80, 6.5, 0.60, 2.5),
    "Devanagari": (0.60, 6.5, 0.80, 2.5),
    "CJK": (0.40, 4.0, 0.80, 2.5),
    "other": (0.30, 8.0, 0.95, 2.0),
}
SLACK = 1.2
#: White space beyond that of single spaces from which on a text may have a run that the library's splitter can't take.
LONG_SPACE = 4_000
#: Fewest words, and most words in repeated windows, in hundredths.
MIN_WORDS, MAX_REPEATED = 50, 50

# The letters of scripts.
SCRIPTS = {
    "Latin": "A-Za-zÀ-ÖØ-öø-ɏ",
    "Cyrillic": "Ѐ-ӿ",
    "Greek": "Ͱ-Ͽ",
    "Arabic": "؀-ۿ",
    "Hebrew": "֐-׿",
    "Devanagari": "ऀ-ॿ",
    "CJK": "぀-ヿ㐀-䶿一-鿿가-힯",
}
SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
FIELDS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("chars_per_token", "double"), ("chars_per_piece", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("band", "string"),
]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(words), bool)
    again = count[where] > 1
    for k in range(3):
        inside[k : len(again) + k] |= again
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    stripped = text.translate(None, SPACES)
    chars = len(stripped) if stripped.isascii() else len(stripped.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = Counter(line for line in text.split(b"\n") if line.translate(None, SPACES))
    return len(words), chars, symbols, sum(n - 1 for n in lines.values()), repeated_words(words)


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum())


def main_script(text: str) -> str:
    counts = {name: len(re.findall(f"[{letters}]", text)) for name, letters in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def quality(docs: DataFrame, ranks_path: str, pieces_path: str, pattern: str, text: str = "text", lang: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """``docs`` with the base counts, the fertility measures, ``base_failed`` and ``kept``."""
    bands, vocabulary = bands or BANDS, Vocabulary(read_ranks(ranks_path))
    with open(pieces_path, "rb") as model:
        pieces = model.read()
    inputs = [text] + ([lang] if lang and lang in docs.columns and lang != text else [])

    def start():
        import sentencepiece
        import tiktoken

        bpe = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
        split, replay = Splitter(pattern), MergeReplay(vocabulary)

        def token_count(t: str, spaced: bool) -> int:
            if not spaced:
                return len(bpe.encode_ordinary(t))
            pieces = split(t)
            replay.learn(set(pieces))
            return sum(len(replay.ids[p]) for p in pieces) // 4

        piece = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spelt = np.array([piece.is_byte(i) for i in range(piece.vocab_size())])

        def work(columns):
            raw = [t or b"" for t in columns[0]]
            langs = columns[1] if len(columns) > 1 else [None] * len(raw)
            rows = []
            for b, language in zip(raw, langs, strict=True):
                words, chars, symbols, dup, repeat = base_counts(b)
                failed = words < MIN_WORDS or 100 * repeat > MAX_REPEATED * words
                t = b.decode()
                n = token_count(t, len(t) - chars - words > LONG_SPACE)
                ids = np.asarray(piece.encode(t), np.int64)
                language = (language or b"").decode()
                band = language if language in bands else main_script(t)
                per_token, per_piece = len(t) / max(1, n), len(t) / max(1, len(ids))
                share = float(spelt[ids].mean()) if len(ids) else 0.0
                bits = entropy(ids)
                least, most, most_bytes, least_bits = bands[band]
                good = least - SLACK / max(1, n) ** 0.5 <= per_token <= most and share <= most_bytes and bits >= least_bits
                rows.append((words, chars, symbols, dup, repeat, failed, not failed and good, per_token, per_piece, share, bits, band))
            return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in FIELDS]

        return work

    return append_columns(docs, inputs, FIELDS, start, binary=True)
