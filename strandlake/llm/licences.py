"""Licence scans by sentence rules.

A text is cut into pieces at sentence marks and line ends, after comment prefixes. Consecutive pieces
of a paragraph that make up a known licence sentence when normalised are recognised as it (the longest
one from each piece), so notices may be wrapped, commented out or punctuated in any way. The identifiers found, in order of appearance, are matched against ordered rules; a rule whose sequence of
identifiers occurs (with up to ``GAP`` other recognised sentences in between) names a licence and
consumes its sentences. Other pieces that speak of a licence are counted as unknown.

Defined results: a null or empty text has no licence; ties go to the earlier rule; repeated sentences
are separate matches; whole texts are read, and texts without a trigger word are passed over; other
columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from strandlake.llm.common import append_columns

GAP = 2

# Known sentences of public licences, normalised (lower case, single spaces, no
# punctuation but dots within words); # stands for a version number.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense andor sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version #": "apache-ref",
    "licensed under the apache license version # the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-language",
    "this work is licensed under the gnu general public license version #": "gpl-ref",
    "this program is free software you can redistribute it andor modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version": "gpl-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "this library is free software you can redistribute it andor modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "lgpl-later",
    "licensed under cc by nc #": "cc-by-nc",
    "licensed under cc by #": "cc-by",
    "licensed under cc by sa #": "cc-by-sa",
    "this work is licensed under a creative commons attribution # international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation andor other materials provided with the distribution": "bsd-binary",
    "this source code form is subject to the terms of the mozilla public license v. #": "mpl-ref",
    "permission to use copy modify andor distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "all rights reserved": "reserved",
}
# Rules in the order in which they are tried. {} is the version that was read.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-{}", ("apache-ref", "apache-compliance", "apache-copy", "apache-warranty", "apache-language")),
    ("GPL-{}-or-later", ("gpl-later", "gpl-warranty", "gpl-details", "gpl-received")),
    ("GPL-{}-or-later", ("gpl-later",)),
    ("LGPL-{}-or-later", ("lgpl-later",)),
    ("BSD", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-ref",)),
    ("Apache-{}", ("apache-ref",)),
    ("GPL-{}", ("gpl-ref",)),
    ("MPL-{}", ("mpl-ref",)),
    ("CC-BY-NC-{}", ("cc-by-nc",)),
    ("CC-BY-SA-{}", ("cc-by-sa",)),
    ("CC-BY-{}", ("cc-by",)),
    ("all-rights-reserved", ("reserved",)),
]
# White space within a phrase, which may be a line end and the next line's comment prefix.
WRAP = r"(?:[^\S\n]+|[^\S\n]*\n[\s*#/;%>-]*)"
TRIGGERS = re.compile(f"licen[sc]e|in{WRAP}compliance{WRAP}with|copyright|rights{WRAP}reserved|permission|redistribut|warrant|free{WRAP}software|spdx", re.I)
SENTENCE = re.compile(r"(?:[^.;:!?\n]|[.;:!?](?!\s|$))+")
#: Comment and list marks that a line may begin with.
PREFIX = re.compile(r"\s*(?:(?:/\*+|\*+/|//+|[*#%>;]+|--+>?|<!--+|-(?=\s)|dnl\b|rem\b|\(?[0-9a-z]\)(?=\s))\s*)*", re.I)
FIRST = re.compile(r"[^a-z0-9#]*([a-z0-9.#/\"]+)", re.I)
VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)*")
FIELDS = [("licences", "array<string>"), ("spans", "array<string>"), ("n_known", "bigint"), ("n_unknown", "bigint")]


def plain(piece: str) -> str:
    """Lower case words with single spaces; dots only within words."""
    s = re.sub(r"[^a-z0-9.#]+", " ", piece.lower().replace("/", "").replace('"', ""))
    return re.sub(r"\.+(?= |$)", "", s).strip(" .")


def versioned(s: str) -> tuple[str, str]:
    """Normalised words with # for their first version number, and that number."""
    m = VERSION.search(s)
    return (f"{s[: m.start()]}#{s[m.end() :]}", m[0]) if m else (s, "")


class Known:
    """Known sentences in the form of ``plain``, what they can begin with, and their first words."""

    def __init__(self, sentences: dict[str, str]):
        self.names = {versioned(plain(s))[0]: name for s, name in sentences.items()}
        words = [s.split(" ") for s in self.names]
        self.beginnings = {" ".join(w[:k]) for w in words for k in range(1, len(w) + 1)}
        self.first = {w[0] for w in words}

    def may_begin(self, text: str, start: int, end: int) -> bool:
        m = FIRST.match(text, start, end)
        word = m and m[1].replace("/", "").replace('"', "").rstrip(".").lower()
        return m is not None and (not word or word in self.first or word[0].isdigit())

    def longest(self, text: str, pieces: list, k: int) -> tuple[str, str, int, int] | None:
        """(identifier, version, end, next piece) of the longest known sentence that begins with piece k."""
        words, best = "", None
        while k < len(pieces) and pieces[k] is not None:
            if more := plain(text[slice(*pieces[k])]):
                words = f"{words} {more}" if words else more
                s, version = versioned(words)
                if s not in self.beginnings:
                    break
                if s in self.names:
                    best = (self.names[s], version, pieces[k][1], k + 1)
            k += 1
        return best


def pieces_of(text: str) -> list[tuple[int, int] | None]:
    """Start and end of the pieces between sentence marks and line ends, without comment prefixes; None between paragraphs."""
    out, at = [], 0
    for line in text.split("\n"):
        body = PREFIX.match(line).end()
        if body == len(line):
            out.append(None)
        for m in SENTENCE.finditer(line, body):
            if s := m[0].lstrip():
                out.append((at + m.end() - len(s), at + m.end()))
        at += len(line) + 1
    return out


def recognised(text: str, known: Known) -> tuple[int, list[tuple[str, str, int, int]]]:
    """Unknown pieces about licences, and (identifier, version, start, end) of the known sentences."""
    found, unknown, k = [], 0, 0
    pieces = pieces_of(text)
    while k < len(pieces):
        if pieces[k] is not None:
            start, end = pieces[k]
            best = known.longest(text, pieces, k) if known.may_begin(text, start, end) else None
            if best and TRIGGERS.search(text, start, best[2]):
                name, version, end, k = best
                found.append((name, version, start, end))
                continue
            unknown += TRIGGERS.search(text, start, end) is not None
        k += 1
    return unknown, found


def matched(found: list[tuple[str, str, int, int]], rules: list = RULES) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the rules in order; a sentence serves one rule at most."""
    free, out = [True] * len(found), []
    for licence, sequence in rules:
        for first in range(len(found)):
            if not free[first] or found[first][0] != sequence[0]:
                continue
            used, at = [first], first
            for name in sequence[1:]:
                at = next((k for k in range(at + 1, min(at + 2 + GAP, len(found))) if free[k] and found[k][0] == name), -1)
                if at < 0:
                    break
                used.append(at)
            if len(used) == len(sequence):
                for k in used:
                    free[k] = False
                out.append((licence.format(next((found[k][1] for k in used if found[k][1]), "unversioned")), found[used[0]][2], found[used[-1]][3]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """``docs`` with licences in order of appearance, their spans (licence:start:end in code points) and counts."""
    sentences, rules = sentences or SENTENCES, rules or RULES

    def start():
        known = Known(sentences)

        def work(columns):
            rows = []
            for t in columns[0]:
                unknown, found = recognised(t, known) if t and TRIGGERS.search(t) else (0, [])
                hits = matched(found, rules)
                rows.append(([h[0] for h in hits], [f"{a}:{b}:{c}" for a, b, c in hits], len(found), unknown))
            return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in FIELDS]

        return work

    return append_columns(docs, [text], FIELDS, start)
