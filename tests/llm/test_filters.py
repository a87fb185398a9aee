"""Line dedup, decontamination, personal data, toxicity, licences and HTML extraction."""

import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import fmindex, html, licences, lines, pii, toxicity

# --- line dedup ---------------------------------------------------------------------------------------


def test_line_dedup(spark):
    long = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    near = long.replace("wordy", "other")
    logs = "Request took {} ms on host number {} today"
    rows = [
        (1, f"{long}\nunique line number one of the first document here"), (2, f"own words are here\n{long}"), (3, f"{near}\nsomething else again"),
        (4, logs.format(12, 7)), (5, logs.format(9, 81) + "\nkept line"), (6, logs.format(3, 3)), (7, None), (8, ""), (9, "short line"), (10, "short line"), (10, "short line"), (None, long),
    ]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_dropped int")
    found = lines.line_dedup(docs).collect()
    assert len(found) == len(rows)
    texts = {r.doc_id: r.text for r in found}
    assert texts[1] == rows[0][1] and texts[2] == "own words are here" and texts[3] == "something else again"
    assert texts[4] == rows[3][1] and texts[5] == "kept line" and texts[6] == ""
    assert texts[7] is None and texts[8] == "" and texts[9] == "short line" and texts[None] == long
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_unique_lines_stay(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(r.randint(8, 40))) for _ in range(5))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.text for x in lines.line_dedup(docs).collect()} == dict(rows)


# --- decontamination ------------------------------------------------------------------------------------


def brute_hits(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[p]
        out[d] = (len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("parts", [1 << 23, 60])
def test_decontamination_equals_brute_force(spark, parts):
    r = random.Random(3)
    word = lambda: r.choice(["aa", "b", "Cé", "d1", "日", "e"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 4, 5, 6, 9])))) for i in range(6)] + [(90, ""), (91, None), (92, "--")]
    docs = [(i, "".join(word() + r.choice([" ", ", ", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, ""), (101, None), (102, "aa " * 3000)]
    docs.append((103, items[0][1]))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, spans string")
    found = fmindex.decontaminate(frame, spark.createDataFrame(items, "item_id bigint, text string"), window=5, phrase_bytes=parts)
    want = brute_hits(docs, items, 5)
    rows = found.collect()
    assert {x.doc_id: (x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in rows} == want
    clean = fmindex.remove_spans(found).select("doc_id", "text").collect()
    for x in clean:
        if want[x.doc_id][1] == 0:
            assert x.text == dict(docs)[x.doc_id]
        else:
            assert len(fmindex.words_of(x.text.encode())) == want[x.doc_id][0] - want[x.doc_id][1]


def test_decontamination_of_rows_without_or_of_one_id(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (3, "p q r")], "item_id bigint, text string")
    rows = [(None, "one a b c two"), (None, "x y z"), (None, None), (7, "a b c and p q r"), (7, "tail x y z"), (7, "short"), (8, "a b c"), (8, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    results = []
    for parts in (1 << 23, 6):
        found = fmindex.decontaminate(docs, items, phrase_bytes=parts)
        results.append(sorted(map(repr, found.collect())))
        cut = sorted((r.doc_id or 0, r.text or "") for r in fmindex.remove_spans(found).collect())
        assert cut == [(0, ""), (0, ""), (0, "one  two"), (7, " and "), (7, "short"), (7, "tail "), (8, ""), (8, "")]
    assert len(results[0]) == len(rows) and results[0] == results[1]


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert [x.n_hit for x in fmindex.decontaminate(docs, empty).collect()] == [0, 0]
    assert fmindex.decontaminate(docs.limit(0), empty).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 11, 500)
    tree = fmindex.WaveletTree(seq, 11)
    at, symbol = rng.integers(0, 501, 200), rng.integers(0, 11, 200)
    assert tree.rank(symbol, at).tolist() == [int((seq[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]
    assert tree.access(np.arange(500)).tolist() == seq.tolist()


# --- personal data ------------------------------------------------------------------------------------------


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_equals_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("a.@-+1230 5(%_)é😀") for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["1" * 3000, "a" * 3000 + "@b.c", "a@" + "b." * 2000 + "c", "+1" + "." * 3000, "mail a@b.co_x@y.org 1.2.3.4.5.6.7.8 4111 1111 1111 1111, +1 (555) 555-0100", None, ""]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    for x in pii.detect(docs).collect():
        assert x.base_spans == brute_spans(x.text)
        base, all_spans = (set(filter(None, v.split(","))) for v in (x.base_spans, x.spans))
        assert base <= all_spans and x.n_spans == len(all_spans) and x.n_email + x.n_ip + x.n_card + x.n_phone == len(base)
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_of_long_texts(spark):
    """Very many numbers, and chosen spans against a plain sweep."""
    r = random.Random(8)
    long = " ".join(str(r.randint(0, 10 ** r.randint(1, 19))) for _ in range(30_000))
    found = pii.detect(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).collect()
    assert found[0].base_spans == brute_spans(long)
    for _ in range(5):
        spans = lambda n: sorted((a := r.randint(0, 300), r.randint(0, 5), a + r.randint(1, 12)) for _ in range(n))
        base, chosen = spans(r.choice([0, 5, 200])), spans(r.choice([1, 40, 300]))
        want, stop = [], 0
        for a, k, b in chosen:
            if a >= stop and not any(x < b and a < y for x, _, y in base):
                want.append((a, k, b))
                stop = b
        row = spark.createDataFrame([(base, chosen)], f"base array<{pii.SPAN}>, chosen array<{pii.SPAN}>").select(pii.outside("chosen", "base").alias("x")).first()
        assert [tuple(x) for x in row.x] == want


def test_pii_addresses_with_zero_parts(spark):
    good = ["10.0.0.1", "0.0.0.0", "010.000.0.01", "192.168.0.1", "127.0.0.1", "8.8.8.8", "0255.0249.0199.099"]
    texts = [f"host {x} up" for x in [*good, "0256.0.0.0", "10.0.0.300", "1.0.0", "0.0.0." + "0" * 3000, "0" * 3000 + ".0.0.0256"]]
    found = {x.text: x for x in pii.detect(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [found[t].base_spans for t in texts] == [brute_spans(t) for t in texts]
    assert all(found[t].n_ip == 1 for t in texts[: len(good)])


def test_pii_adds_candidates_and_runs_no_python(spark):
    secrets = [(i, f"words and words password={zlib.crc32(str(i).encode()):08x}ab99cd here, see internationalization ok") for i in range(60)]
    found = pii.detect(spark.createDataFrame(secrets, "doc_id bigint, text string"))
    assert all("secret:" in x.spans for x in found.collect())
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


# --- toxicity --------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [r.choice(words) for _ in range(40)] + (["vile" + r.choice(["a", "bc", "def"]), "awful"] if toxic else [])
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in [*rows, (1000, None), (1001, "")]], "doc_id bigint, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int"))
    found = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert 0 <= found[1000] == found[1001] < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert [x.score for x in toxicity.score(docs, model).collect()] == [0.5, 0.5]


# --- licences ---------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, f"{mit} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (3, "Released under the MIT License.\nAll rights reserved."), (4, "This licence is odd and unknown."), (5, None), (6, ""), (7, "No trigger here"), (8, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, licences int")
    found = {x.doc_id: x for x in licences.scan(docs).collect()}
    assert {k: list(v.licences) for k, v in found.items()} == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["MIT", "all-rights-reserved"], 4: [], 5: [], 6: [], 7: [], 8: ["CC-BY-NC-4.0"] * 2}
    assert found[4].n_unknown == 1
    name, a, b = found[1].spans[0].rsplit(":", 2)
    assert rows[0][1][int(a) : int(b)] == "Licensed under the Apache License, Version 2.0"


NOTICES = {
    "GPL-3-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "all-rights-reserved": "Copyright 2020 Example\nAll rights\nreserved",
}


def test_official_notices(spark):
    unwrapped = lambda t: re.sub(r"(?<!\n)\n[ ]*(?!\n)", " ", t)
    commented = lambda t, mark: "\n".join(f"{mark} {line}".rstrip() for line in t.split("\n"))
    rows = []
    for name, t in NOTICES.items():
        rows += [(name, t), (name, t.replace("\n", "\r\n")), (name, f"/*\n{commented(t, ' *')}\n */\nint x;"), (name, commented(t, "#")), (name, commented(t, "//"))]
        rows += [(name, unwrapped(t))] if name != "all-rights-reserved" else []
    docs = spark.createDataFrame(rows, "want string, text string")
    for x in licences.scan(docs).collect():
        assert x.licences == [x.want], x.text
    last = licences.scan(docs.where("want = 'all-rights-reserved'")).first()
    assert last.text[slice(*map(int, last.spans[0].split(":")[1:]))] == "All rights\nreserved" and (last.n_known, last.n_unknown) == (1, 1)


# --- HTML --------------------------------------------------------------------------------------------------------


def test_html_extraction(spark):
    article = "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n  two <b>three<br><p>Four &lt;5&gt;</p><aside>side</aside><form><p>mail</p></form><script>x('</p>')</script><div id='comments'><p>nice</p></div></article><footer>&copy; us</footer></body></html>"
    menu = "<ul><li>Home page here</li><li>About our shop now</li></ul>"
    plain = [f"<body>{menu}<p>Story number {w} tells of {w} things</p><p>Contact us at the usual place</p></body>" for w in ("ann", "bob", "cat")]
    rows = [(1, "http://a.org/x", article), (2, "http://a.org/y", None), (3, "http://a.org/z", ""), *[(10 + i, f"http://b.org/{i}", h) for i, h in enumerate(plain)], (20, None, "just <i>text</i> &eacute;&#233;"), (21, "bad url", "<p")]
    pages = spark.createDataFrame([(*x, "clash") for x in rows], "page_id bigint, url string, html string, text string")
    found = {x.page_id: x for x in html.extract(pages).collect()}
    assert found[1].text == "A & B\nOne two three\nFour <5>"
    assert (found[2].text, found[2].n_chars, found[3].text) == ("", 0, "")
    assert [found[10 + i].text for i in range(3)] == [f"Story number {w} tells of {w} things" for w in ("ann", "bob", "cat")]
    assert found[20].text == "just text éé" and found[20].n_chars == 12
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("parts", "group_tokens"), [(1, 400_000), (1, 10), (7, 400_000), (7, 10)])
def test_html_repeats_of_a_host_across_groups(spark, parts, group_tokens):
    """What repeats on two pages of a host is cut however they are dealt out, also if one of them has an article, or if they are far apart."""
    menu, note = "<div>Home page here About our shop</div>", "<p>Only two of all pages say this</p>"
    page = lambda k: f"<body>{menu}<p>Story number {k} tells of {k} things</p>{note if k in (0, 29) else ''}<p>end {k}</p></body>"
    rows = [(k, f"http://Big.org/{k}", page(k)) for k in range(30)]
    rows += [(30, "http://big.org/a", "<article><p>Story number 7 tells more</p></article>"), (40, "http://other.org/", page(0)), (41, "http://other.org/copy", page(0)), (50, "http://alone.org/a", f"{menu}<main>kept {note}</main>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts, "page_id")
    found = {x.page_id: x.text for x in html.extract(pages, group_tokens=group_tokens).collect()}
    # "number 7 tells" and its neighbours: windows that are on a second page cover no whole block
    assert [found[k] for k in range(30)] == [f"Story number {k} tells of {k} things\nend {k}" for k in range(30)]
    assert found[30] == "Story number 7 tells more"
    whole = "Home page here About our shop\nStory number 0 tells of 0 things\nOnly two of all pages say this\nend 0"
    assert found[40] == found[41] == whole and found[50] == "kept\nOnly two of all pages say this"
    assert html.extract(pages, keep=["page_id"]).columns == ["page_id", "text", "n_chars"]


def test_html_scan_is_linear():
    import time

    began = time.time()
    for page in ("<p " * 350_000, '<p "' * 250_000, '<p ">' * 200_000, "<b>" * 150_000 + "<li></li></x>" * 60_000, "<article>" * 100_000 + "</p>" * 100_000, "<!-- " * 200_000, "<script>" * 120_000):
        html.blocks_of(page)
    assert time.time() - began < 30
    texts = lambda page: [b.text for b in html.blocks_of(page)]
    assert texts('a<p title="x>y">b<i>c</i>d</p>e <br/>f') == ["a", "bcd", "e f"]
    assert texts("1 < 2 <p>x</p><? pi ?><!doctype x>y<") == ["1 < 2", "x", "y<"] and texts("<p title='it>x</p>") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert texts("<textarea><p>no</p></textarea>yes<script>'</p>'</SCRIPT>z") == ["yesz"]


def test_html_needs_no_package_on_the_workers():
    """The functions that tasks run are pickled with all that they refer to."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); print(len(f('<p>a b c d</p>')), 'strandlake' in sys.modules)"
    got = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(html.blocks_of), capture_output=True, cwd="/")
    assert got.stdout.split() == [b"1", b"False"], got.stderr.decode()


def test_repeated_cover_equals_brute_force():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 4, int(rng.integers(0, 40))) for _ in range(12)]
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - 3):
            where.setdefault(tuple(s[i : i + 4].tolist()), set()).add(k)
    for k, (s, got) in enumerate(zip(streams, html.repeated_cover(streams, 4, 3), strict=True)):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 3):
            if len(where[tuple(s[i : i + 4].tolist())]) >= 3:
                want[i : i + 4] = True
        assert got.tolist() == want.tolist(), k
