"""Byte-level BPE, fertility rules and language-model scoring."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from strandlake.llm import bpe, lm, quality

TEXTS = ["", None, "a", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "I'll don't we've", "a\x1cb ½ x² ⅷ 一二    x  y\n\n z_1 'll", "é" * 3000, "x" * 3000 + " " * 500, "日本語 😀😀  \r\n\t foo", "abababababab ababab", " 123 456,789..", "The thing. The thing. The thing.", "0" * 2000 + "  tail"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcab thein  éñ日\n'.,019_😀") for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_replay_equals_the_library(vocabulary, encoding):
    split, replay, back = bpe.Splitter(P.PATTERN), bpe.MergeReplay(vocabulary), bpe.Decoder(vocabulary)
    for texts in ([t or "" for t in TEXTS], noise(1, 400)):
        pieces = [split(t) for t in texts]
        replay.learn(set().union(*pieces))
        for t, p in zip(texts, pieces, strict=True):
            packed = b"".join(replay.ids[x] for x in p)
            assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(t)
            assert back(packed) == t.encode()


def test_merges_whose_order_matters():
    """A merge that makes a pair of lower rank goes on there first; overlapping pairs go from the left."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 310, b"aa": 320, b"cab": 305, b"aaa": 301}
    replay = bpe.MergeReplay(bpe.Vocabulary(ranks))

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            if not found or min(found)[0] == 1 << 30:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(5)
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 14))) for _ in range(500)]
    assert [x.tolist() for x in replay.replay(pieces)] == [plain(p) for p in pieces]


def test_encode_decode_frames(spark, vocabulary, encoding):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id bigint, text string, n_tokens string")
    rows = bpe.decode(bpe.encode(docs, vocabulary, P.PATTERN), vocabulary).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        ids = encoding.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), vocabulary, P.PATTERN).count() == 0


def test_query_digests(spark, encoding, tmp_path):
    from strandlake.llm.queries import op2_byte_bpe

    spark.createDataFrame([(1, "The cat sat. Él 99"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_byte_bpe(spark, str(tmp_path)).collect():
        text = "The cat sat. Él 99" if r.doc_id == 1 else ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_quality_base_equals_brute_force(spark):
    r = random.Random(4)
    texts = TEXTS + noise(3, 60) + ["\n".join(" ".join(r.choice(["a", "b", "c&", "é|"]) for _ in range(r.randint(0, 5))) for _ in range(40)) for _ in range(20)] + ["  a\x85b\x1fc"]
    docs = spark.createDataFrame([(i, t, r.choice(["en", "xx", None]), 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, kept int")
    found = quality.quality(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN).collect()
    for x in found:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(x.text)
        assert not (x.base_failed and x.kept)


def test_quality_bands(spark):
    r = random.Random(1)
    plain = " ".join(r.choice("the house was built near river and people walk there every morning with their children because weather seems fine".split()) for _ in range(300))
    junk = " ".join("".join(r.choice("qxzj#%7") for _ in range(6)) for _ in range(300))
    docs = spark.createDataFrame([(1, plain), (2, junk)], "doc_id bigint, text string")
    found = {x.doc_id: x.kept for x in quality.quality(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN, bands=quality.BANDS | {"Latin": quality.BANDS["en"]}).collect()}
    assert found == {1: True, 2: False}


def test_quality_of_very_long_texts(spark, encoding):
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x" * 1_000_000, ("word " * 60 + " " * 5_000) * 3, "日" * 300_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {x.doc_id: x for x in quality.quality(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN).drop("text").collect()}
    assert [found[i].n_words for i in range(6)] == [0, 2, 1, 180, 1, 0]
    assert found[3].chars_per_token == pytest.approx(len(texts[3]) / len(encoding.encode_ordinary(texts[3])))
    assert quality.quality(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN).count() == 0


def test_lm_base_and_mixing(spark):
    r = random.Random(2)
    grammar = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["down", "the"], "ran": ["off", "the"], "down": ["the"], "off": ["the"]}

    def text():
        words = ["the"]
        for _ in range(r.randint(5, 60)):
            words.append(r.choice(grammar[words[-1]]))
        return " ".join(words).replace("the", "The", 1)

    texts = [text() for _ in range(300)] + [None, "", "unseenword the CAT", "x" * 500]
    rows = list(enumerate(texts))
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, score string")
    training = spark.createDataFrame([(i, t) for i, t in rows if not out(i)], "doc_id bigint, text string")
    tokens = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), ""]
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    found = {x.doc_id: x for x in lm.score(docs, training).collect()}
    assert len(found) == len(rows)
    gain = 0.0
    for i, t in rows:
        x, w = found[i], tokens(t)
        want = sum(math.log10((counts[a] + 0.5) / (total + 0.5 * (distinct + 1))) for a in w)
        assert abs(x.base_score - want) < 1e-8 and x.n_tokens == len(w) and x.n_known == sum(counts[a] > 0 for a in w) and x.train_tokens == total
        assert x.score < 0
        gain += (x.score - want) * out(i)
    assert gain > 0  # the grammar's contexts tell more than single words


def test_lm_rows_without_or_of_one_id(spark):
    training = spark.createDataFrame([("aa bb cc aa rare1 rare2",)] * 3 + [("aa bb", )], "text string")
    texts = ["aa rare1 new1", "bb rare2", None, "aa rare1 new1"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (9, texts[1])], "doc_id bigint, text string")
    tokens = Counter(w for t in ["aa bb cc aa rare1 rare2"] * 3 + ["aa bb"] for w in [*t.split(), ""])
    total, distinct = sum(tokens.values()), len(tokens)
    base = lambda t: sum(math.log10((tokens[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*(t or "").split(), ""])
    rows = sorted(((x.doc_id or 0, round(x.base_score, 8), x.n_known) for x in lm.score(docs, training).collect()))
    assert rows == sorted((i, round(base(t), 8), sum(tokens[w] > 0 for w in [*(t or "").split(), ""])) for i, t in [(0, texts[0]), (0, texts[1]), (9, texts[2]), (9, texts[3]), (9, texts[1])])
    assert lm.score(docs.limit(0), training).count() == 0 and lm.score(docs, training.limit(0)).where("train_tokens = 0 AND score < 0").count() == 5


def test_lm_score_equals_a_plain_mixer(spark, monkeypatch):
    """The score of every text, bit by bit, from plain counts in dictionaries."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["xy", "zzz"]
    texts = [" ".join(r.choice(words[: 3 + i % 12]) for _ in range(r.randint(1, 90))) for i in range(60)] + ["", "qu w1 w2", "w1 once"]
    monkeypatch.setattr(lm, "SIDE_BY_SIDE", 1)  # the bits that a refinement looks at are counted over texts side by side
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    training = frame.where("doc_id < 50 OR doc_id = 62")
    model, _ = lm.fitted(training, "text", lm.VOCABULARY)
    ids, tables = model.ids(), [Counter(), Counter()]
    kept = [t for i, t in enumerate(texts) if i < 50 or i == 62]

    def bits(text):
        """(token, slots of the two contexts, node, bit); contexts that share a slot share its counts."""
        seq = np.array([ids.get(w.encode(), 1) for w in text.split()] + [0])
        contexts = lm.word_contexts(seq)
        for k, x in enumerate(seq):
            for j in range(model.code.start[x], model.code.start[x + 1]):
                node = int(model.code.node[j])
                a, b = (int(lm.slots_of(c[k : k + 1], model.code.hash[node : node + 1], model.bits)[0]) for c in contexts)
                yield k, a, b, node, int(model.code.bit[j])

    for t in kept:
        for _, a, b, _, y in bits(t):
            tables[0][a, y] += 1
            tables[1][b, y] += 1
    counts = Counter(w for t in kept for w in t.split())
    rare = {w: n for w, n in counts.items() if w.encode() not in ids}
    known, new = sum(rare.values()), sum(n == 1 for n in counts.values()) + 1

    def nats(text):
        weights, total = {}, 0.0
        groups = {}
        for k, a, b, node, y in bits(text):
            groups.setdefault(0 if k < 16 else 1 if k < 48 else 2 if k < 112 else 3, []).append((a, b, node, y))
        for n, group in sorted(groups.items()):
            slopes = {}
            for at, (a, b, node, y) in enumerate(group):
                x, level = [float(model.code.logit[node])], []
                for table, c in zip(tables, (a, b), strict=True):
                    zero, one = table[c, 0], table[c, 1]
                    x.append(round((math.log((one + lm.PSEUDO) / (zero + lm.PSEUDO)) + 8) * 1024) / 1024 - 8)
                    level.append(sum(zero + one > m for m in (0, 2, 15)))
                gate = level[0] * 4 + level[1]
                w = weights.setdefault(gate, [float(model.weights[i][gate]) for i in range(3)])
                z = sum(p * q for p, q in zip(w, x, strict=True))
                total += math.log1p(math.exp(-z)) + (0 if y else z)
                if at % lm.EVERY == 0:
                    slopes.setdefault(gate, []).append([(y - 1 / (1 + math.exp(-z))) * v for v in x])
            for gate, many in slopes.items():
                for i in range(3):
                    step = sum(s[i] for s in many) * lm.STEP / math.sqrt(len(many))
                    weights[gate][i] += max(-4 * lm.STEP, min(4 * lm.STEP, step))
        for w in text.split():
            if w.encode() not in ids:
                total -= math.log((rare[w] if w in rare else new) / (known + new))
                if w not in rare:
                    total += float(lm.spelt([w.encode()], model.letters, model.byte_weights)[0])
        return total

    for x in lm.score(frame, training).collect():
        assert x.score == pytest.approx(-nats(texts[x.doc_id]) / math.log(10), rel=2e-4), x.doc_id


def test_lm_weights_come_from_all_training_texts(spark):
    """Long texts and long words count too, and as many as there are: weights equal those of all bits in one array, but for the bins."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["a b c d", "a c", "b d e", "f g"]) for _ in range(14_000)) + f" {k}" + "long" * 20 for k in range(2)] + [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 30))) for _ in range(500)]
    model, _ = lm.fitted(spark.createDataFrame([(t,) for t in texts], "text string"), "text", lm.VOCABULARY)
    assert len(texts[0]) > 1 << 16
    ids = np.array([model.ids().get(w.encode(), 1) for t in texts for w in [*t.split(), ""]])
    length, node, bit = model.code.bits(ids)
    slots = [lm.slots_of(np.repeat(c, length), model.code.hash[node], model.bits) for c in lm.word_contexts(ids)]
    high = []
    for s in slots:
        zeros, ones = (np.bincount(s[bit == y], minlength=1 << model.bits)[s] - (bit == y) for y in (0, 1))
        high.append(lm.cells_of(zeros.astype(np.float32), ones.astype(np.float32)))
    gate = lm.gate_of(high)
    want = lm.learnt([model.code.logit[node], *(lm.LOGITS[h] for h in high)], gate, bit, np.ones(len(bit)))
    often = np.bincount(gate, minlength=lm.GATES) > 1000
    assert often.any() and (abs(want - 0.4) > 0.1)[:, often].any()
    assert model.weights[:, often] == pytest.approx(want[:, often], abs=0.1)
    assert (model.byte_weights != np.float32(0.4)).any()


def test_tokens_equal_the_pattern():
    import pyarrow as pa

    texts = [*TEXTS, " A\x0bB\x0cC\x1cd\x85e\u00a0F Éa  ", "\t\n", *noise(9, 100)]
    tokens = lm.Tokens(pa.array(texts))
    words = [[x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    assert tokens.size.tolist() == list(map(len, words)) and [tokens.words[k].as_py().decode() for k in tokens.code.tolist()] == [w for x in words for w in x]
    known = {w.encode(): k + 2 for k, w in enumerate(sorted({w for x in words for w in x})[::2])}
    ids = tokens.ids(known.get)
    assert ids.tolist() == [k for x in words for k in [*(known.get(w.encode(), 1) for w in x), 0]]
    assert [{p["word"].decode(): p["tf"] for p in row} for row in tokens.rare(ids).to_pylist()] == [dict(Counter(w for w in x if w.encode() not in known)) for x in words]


def test_spelt_words_are_a_distribution():
    """All words of two letters and less, each ended, and all longer ones together have the probability 1."""
    rng = np.random.default_rng(1)
    letters = [rng.integers(0, 1 << 16, 1 << lm.BYTE_BITS).astype(np.uint16) for _ in lm.ORDERS]
    weights = rng.random((3, lm.GATES)).astype(np.float32)
    one = np.exp(-lm.spelt([bytes([b]) for b in range(1, 256)], letters, weights))
    grams = np.arange(256)  # the first byte after nothing
    y, slots = lm.gram_bits(grams)
    high = [t[s] for t, s in zip(letters, slots, strict=True)]
    _, worth = lm.predicted(sum(weights[k][lm.gate_of(high[-2:])] * lm.LOGITS[c] for k, c in enumerate(high)), y)
    first = np.exp(-worth.reshape(-1, 8).sum(axis=1))
    assert first.sum() == pytest.approx(1, rel=1e-4) and (one < first[1:]).all()


def test_codes_are_a_distribution():
    code = lm.Code(np.array([5, 1, 9, 3, 2, 2]))
    spaces = [0.5 ** int(code.start[k + 1] - code.start[k]) for k in range(6)]
    assert abs(sum(spaces) - 1) < 1e-12
    paths = {tuple(zip(code.node[code.start[k] : code.start[k + 1]].tolist(), code.bit[code.start[k] : code.start[k + 1]].tolist(), strict=True)) for k in range(6)}
    assert len(paths) == 6


def test_near_nodes_of_a_code_have_neighbouring_slots():
    """A token's bits meet few places of memory, and no two nodes that share one for a context share a slot."""
    code = lm.Code(np.random.default_rng(3).integers(1, 10_000, 3_000))
    near = 1 << lm.NEAR_BITS
    assert len(set(code.hash.tolist())) == len(code.hash)
    contexts = lm.word_contexts(np.random.default_rng(4).integers(0, 3_000, 50))[1]
    for context in contexts[:, None]:
        slots = lm.slots_of(np.repeat(context, len(code.hash)), code.hash, 20).astype(int)
        assert slots.max() < 1 << 20
        groups = {}
        for k, slot in enumerate(slots.tolist()):
            groups.setdefault(int(code.hash[k]) // near, []).append(slot)
        assert all(len({s // near for s in g}) == 1 and len(set(g)) == len(g) for g in groups.values())
    paths = [slots[code.node[code.start[k] : code.start[k + 1]]] for k in range(3_000)]
    assert all(len(set((p // near).tolist())) <= -(-len(p) // lm.NEAR_BITS) for p in paths)


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_tokens_are_met_once_per_pair_of_words_before(monkeypatch, scale):
    """Each with how often it comes there; also where ids are too large for three to fit a number."""
    monkeypatch.setattr(lm, "COUNTED_AT_ONCE", 7)
    ids = np.random.default_rng(5).choice([0, 1, 2, 3, 4], 500) * scale
    ids[-1] = 0
    want, found = Counter(zip(ids.tolist(), *(c.tolist() for c in lm.word_contexts(ids)), strict=True)), Counter()
    for some, times, contexts in lm.distinct_tokens(ids):
        assert len(some) == len(times) == len(contexts[0]) == len(contexts[1]) <= 7
        for *key, n in zip(some.tolist(), *(c.tolist() for c in contexts), times.tolist(), strict=True):
            assert scale > 1 or tuple(key) not in found
            found[tuple(key)] += n
    assert found == want
    assert [*lm.distinct_tokens(ids[:0])] == []
