import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import ngram_join as J
from strandlake.llm.components import components


def shingle_set(text, n):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, c in shared.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    vocabulary = [word() for _ in range(400)]
    rows = []
    for _ in range(4):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 30, 90, 300]))]
        rows.append(" ".join(base))
        for _ in range(60):
            copy, rate = list(base), r.random() * 0.06
            for k in range(len(copy)):
                if r.random() < rate:
                    copy[k] = word()
            cut = r.randint(0, len(copy) // 12)
            rows.append("  \n".join(copy[cut:]))
    passage = [r.choice(vocabulary) for _ in range(50)]
    for _ in range(40):
        rows.append(" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(0, 12))]))
    rows += ["", "One", "one", "a b", "A B", "a b c", None, "x " * 5000]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(docs, n=n, percent=percent).collect()}
    assert found == brute(rows, n, percent)


def test_repeated_rows_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "q r s t"), (9, None)], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.similarity_components(docs).collect())
    assert found == [(0, 1, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    assert J.similarity_components(docs.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    a, b = "one two three four five six seven", "red green blue white black grey pink"
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, a, "x"), (3, None, "x"), (3, None, "x"), (3, "", "x"), (None, a, "n"), (None, a, "n"), (4, b + " extra", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.similarity_components(docs, n=4, percent=80).collect())
    assert found == [(0, 4, 0), (0, 4, 0), (1, 4, 1), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (3, 0, 3), (3, 0, 3), (4, 5, 1)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in J.distinct_documents(docs, n=4, percent=80).collect())
    assert kept == [(0, a), (0, a), (1, a), (1, b), (3, ""), (3, "")]
    assert J.distinct_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_members_of_a_hub_in_blocks(spark, monkeypatch, block):
    """Links among members that aren't linked to their hub, whatever the blocks."""
    monkeypatch.setattr(J, "BLOCK_ELEMENTS", block)
    monkeypatch.setattr(J, "PROBE_ELEMENTS", 4 * block)
    r = random.Random(5)
    elements = list(range(1, 400))
    sets = {0: set(r.sample(elements, 100))}
    for k in range(1, 80):
        of = sets[r.randrange(k)] if k % 3 else sets[0]
        size = r.choice([3, 8, 15, 25])
        sets[k] = (of - set(r.sample(sorted(of), min(size, len(of) - 1)))) | set(r.sample(elements, r.choice([0, 4, size])))
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    rows = [(0, k, linked(sets[0], s), len(sets[0] ^ s)) for k, s in sets.items() if k]
    texts = spark.createDataFrame([(k, " ".join(map(str, sorted(s)))) for k, s in sets.items()], "node bigint, text string")
    found = {frozenset(x) for x in J.within_hubs(spark.createDataFrame(rows, "u bigint, v bigint, link boolean, n bigint"), texts, 1, 80).collect()}
    true = {frozenset((a, b)) for a in sets for b in sets if 0 < a < b and linked(sets[a], sets[b])}
    hub = {frozenset((0, k)) for k in sets if k and linked(sets[0], sets[k])}

    def parts(edges):
        at = {k: k for k in sets}
        for _ in sets:
            for a, b in map(tuple, edges):
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert found <= true and parts(found | hub) == parts(true | hub)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(7)
    for size in [*range(1, 40), 100, 300, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            changed = int(rng.integers(0, size // 6 + 1))
            b = np.concatenate([a[changed:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if common < len(a) or common < len(b):
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert np.intersect1d(J.signatures(a, percent), J.signatures(b, percent)).size


@pytest.mark.parametrize("one_task", [0, 1000])
def test_connected_components(spark, one_task):
    r = random.Random(3)
    edges = [(r.randint(1, 80), r.randint(1, 80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for u, v in edges:
        if u and v and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "u bigint, v bigint"), one_task).collect()}
    assert found == {x: root(x) for x in parent}


def test_texts_of_candidates_are_shuffled_once(spark):
    """Also where the join is not broadcast; a repeated row gives its text once."""
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e"), (2, "a b c"), (None, "x")], "doc_id bigint, text string")
    wanted = rows.where("doc_id = 1").distinct().selectExpr("length(text) AS node", "doc_id", "xxhash64(text) AS text_hash").selectExpr("cast(node AS bigint) AS node", "doc_id", "text_hash")
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = J._texts(wanted, rows, spark)
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, texts.collect())) == [(3, "d e"), (5, "a b c")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 2, plan


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_lose_no_link(percent):
    """Of sets of many sizes, each that is linked to another is kept; those that share a passage only go."""
    rng = np.random.default_rng(11)
    sets = []
    for size in [1, 3, 40, 63, 64, 65, 130, 255, 256, 257, 520, 900, 3000]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            fresh = rng.integers(0, 1 << 63, int(rng.integers(0, size // 9 + 2)), dtype=np.uint64)
            sets += [np.unique(a), np.unique(np.concatenate([a[int(rng.integers(0, size // 9 + 1)) :], fresh]))]
    true = [any(i != j and 100 * (c := len(np.intersect1d(a, b))) >= percent * (len(a) + len(b) - c) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    near = J._near(np.array([len(x) for x in sets]), [np.frombuffer(J.sketch(x), "<u8") for x in sets], percent)
    assert not (np.array(true) & ~near).any()
    assert 0 < sum(true) < len(sets)
    passage = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    apart = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(130, 330)]
    assert not J._near(np.array([len(x) for x in apart]), [np.frombuffer(J.sketch(x), "<u8") for x in apart], percent).any()


def test_packed_signatures_come_back():
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.integers(0, 1 << J.SIG_BITS, 5000, dtype=np.uint64), np.array([0, (1 << J.SIG_BITS) - 1], np.uint64)]))
    values = np.concatenate([values, values[:700]])
    owners = np.arange(len(values)) % 65536
    made = list(J.packed(values, owners))
    back = [J.unpacked(*x) for x in made]
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back, strict=True)), strict=True)) == sorted(zip(values.tolist(), owners.tolist(), strict=True))
    assert sum(len(x) for _, x in made) < 8 * len(values)


def test_texts_that_share_a_passage_only_are_not_moved(spark, monkeypatch):
    """Their signatures are shared, but their sketches tell that they aren't linked; near copies among them are found."""
    r = random.Random(21)
    words = lambda k: [f"w{r.randrange(1 << 30)}" for _ in range(k)]
    passage = words(120)
    texts = [words(80) + passage + words(80) for _ in range(60)]
    texts += [t[:-1] + words(1) for t in texts[:5]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
    compared, real = [], J.differences
    monkeypatch.setattr(J, "differences", lambda pairs, *a: [compared.append(pairs.count()), real(pairs, *a)][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x.doc_id for x in J.distinct_documents(docs, n=5, percent=80).collect()}
    assert kept == set(range(1, 61)) and sum(compared) <= 20, compared


def test_bytes_of_signatures_on_disk(spark, monkeypatch):
    """A signature takes a few bytes in a table, and none is left when the components are known."""
    from pathlib import Path

    from strandlake.sources.folders import shared_folder

    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(1 << 40)}" for _ in range(400))) for i in range(400)]
    n = sum(len(J.signatures(J.Shingler(4)(t.encode()), 85)) for _, t in rows)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    on_disk = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    floor, seen, real = on_disk(), [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda *a: [real(*a), seen.append(on_disk() - floor)][0])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert J.similarity_components(docs, n=4, percent=85).where("component_id = doc_id").count() == 400
    assert max(seen) < 8 * n and on_disk() - floor < n, (n, seen)


@pytest.mark.parametrize(("held", "sketched"), [(700, 2), (1 << 20, 0)])
def test_components_whatever_the_bounds(spark, monkeypatch, held, sketched):
    """Signatures given out many times by a task, and hubs of too many members for sketches."""
    monkeypatch.setattr(J, "SIGS_HELD", held)
    monkeypatch.setattr(J, "SKETCHED", sketched)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(docs, n=4, percent=85).collect()}
    assert found == brute(rows, 4, 85)


def test_row_without_an_id_hides_no_link(spark):
    """It may be the first row of its text in a task, and gives no signatures itself."""
    text = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(text)), (2, " ".join(text)), (1, " ".join([*text, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in J.similarity_components(docs).collect()}
    assert found == {None: None, 1: 1, 2: 1}
