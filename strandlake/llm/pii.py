"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base spans come from strict patterns and validators. Beside them, high-recall generators propose
candidates that may overlap: keyed secrets, long mixed tokens, groups of digits, and spelt-out
addresses. Each candidate has binned features of its format and context; which generator proposed it is
none. Candidates are counted by (features, evidence) over all documents; evidence is a validator or a
keyword, which the features do not show. Keyed secrets have a keyword by their pattern, so they have no
evidence of their own and are only judged, by the format of the value behind the key. The counts are
bounded by the product of the bins, and boosted trees are fitted to them on the driver, but for those of
one text in ``FOLDS``, by a hash of the text. On these the threshold is set: the lowest at which the share
of candidates with evidence is still ``PRECISION``. The trees' verdicts on all cells become a literal that
a column expression looks up. Selected candidates that overlap no base span, nor an earlier selected one,
are added to the base spans.

Positions are code points, ends exclusive. Patterns are written so that each is linear in the text:
runs are matched possessively and only from their beginnings, which changes no match.

Defined results: a null or empty text has no spans; repeated rows get equal spans; equal starts are
ordered by the kind's place in ``KINDS``; whole texts are searched; other columns stay. Without any
candidate, or without evidence in both parts, nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "number")
#: Least share of evidence among the candidates from the threshold on.
PRECISION = 0.9
#: The threshold is set on one text in so many; the trees are fitted to the others.
FOLDS = 5
ROUNDS, DEPTH, RATE = 24, 3, 0.4

# The base patterns, without needless backtracking, and what a text must contain to be searched.
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": (r"[0-9]++(?:[ -][0-9]++)*+", "[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "[+]"),
}
# The generators: kind, pattern, what a text must contain.
KEYWORDS = r"(?i:passwor[dt]|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer)"
KEY_PART = r"^.*[:=]\s*[\"']?"
GENERATORS = [
    ("secret", rf"(?<![A-Za-z]){KEYWORDS}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?[A-Za-z0-9+/_.~-]{{6,}}+", "[:=]"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{12,}+", "[0-9]"),
    ("number", r"(?<![0-9A-Za-z+.])[0-9](?:[ ().-]{0,2}[0-9]){6,18}+", "[0-9]"),
    ("email", rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\s?[\[({{]\s?(?i:at|@)\s?[\])}}]\s?{DOMAIN}{{1,63}}+(?:\s?(?:[\[({{]\s?(?i:dot|\.)\s?[\])}}]|\.)\s?{DOMAIN}{{1,63}}+){{1,5}}", r"[\[({]"),
]
SORTS = ("secret", "number", "email")
#: Bins of each feature, from 0.
BINS = {"sort": 3, "size": 8, "digits": 6, "upper": 2, "lower": 2, "mark": 2, "before": 4, "after": 4}


#: Entries of the short arrays by which a long one grows.
GROWTH = 128


def grown(entries: str, entry: Callable[[Column], Column]) -> tuple[Column, Callable[[Column, Column], Column], Callable[[Column], Column]]:
    """An empty array of entries of a type, how to add one, and how to finish.

    Entries are added to a short array, which goes whole to an array of arrays: one long array would be
    copied at every step.
    """
    none = F.struct(F.array().cast(f"array<array<{entries}>>").alias("full"), F.array().cast(f"array<{entries}>").alias("part"))

    def add(done: Column, x: Column) -> Column:
        one = F.array(entry(x))
        return F.when(F.size(done["part"]) >= GROWTH, F.struct(F.concat(done["full"], F.array(done["part"])).alias("full"), one.alias("part"))).otherwise(
            F.struct(done["full"].alias("full"), F.concat(done["part"], one).alias("part"))
        )

    return none, add, lambda done: F.flatten(F.concat(done["full"], F.array(done["part"])))


def matches(text: Column, pattern: str, contains: str) -> Column:
    """array<struct<start, stop, value, left, after>> of the leftmost non-overlapping matches.

    left: up to 16 characters before the match, back to the beginning of the match before it; after: the next
    one, if that belongs to no match. They are cut from the text between matches, as a place in a long text
    is only reached by a walk through it.
    """
    found = F.when(text.rlike(contains), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between, n = F.split(text, pattern, -1), F.size(found)
    zipped = F.arrays_zip(found.alias("v"), F.slice(between, 1, n).alias("gap"), F.slice(between, 2, n).alias("next"), F.slice(F.concat(F.array(F.lit("")), found), 1, n).alias("prior"))
    none, add, finished = grown(
        "struct<start:int,stop:int,value:string,left:string,after:string>",
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["v"].alias("value"), x["left"].alias("left"), x["after"].alias("after")),
    )

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        stop = start + F.length(x["v"])
        placed = F.struct(start.alias("start"), stop.alias("stop"), x["v"].alias("v"), F.right(F.concat(x["prior"], x["gap"]), F.lit(16)).alias("left"), F.left(x["next"], F.lit(1)).alias("after"))
        return F.struct(stop.alias("at"), add(a["out"], placed).alias("out"))

    placed = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: finished(a["out"]))
    return F.when(n > 0, placed).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string,left:string,after:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def span(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop"))


def _is_kind(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_text`` (never null) and ``_base``, the sorted base spans."""
    found = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = found.withColumns({f"_{kind}": matches(F.col("_text"), *BASE[kind]) for kind in BASE})
    kept = [F.transform(F.filter(f"_{kind}", partial(valid, kind)), partial(span, kind)) for kind in BASE]
    return found.withColumn("_base", F.array_sort(F.concat(*kept))).drop(*[f"_{kind}" for kind in BASE])


def _edge(char: Column) -> Column:
    return F.when(char.rlike("^[A-Za-z]$"), 1).when(char.rlike("^[0-9]$"), 2).when(char.rlike(r"^\S$"), 3).otherwise(0)


def _candidate(generator: int, x: Column) -> Column:
    kind, left, value = GENERATORS[generator][0], x["left"], x["value"]
    if generator == 0:  # the value behind the key
        left, value = F.regexp_extract(value, KEY_PART, 0), F.regexp_replace(value, KEY_PART, "")
    n = F.length(value)
    count = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", ""))
    evidence = [
        F.lit(None).cast("boolean"),
        left.rlike(rf"{KEYWORDS}\W{{0,4}}$") | value.rlike("^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})$"),
        F.when(F.length(digits(value)).between(14, 19), luhn(digits(value))).otherwise(value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        value.rlike(r"[A-Za-z]{2,6}$"),
    ][generator]
    return F.struct(
        x["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        x["stop"].alias("stop"),
        F.lit(SORTS.index(kind)).alias("sort"),
        F.least((n / 6).cast("int"), F.lit(7)).alias("size"),
        F.least((count("0-9") * 6 / n).cast("int"), F.lit(5)).alias("digits"),
        (count("A-Z") > 0).cast("int").alias("upper"),
        (count("a-z") > 0).cast("int").alias("lower"),
        value.rlike("[^A-Za-z0-9]").cast("int").alias("mark"),
        _edge(F.right(left, F.lit(1))).alias("before"),
        _edge(x["after"]).alias("after"),
        evidence.cast("int").alias("evidence"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """The rows of ``base_spans`` with ``_candidates``: spans, features and evidence."""
    found = docs.withColumns({f"_g{k}": matches(F.col("_text"), pattern, contains) for k, (_, pattern, contains) in enumerate(GENERATORS)})
    made = [F.transform(f"_g{k}", partial(_candidate, k)) for k in range(len(GENERATORS))]
    return found.withColumn("_candidates", F.concat(*made)).drop(*[f"_g{k}" for k in range(len(GENERATORS))])


# --- boosting on counted feature cells ---------------------------------------------------------------


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree as nested (feature, threshold, left, right), or a leaf's value."""
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0:
        return value
    best = (1e-6, -1, -1)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        top = int(x[:, f].max()) + 1
        gs, hs = np.cumsum(np.bincount(x[:, f], g, top)), np.cumsum(np.bincount(x[:, f], h, top))
        gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - whole
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    _, f, t = best
    if f < 0:
        return value
    left = x[:, f] <= t
    return f, t, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _value(a, x), _value(b, x))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, held_n: np.ndarray, held_positive: np.ndarray) -> tuple[float, list, float]:
    """(start, trees, threshold) of logistic boosting on cells with n candidates, of which some have evidence; held ones set the threshold."""
    if not positive.sum() or not held_positive.sum():
        return 0.0, [], math.inf
    share = min(max(positive.sum() / n.sum(), 1e-4), 1 - 1e-4)
    start = math.log(share / (1 - share))
    score, trees = np.full(len(x), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, positive - p * n, p * (1 - p) * n, DEPTH)
        trees.append(tree)
        score = score + RATE * np.clip(_value(tree, x), -4, 4)
    seen = held_n > 0
    score, held_n, held_positive = score[seen], held_n[seen], held_positive[seen]
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(held_positive[order]) >= PRECISION * np.cumsum(held_n[order])
    last = np.append(score[order][1:] < score[order][:-1] - 1e-12, True)  # whole groups of equal scores only
    fit = np.flatnonzero(good & last)
    return start, trees, float(score[order[fit[-1]]]) - 1e-9 if len(fit) else math.inf


def fit(found: DataFrame) -> tuple[float, list, float]:
    """Boosted trees from the counted cells of all candidates that may have evidence; the cells are bounded by the product of ``BINS``."""
    names = list(BINS)
    held = F.pmod(F.xxhash64("_text"), F.lit(FOLDS)) == 0
    judged = found.select(held.alias("held"), "_candidates")  # before the explosion, which would carry the text along
    judged = judged.select("held", F.explode("_candidates").alias("c")).where("c.evidence IS NOT NULL")
    part = lambda v, mine, name: F.sum(F.when(F.col("held") == mine, v).otherwise(0)).alias(name)
    sums = [part(v, mine, f"{name}_{mine}") for mine in (False, True) for v, name in ((F.lit(1), "n"), (F.col("c.evidence"), "positive"))]
    cells = sorted(tuple(r) for r in judged.groupBy(*[F.col(f"c.{f}").alias(f) for f in names]).agg(*sums).collect())
    x = np.array([c[: len(names)] for c in cells], np.int64).reshape(len(cells), len(names))
    return boost(x, *np.array([c[len(names) :] for c in cells], float).reshape(len(cells), 4).T)


def verdicts(model: tuple[float, list, float]) -> str:
    """A 1 or 0 for every cell of the features, in the order of ``cell_of``: whether the trees' sum reaches the threshold."""
    start, trees, threshold = model
    x = np.stack(np.unravel_index(np.arange(math.prod(BINS.values())), tuple(BINS.values())), axis=1)
    score = np.full(len(x), start)
    for tree in trees:
        score = score + RATE * np.clip(_value(tree, x), -4, 4)
    return "".join("1" if v else "0" for v in (score >= threshold).tolist())


def cell_of(c: Column) -> Column:
    """The number of a candidate's cell."""
    at = F.lit(0)
    for name, n in BINS.items():
        at = at * n + c[name]
    return at


SPAN = "struct<start:int,kind:int,stop:int>"


def outside(chosen: str, base: str) -> Column:
    """The chosen spans that overlap no base span and no earlier one of themselves; both sorted. Each pass is linear."""
    own = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))
    marked = lambda spans, mine: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    entry = "struct<start:int,mine:boolean,kind:int,stop:int>"
    both = F.array_sort(F.concat(marked(F.col(base), False), marked(F.col(chosen), True)))
    whole = lambda x: F.struct(x["start"].alias("start"), x["mine"].alias("mine"), x["kind"].alias("kind"), x["stop"].alias("stop"))

    def swept(spans: Column, kind: str, out: Callable[[Column], Column], first: int, keeps: Callable, moves: Callable) -> Column:
        none, add, finished = grown(kind, out)
        step = lambda a, x: F.struct(moves(a["edge"], x).alias("edge"), F.when(keeps(a["edge"], x), add(a["out"], x)).otherwise(a["out"]).alias("out"))
        return F.aggregate(spans, F.struct(F.lit(first).alias("edge"), none.alias("out")), step, lambda a: finished(a["out"]))

    # from the left: what a base span that begins before it covers; from the right: what one that begins after it cuts
    left = swept(both, entry, whole, 0, lambda edge, x: ~x["mine"] | (x["start"] >= edge), lambda edge, x: F.when(x["mine"], edge).otherwise(F.greatest(edge, x["stop"])))
    right = swept(F.reverse(left), SPAN, own, 2**31 - 1, lambda edge, x: x["mine"] & (x["stop"] <= edge), lambda edge, x: F.when(x["mine"], edge).otherwise(x["start"]))
    return swept(F.reverse(right), SPAN, own, 0, lambda edge, x: x["start"] >= edge, lambda edge, x: F.when(x["start"] >= edge, x["stop"]).otherwise(edge))


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["stop"])), ",")


def detect(docs: DataFrame, text: str = "text", model: tuple[float, list, float] | None = None) -> DataFrame:
    """``docs`` with base counts per kind, ``base_spans``, ``spans`` (both as text) and ``n_spans``.

    The model is fitted to the candidates of ``docs`` unless one is given.
    """
    if model is None:
        model = fit(candidates(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    found = candidates(base_spans(docs, text))
    table = F.lit(verdicts(model))
    picked = F.filter("_candidates", lambda c: F.substr(table, cell_of(c) + 1, F.lit(1)) == "1")
    found = found.withColumn("_chosen", F.array_sort(F.transform(picked, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))))
    apart = F.when(F.size("_chosen") > 0, outside("_chosen", "_base")).otherwise(F.array().cast(f"array<{SPAN}>"))
    counts = {f"n_{kind}": F.size(F.filter("_base", partial(_is_kind, KINDS.index(kind)))).cast("long") for kind in BASE}
    found = found.withColumn("_spans", F.array_sort(F.concat("_base", apart))).withColumns(counts)
    made = found.withColumns({"base_spans": joined("_base"), "spans": joined("_spans"), "n_spans": F.size("_spans").cast("long")})
    return made.drop("_text", "_base", "_candidates", "_chosen", "_spans")
