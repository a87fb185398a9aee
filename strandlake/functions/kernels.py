"""Exact tests on counts and samples, vectorised over many loci with numpy."""

from __future__ import annotations

import math

import numpy as np

from strandlake.functions.memo import memo

#: Outcomes of hypergeometric supports that are laid out at once.
LAID_OUT = 2_000_000
TABLE = 1 << 16


@memo(1)
def _table() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, TABLE)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!, by a table and, beyond it, Stirling's series."""
    n = np.asarray(n, np.int64)
    small = _table()[np.minimum(n, TABLE - 1)]
    if not (n >= TABLE).any():
        return small
    x = n + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < TABLE, small, series)


def _support(q, m, n, k):
    """(locus, outcome, log probability) over all loci's supports."""
    low, high = np.maximum(0, k - n), np.minimum(m, k)
    size = high - low + 1
    locus = np.repeat(np.arange(len(q)), size)
    x = np.arange(len(locus)) - np.repeat(np.cumsum(size) - size - low, size)
    whole = log_factorial(m) + log_factorial(n) - log_factorial(m + n) + log_factorial(k) + log_factorial(m + n - k)
    mm, nn, kk = m[locus], n[locus], k[locus]
    lp = whole[locus] - log_factorial(x) - log_factorial(mm - x) - log_factorial(kk - x) - log_factorial(nn - kk + x)
    return locus, x, lp


def _in_parts(test, q, m, n, k) -> np.ndarray:
    q, m, n, k = (np.asarray(v, np.int64) for v in (q, m, n, k))
    size = np.cumsum(np.minimum(m, k) - np.maximum(0, k - n) + 1)
    out, at = np.empty(len(q)), 0
    while at < len(q):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + LAID_OUT)))
        out[at:to] = test(q[at:to], m[at:to], n[at:to], k[at:to])
        at = to
    return out


def _mid_p(q, m, n, k):
    locus, x, lp = _support(q, m, n, k)
    p, here = np.exp(lp), q[locus]
    half = 0.5 * np.bincount(locus, p * (x == here), len(q))
    right, left = np.bincount(locus, p * (x > here), len(q)), np.bincount(locus, p * (x < here), len(q))
    return 2 * np.minimum(right + half, left + half)


def mid_p(q, m, n, k) -> np.ndarray:
    """Twice the smaller mid-p tail of q successes among k draws from m and n."""
    return _in_parts(_mid_p, q, m, n, k)


def _two_sided(q, m, n, k):
    locus, x, lp = _support(q, m, n, k)
    seen = np.zeros(len(q))
    seen[locus[x == q[locus]]] = lp[x == q[locus]]
    as_far = lp <= seen[locus] + math.log1p(1e-7)
    return np.minimum(1.0, np.bincount(locus, np.exp(lp) * as_far, len(q)))


def fisher_exact(q, m, n, k) -> np.ndarray:
    """Sum of the probabilities that are no larger than the observed one's."""
    return _in_parts(_two_sided, q, m, n, k)


def log_likelihood_ratio(case_mod, case_other, control_mod, control_other) -> tuple[np.ndarray, np.ndarray]:
    """(G, p) of the likelihood-ratio test of one rate against two, with one degree of freedom."""
    table = np.array([case_mod, case_other, control_mod, control_other], float)
    total = table.sum(axis=0)
    rows, columns = (table[0] + table[1], table[2] + table[3]), (table[0] + table[2], table[1] + table[3])
    g = np.zeros(table.shape[1])
    for cell, row, column in zip(table, (rows[0], rows[0], rows[1], rows[1]), (*columns, *columns), strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(cell > 0, 2 * cell * np.log(cell * total / (row * column)), 0.0)
    g = np.maximum(g, 0.0)
    p = np.array([math.erfc(math.sqrt(v / 2)) for v in g])
    empty = (rows[0] == 0) | (rows[1] == 0)
    return np.where(empty, 0.0, g), np.where(empty, 1.0, p)


@memo(4096)
def _rank_sum_counts(a: int, b: int) -> np.ndarray:
    """How many arrangements of a and b values give each rank-sum statistic."""
    counts = np.zeros(a * b + 1)
    counts[0] = 1.0
    for i in range(1, a + 1):  # the Gaussian binomial, by polynomial products and quotients
        top = counts.copy()
        top[b + i :] -= counts[: len(counts) - b - i]
        for s in range(i, len(top)):
            top[s] += top[s - i]
        counts = top
    return counts


def wilcoxon(x, y) -> float | None:
    """Two-sided rank-sum p-value: exact below 50 values a side without ties, else normal with both corrections."""
    x = [v for v in x if v is not None and math.isfinite(v)]
    y = [v for v in y if v is not None and math.isfinite(v)]
    if not x or not y:
        return None
    a, b = len(x), len(y)
    values = np.array([*x, *y], float)
    _, where, ties = np.unique(values, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(ties) - (ties - 1) / 2)[where]
    w = ranks[:a].sum() - a * (a + 1) / 2
    if a < 50 and b < 50 and (ties == 1).all():
        counts = _rank_sum_counts(a, b)
        tail = counts[: int(w) + 1].sum() if w <= a * b / 2 else counts[int(w) :].sum()
        return min(1.0, 2 * tail / counts.sum())
    n = a + b
    spread = math.sqrt(max(0.0, a * b / 12 * ((n + 1) - float(((ties.astype(float) ** 3) - ties).sum()) / (n * (n - 1)))))
    if spread == 0:
        return None
    z = w - a * b / 2
    z = (z - math.copysign(0.5, z) * (z != 0)) / spread
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))
