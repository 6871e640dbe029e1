"""Critical values of the observed expected score, in closed form.

For an overlap of n bases, each equal by chance with probability q, the score is 2K - n with K binomial.
A cutoff bounds the chance that any overlap from the least allowed one up to the longest considered,
on either side, reaches a higher score.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log

import numpy as np

LONGEST = 199  # the largest overlap in the product
ROWS = 99  # overlaps above are tested as this one
ALWAYS = 99  # a score no short overlap reaches


def _log_cdf(n: int, q: float) -> np.ndarray:
    """log Pr[K <= k] for k = 0..n."""
    k = np.arange(n + 1)
    choose = lgamma(n + 1) - np.array([lgamma(x + 1) + lgamma(n - x + 1) for x in k])
    pmf = np.exp(choose + k * log(q) + (n - k) * log(1 - q))
    return np.log(np.minimum(np.cumsum(pmf), 1.0))


@lru_cache(maxsize=256)
def column(p_value: float, bucket: int) -> tuple[int, ...]:
    """Cutoffs for overlaps 0..ROWS at q = bucket / 100."""
    q = bucket / 100
    t = np.arange(-LONGEST, LONGEST + 1)
    total = np.zeros(len(t))  # log of the product from n = LONGEST down
    out = [ALWAYS] * (ROWS + 1)
    for n in range(LONGEST, 0, -1):
        k = (t + n) // 2  # the largest k with 2k - n <= t
        cdf = _log_cdf(n, q)
        total = total + np.where(k < 0, -np.inf, cdf[np.clip(k, 0, n)])
        if n <= ROWS:
            ok = 1 - np.exp(2 * total) <= p_value + 1e-12
            out[n] = int(t[np.argmax(ok)])
    return tuple(out)


def q_bucket(q: float) -> int:
    """The table column of a chance of equality: truncated, at most 0.49, and at least the uniform 0.25."""
    return max(25, int(min(q, 0.49) * 100))


def cutoff(p_value: float, overlap: int, q: float) -> int | None:
    """The score to exceed, or None if p_value switches the test off."""
    return None if p_value == 1.0 else column(p_value, q_bucket(q))[min(overlap, ROWS)]
