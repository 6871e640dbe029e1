"""The quality-aware score of one pair of bases, as a column and as a table.

With error probabilities ex, ey and base frequencies p, q the sum of their squares:

* match of X: (1-ex)(1-ey) + ex ey (q - pX^2) / (1-pX)^2
* mismatch of X and Y: 1 - (1-ey) ex pY/(1-pX) - (1-ex) ey pX/(1-pY) - ex ey (q-pX^2-pY^2)/(1-pX-pY)^2

Methods: 1 scores the expected value, 2 the probability, 3 counts +1 and -1; the observed expected score
is the same for all.  Only upper-case letters are bases; an N on either side has its own value, and any
other pair scores nothing (method 3: +1 or -1).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"


class BaseFrequencies(NamedTuple):
    """Counts of called bases and of N, their shares, and the sum of squared shares."""

    freqa: int
    freqc: int
    freqg: int
    freqt: int
    freqn: int
    total: int
    pa: float
    pc: float
    pg: float
    pt: float
    q: float

    @property
    def shares(self) -> tuple[float, float, float, float]:
        return self.pa, self.pc, self.pg, self.pt

    @classmethod
    def uniform(cls) -> BaseFrequencies:
        return cls(0, 0, 0, 0, 0, 0, 0.25, 0.25, 0.25, 0.25, 0.25)

    @property
    def usable(self) -> bool:
        """Two bases that are all there is, or one, leave the mismatch model without a denominator."""
        p = self.shares
        return all(x == x and 1 - x > 1e-12 for x in p) and all(1 - p[i] - p[j] > 1e-12 for i in range(4) for j in range(i))


def match_value(ex, ey, px, q: float):
    return (1 - ex) * (1 - ey) + ex * ey * (q - px * px) / ((1 - px) * (1 - px))


def mismatch_value(ex, ey, px, py, q: float):
    return 1 - (1 - ey) * ex * py / (1 - px) - (1 - ex) * ey * px / (1 - py) - ex * ey * (q - px * px - py * py) / ((1 - px - py) * (1 - px - py))


def _score(kind: str, value, oes, method: int):
    """The score of a pair, from its kind, probability and observed expected score."""
    if method == 1:
        return oes
    if method == 2:
        return value if kind == "match" else -value
    return 1.0 if kind == "match" else -1.0


def share(x: Column, freqs: BaseFrequencies) -> Column:
    """The frequency of a base; null for any other letter."""
    out = F.when(x == LETTERS[0], F.lit(freqs.pa))
    for letter, p in zip(LETTERS[1:], freqs.shares[1:], strict=True):
        out = out.when(x == letter, F.lit(p))
    return out


def pair_score(x: Column, y: Column, ex: Column, ey: Column, method: int, freqs: BaseFrequencies, px: Column | None = None, py: Column | None = None) -> tuple[Column, Column]:
    """(score, oes) of letters x, y with error probabilities ex, ey; px, py: their shares, if at hand."""
    px = share(x, freqs) if px is None else px
    py = share(y, freqs) if py is None else py
    eq, neq = match_value(ex, ey, px, freqs.q), mismatch_value(ex, ey, px, py, freqs.q)
    is_n, odd, same = (x == "N") | (y == "N"), px.isNull() | py.isNull(), x == y
    oes = F.when(is_n, F.lit(2 * freqs.q - 1)).when(odd, F.lit(0.0)).when(same, 2 * eq - 1).otherwise(1 - 2 * neq)
    if method == 1:
        return oes, oes
    if method == 2:
        return F.when(is_n, F.lit(freqs.q - 1)).when(odd, F.lit(0.0)).when(same, eq).otherwise(-neq), oes
    return F.when(~is_n & same, F.lit(1.0)).otherwise(F.lit(-1.0)), oes


class ScoreTable:
    """(score, oes) by codes of (letter, quality) on either side, as flat arrays.

    Letters are A, C, G, T, N and others; equal other letters, which only method 3 tells apart, are corrected by
    ``lookup``.
    """

    QUALITIES, N_CODE, OTHER = 128, 4, 5

    def __init__(self, method: int, freqs: BaseFrequencies, base: int):
        self.method, self.base = method, base
        error = 10.0 ** (-(np.arange(self.QUALITIES) - base) / 10.0)
        ex, ey = error[:, None], error[None, :]
        n = self.QUALITIES
        self.width = 6 * n
        score, oes = np.zeros((self.width, self.width)), np.zeros((self.width, self.width))
        for i in range(6):
            for j in range(6):
                if self.N_CODE in (i, j):
                    e = 2 * freqs.q - 1
                    s = {1: e, 2: freqs.q - 1, 3: -1.0}[method]
                elif self.OTHER in (i, j):
                    s, e = -1.0 if method == 3 else 0.0, 0.0
                elif i == j:
                    v = match_value(ex, ey, freqs.shares[i], freqs.q)
                    e = 2 * v - 1
                    s = _score("match", v, e, method)
                else:
                    v = mismatch_value(ex, ey, freqs.shares[i], freqs.shares[j], freqs.q)
                    e = -(2 * v - 1)
                    s = _score("mismatch", v, e, method)
                score[i * n : (i + 1) * n, j * n : (j + 1) * n] = s
                oes[i * n : (i + 1) * n, j * n : (j + 1) * n] = e
        self.score, self.oes = score.ravel(), oes.ravel()
        self.letter = np.full(256, self.OTHER, dtype=np.intp)
        for i, c in enumerate("ACGTN"):
            self.letter[ord(c)] = i

    def codes(self, seq: np.ndarray, qual: np.ndarray) -> np.ndarray:
        return self.letter[np.minimum(seq, 255)] * self.QUALITIES + np.minimum(qual, self.QUALITIES - 1)

    def lookup(self, table: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values for codes a, b of letters x, y."""
        out = table.take(a * self.width + b)
        if self.method == 3 and table is self.score:
            same = (a >= self.OTHER * self.QUALITIES) & (x == y)
            if same.any():
                out = np.where(same, 1.0, out)
        return out
