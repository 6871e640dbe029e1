"""Trimming of reads that were not merged, at two neighbouring low qualities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sequence


def _both_low(codes: np.ndarray, threshold: int, base: int) -> np.ndarray:
    """Whether positions k and k + 1 are both below the threshold."""
    low = codes.astype(np.int64) - base < threshold
    return low[:, :-1] & low[:, 1:]


def first_low_pair(codes: np.ndarray, threshold: int, base: int) -> np.ndarray:
    """Bases to keep of texts of equal length, as a matrix of codes: up to the first low pair."""
    both = _both_low(codes, threshold, base)
    return np.where(both.any(axis=1), both.argmax(axis=1) + 1, codes.shape[1]) if both.shape[1] else np.full(len(codes), codes.shape[1])


def last_low_pair(codes: np.ndarray, threshold: int, base: int) -> np.ndarray:
    """Where such texts start after trimming: at the last low pair."""
    both = _both_low(codes, threshold, base)
    return np.where(both.any(axis=1), both.shape[1] - both[:, ::-1].argmax(axis=1), 0) if both.shape[1] else np.zeros(len(codes), np.int64)


def _low_pairs(text: Column, threshold: int, base: int) -> Column:
    """Positions i (from 1) where i-1 and i are both below the threshold, in order."""
    low = F.transform(sequence.characters(text), lambda c: F.ascii(c) - base < threshold)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(low) - 1, F.lit(1))), lambda i: F.coalesce(F.get(low, i - 1) & F.get(low, i), F.lit(False)))


def forward_length(seq: Column, qual: Column, threshold: int, base: int, compat: str = "documented") -> Column:
    """Bases of the first read to keep: up to the first low pair.  compat 'reference' tests the letters."""
    tested = seq if compat == "reference" else qual
    if threshold <= 0 and compat != "reference":
        return F.length(seq)  # no valid quality is below 0
    return F.coalesce(F.get(_low_pairs(tested, threshold, base), F.lit(0)), F.length(seq)).cast("int")


def reverse_start(seq: Column, qual: Column, threshold: int, base: int) -> Column:
    """Where the reverse-complemented second read starts after trimming: at its last low pair."""
    if threshold <= 0:
        return F.lit(0)
    pairs = _low_pairs(qual, threshold, base)
    return F.coalesce(F.get(pairs, F.size(pairs) - 1), F.lit(0)).cast("int")
