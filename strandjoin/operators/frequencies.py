"""Base frequencies over all reads of both sides: one partial and final aggregate."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BaseFrequencies

COUNTS = (("freqa", "A"), ("freqc", "C"), ("freqg", "G"), ("freqt", "T"), ("freqn", "N"))


def _count(columns: list[str], letter: str) -> Column:
    text = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    each = [F.length(t) - F.length(F.translate(t, letter + letter.lower(), "")) for t in text]
    return F.coalesce(F.sum(sum(each[1:], each[0])), F.lit(0)).cast("long")


def base_counts(reads: DataFrame, *seq_columns: str) -> DataFrame:
    """One row: A, C, G, T and N of the given columns, in either case; other letters are not counted."""
    names = list(seq_columns or ("seq",))
    return reads.agg(*[_count(names, letter).alias(name) for name, letter in COUNTS])


def base_frequencies(reads: DataFrame, *seq_columns: str) -> DataFrame:
    """The counts with ``total`` (without N), the shares and their sum of squares; null shares if nothing is called."""
    out = base_counts(reads, *seq_columns)
    out = out.withColumn("total", sum((F.col(n) for n, _ in COUNTS[1:4]), F.col("freqa")))
    for name, source in (("pa", "freqa"), ("pc", "freqc"), ("pg", "freqg"), ("pt", "freqt")):
        out = out.withColumn(name, F.col(source) / F.nullif(F.col("total"), F.lit(0)))
    return out.withColumn("q", sum((F.col(p) * F.col(p) for p in ("pc", "pg", "pt")), F.col("pa") * F.col("pa")))


def collect_frequencies(pairs: DataFrame, empirical: bool = True) -> BaseFrequencies:
    """The frequencies of a pair table as a value; uniform if asked for, or where the model would have no denominator."""
    if not empirical:
        return BaseFrequencies.uniform()
    row = base_frequencies(pairs, "f_seq", "r_seq").first()
    freqs = BaseFrequencies(*[float("nan") if x is None else x for x in row])
    if not freqs.usable:
        warnings.warn("base frequencies are degenerate; uniform ones are used", stacklevel=2)
        return BaseFrequencies.uniform()
    return freqs
