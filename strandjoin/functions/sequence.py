"""Scalar functions on bases and qualities."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGTacgt", "TGCATGCA"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reversed_text(c: Column | str) -> Column:
    return F.reverse(as_column(c))


def complement(c: Column | str) -> Column:
    """A-T and C-G; lower case becomes upper, everything else stays."""
    return F.translate(as_column(c), BASES, COMPLEMENTS)


def reverse_complement(c: Column | str) -> Column:
    return complement(reversed_text(c))


def at(c: Column | str, i: Column | int) -> Column:
    """The character at a position from 0."""
    return F.substring(as_column(c), (i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(1))


def phred(c: Column | str, base: int = 33) -> Column:
    """The quality of one character."""
    return F.ascii(as_column(c)) - base


def error_probability(c: Column | str, base: int = 33) -> Column:
    return F.pow(F.lit(10.0), -phred(c, base) / 10.0)


def length(c: Column | str) -> Column:
    return F.length(as_column(c))


def uncalled(c: Column | str) -> Column:
    """Number of N or n."""
    c = as_column(c)
    return F.length(c) - F.length(F.translate(c, "Nn", ""))


def uncalled_ratio(c: Column | str) -> Column:
    """Share of N or n; null for an empty text."""
    c = as_column(c)
    return uncalled(c) / F.nullif(F.length(c), F.lit(0))


def prefix(c: Column | str, n: Column | int) -> Column:
    return F.substring(as_column(c), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def suffix_from(c: Column | str, i: Column | int) -> Column:
    """What stands from position ``i`` (from 0) to the end."""
    c = as_column(c)
    return F.substring(c, (F.lit(i) if isinstance(i, int) else i) + 1, F.length(c))


def characters(c: Column | str) -> Column:
    """The characters as an array; empty for an empty text."""
    c = as_column(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def capped(c: Column | str, cap: int, base: int = 33) -> Column:
    """Quality text with every quality above ``cap`` set to it; 0 leaves it."""
    c = as_column(c)
    if not cap:
        return c
    high = "".join(map(chr, range(cap + base + 1, 127)))
    return F.translate(c, high, chr(cap + base) * len(high)) if high else c


# The functions that SQL text can call, as SQL.
SQL_FUNCTIONS = {
    "dna_complement(s STRING) RETURNS STRING": "translate(s, 'ACGTacgt', 'TGCATGCA')",
    "dna_reverse_complement(s STRING) RETURNS STRING": "translate(reverse(s), 'ACGTacgt', 'TGCATGCA')",
    "dna_uncalled(s STRING) RETURNS INT": "length(s) - length(translate(s, 'Nn', ''))",
    "phred_quality(c STRING, base INT) RETURNS INT": "ascii(c) - base",
    "phred_error(c STRING, base INT) RETURNS DOUBLE": "pow(10D, -(ascii(c) - base) / 10D)",
}


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from ``spark.sql``."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
