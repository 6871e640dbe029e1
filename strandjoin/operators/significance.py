"""Predicates on a found overlap: the significance test and the gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cutoffs, sequence
from ..plans.params import MergeParams


def test_row(params: MergeParams) -> Column:
    """The overlap that test 2 looks up."""
    if params.compat == "documented":
        return F.col("overlap")
    n_f, n_r, d = F.length("f_seq"), F.length("r_seq"), F.col("d")
    inside = (n_f > n_r) & (d >= 0) & (d < n_f - n_r)  # the second read ends inside the first
    around = (n_r > n_f) & (d < 0) & (d >= n_f - n_r)  # the first read lies inside the second
    return F.when(inside, d).when(around, n_r - n_f + d).otherwise(F.col("overlap"))


def significant(params: MergeParams, q: float) -> Column:
    """The observed expected score exceeds the cutoff; always true for a p-value of 1."""
    if params.p_value == 1.0:
        return F.lit(True)
    table = cutoffs.column(params.p_value, cutoffs.q_bucket(q))
    if params.test_method == 1:
        return F.col("oes") > F.lit(table[min(params.min_overlap, cutoffs.ROWS)])
    return F.col("oes") > F.get(F.array(*map(F.lit, table)), F.least(test_row(params), F.lit(cutoffs.ROWS)))


def long_enough(params: MergeParams) -> Column:
    return F.col("overlap") >= params.min_overlap


def length_in_range(params: MergeParams) -> Column:
    ok = F.col("asm_len") >= params.min_asm_len
    return ok if params.max_asm_len is None else ok & (F.col("asm_len") <= params.max_asm_len)


def called_enough(params: MergeParams) -> Column:
    return sequence.uncalled("m_seq") <= params.max_uncalled * F.col("asm_len")
