"""Array columns: values that are computed once, and running sums and extremes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(xs: Column, zero: int, op) -> Column:
    """[zero, op(zero, x0), op(op(zero, x0), x1), ...] of an associative ``op`` with the neutral element ``zero``.

    Arrays grow by copying, so it is done in about sqrt(n) blocks of sqrt(n).
    """
    walk = lambda ys, first: F.aggregate(ys, F.array(first), lambda out, y: F.concat(out, F.array(op(F.element_at(out, -1), y))))

    def run(a: Column) -> Column:
        n = F.size(a)
        side = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), side), lambda i: F.slice(a, i + 1, side))

        def joined(b: Column) -> Column:
            before = walk(F.transform(b, lambda ys: F.aggregate(ys, F.lit(zero), op)), F.lit(zero))
            return let(before, lambda s: F.concat(F.flatten(F.zip_with(b, F.slice(s, 1, F.size(b)), lambda ys, first: F.slice(walk(ys, first), 1, F.size(ys)))), F.array(F.element_at(s, -1))))

        return let(blocks, joined)

    return let(xs, run)


def added(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)
