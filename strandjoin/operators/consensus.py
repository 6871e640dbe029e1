"""The merged read: first read's start, consensus of the overlap, second read's end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..plans.params import MergeParams

HIGHEST = 126  # the last printable quality character


def matrices(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and qualities of the consensus, from the codes of letters x, y and qualities u, v of an overlap."""
    nx, ny, same = (x == 78) | (x == 110), (y == 78) | (y == 110), x == y  # N or n
    u, v = u.astype(np.int32), v.astype(np.int32)
    cases = [nx & ny, nx, ny, same]
    letter = np.select(cases, [np.full_like(x, 78), y, x, x], np.where(u > v, x, y))
    quality = np.select(cases, [np.minimum(u, v), v, u, u + v - base], np.maximum(u, v))
    return letter, np.clip(quality, 0, HIGHEST)


def _pair(x: Column, y: Column, qx: Column, qy: Column, base: int) -> Column:
    """Consensus of one position as (base, quality byte)."""
    nx, ny = x.isin("N", "n"), y.isin("N", "n")
    letter = F.when(nx & ny, F.lit("N")).when(nx, y).when(ny, x).when(x == y, x).when(qx > qy, x).otherwise(y)
    quality = F.when(nx & ny, F.least(qx, qy)).when(nx, qy).when(ny, qx).when(x == y, qx + qy - base).otherwise(F.greatest(qx, qy))
    return F.struct(letter.alias("b"), F.least(quality, F.lit(HIGHEST)).alias("q"))


def merged(found: DataFrame, params: MergeParams) -> DataFrame:
    """Adds ``m_seq`` and ``m_qual`` (null where no overlap was found), by column functions.

    ``found`` has f_seq, f_qual, r_seq, r_qual (reverse-complemented), d and overlap.
    """
    d, ol = F.col("d"), F.col("overlap")
    i, j = F.greatest(d, F.lit(0)), F.greatest(-d, F.lit(0))
    part = lambda c, at: sequence.characters(F.substring(F.col(c), at + 1, ol))
    zipped = F.arrays_zip(part("f_seq", i).alias("x"), part("r_seq", j).alias("y"), part("f_qual", i).alias("u"), part("r_qual", j).alias("v"))
    both = F.transform(zipped, lambda z: _pair(z["x"], z["y"], F.ascii(z["u"]), F.ascii(z["v"]), params.phred_base))
    out = found.withColumn("_c", both)
    text = lambda f: F.array_join(F.transform("_c", f), "")
    join = lambda a, middle, b: F.concat(F.substring(F.col(a), F.lit(1), i), middle, sequence.suffix_from(b, j + ol))
    m_seq = join("f_seq", text(lambda c: c["b"]), "r_seq")
    m_qual = join("f_qual", text(lambda c: F.chr(c["q"])), "r_qual")
    return out.withColumn("m_seq", m_seq).withColumn("m_qual", m_qual).drop("_c")
