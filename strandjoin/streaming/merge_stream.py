"""Merging over Structured Streaming.

Everything after the base frequencies looks at one pair at a time, so a stream of pairs is merged with
frequencies given as a constant: measured on a batch of the same library, or uniform.  Streams of
single reads are paired by ``row_id`` with a stream-stream join, whose state is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BaseFrequencies
from ..operators import merge
from ..plans.params import MergeParams


def merge_stream(pairs: DataFrame, params: MergeParams | None = None, freqs: BaseFrequencies | None = None, engine: str = "arrow") -> DataFrame:
    """``merge_pairs`` of a stream of pairs; without state."""
    return merge.merge_pairs(pairs, params, freqs or BaseFrequencies.uniform(), engine)


def pair_streams(forward: DataFrame, reverse: DataFrame, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Pairs two streams of reads (row_id, header, seq, qual and a time) that arrive within ``late`` of each other."""
    named = lambda df, s: df.withWatermark(time_col, late).select(F.col("row_id").alias(f"{s}_row"), F.col(time_col).alias(f"{s}_ts"), *[F.col(c).alias(f"{s}_{c}") for c in ("header", "seq", "qual")])
    near = F.expr(f"f_row = r_row AND r_ts BETWEEN f_ts - INTERVAL {late} AND f_ts + INTERVAL {late}")
    return named(forward, "f").join(named(reverse, "r"), near).select(F.col("f_row").alias("row_id"), "f_header", "f_seq", "f_qual", "r_header", "r_seq", "r_qual")


def running_dispositions(result: DataFrame) -> DataFrame:
    """Counts by status, for an aggregate in complete or update mode."""
    return result.groupBy("status").count()
