"""The whole merge of a pair table: overlap, test, gates, consensus, trimming and routing.

Everything after the base frequencies is one narrow pass over the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.scoring import BaseFrequencies
from ..plans.params import MergeParams
from . import frequencies, overlap, significance

ASSEMBLED, UNASSEMBLED, DISCARDED = "assembled", "unassembled", "discarded"


def route(found: DataFrame, params: MergeParams, q: float) -> DataFrame:
    """Adds status and reason to assembled pairs, and the reads as they are written: trimmed only if the pair was not merged.

    A first read that is too short ends the matter, so the second one is then written untrimmed.
    """
    have = F.col("d").isNotNull()
    tests = (
        (have, "no overlap scores above 0"),
        (significance.significant(params, q), "overlap not significant"),
        (significance.long_enough(params), "overlap too short"),
        (significance.length_in_range(params), "merged length out of range"),
        (significance.called_enough(params), "too many uncalled bases"),
    )
    why = F.lit(None).cast("string")
    for ok, reason in reversed(tests):
        why = F.when(~ok, F.lit(reason)).otherwise(why)
    out = found.withColumn("reason", why)
    failed = F.col("reason").isNotNull()
    short = F.col("f_keep") < params.min_trim_len
    out = out.withColumns({
        "f_out": F.when(failed, sequence.prefix("f_seq", F.col("f_keep"))),
        "f_out_qual": F.when(failed, sequence.prefix("f_qual", F.col("f_keep"))),
        "r_out": F.when(failed & short, F.col("r_seq")).when(failed, sequence.suffix_from("r_seq", F.col("r_from"))),
        "r_out_qual": F.when(failed & short, F.col("r_qual")).when(failed, sequence.suffix_from("r_qual", F.col("r_from"))),
    })
    ratio = lambda c: F.coalesce(sequence.uncalled_ratio(c), F.lit(0.0))
    bad = F.when(short, "forward read too short").when(F.length("r_out") < params.min_trim_len, "reverse read too short")
    bad = bad.when(ratio("f_out") >= params.max_uncalled, "forward read uncalled").when(ratio("r_out") >= params.max_uncalled, "reverse read uncalled")
    out = out.withColumn("_bad", F.when(failed, bad))
    status = F.when(~failed, ASSEMBLED).when(F.col("_bad").isNotNull(), DISCARDED).otherwise(UNASSEMBLED)
    cap = lambda c: sequence.capped(c, params.cap, params.phred_base)
    ok = ~failed
    return out.select(
        "row_id", "f_header", "r_header", status.alias("status"), F.concat_ws("; ", "reason", "_bad").alias("reason"),
        F.when(ok, F.col("m_seq")).alias("seq"), F.when(ok, cap("m_qual")).alias("qual"),
        F.col("f_out").alias("f_seq"), cap("f_out_qual").alias("f_qual"), F.col("r_out").alias("r_seq"), cap("r_out_qual").alias("r_qual"),
        "d", "overlap", "asm_len", "score", "oes",
    )


def merge_pairs(pairs: DataFrame, params: MergeParams | None = None, freqs: BaseFrequencies | None = None, engine: str = "arrow") -> DataFrame:
    """One row for each pair (row_id, f_header, f_seq, f_qual, r_header, r_seq, r_qual).

    freqs: base frequencies; if None they are aggregated from the pairs, or uniform if the options say so.
    Unmerged second reads stay reverse-complemented unless ``restore_reverse`` is set.
    """
    params = params or MergeParams()
    freqs = freqs or frequencies.collect_frequencies(pairs, params.empirical_freqs)
    ready = overlap.prepared(pairs.select("row_id", "f_header", "f_seq", "f_qual", "r_header", "r_seq", "r_qual"), params)
    out = route(overlap.assembled(ready, params, freqs, engine), params, freqs.q)
    if params.restore_reverse:
        out = out.withColumns({"r_seq": sequence.reverse_complement("r_seq"), "r_qual": F.reverse("r_qual")})
    return out
