"""Reports of a run: dispositions, options and base frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .params import MergeParams, Run

STATUSES = ("assembled", "discarded", "unassembled")


def disposition_counts(result: DataFrame) -> DataFrame:
    """(status, n, pct): each disposition's pairs and percentage, also where there are none."""
    aggs = [F.count(F.when(F.col("status") == s, True)).alias(s) for s in STATUSES]
    one = result.agg(F.count("*").alias("total"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES]))
    pct = F.coalesce(F.round(100.0 * F.col("x.n") / F.nullif(F.col("total"), F.lit(0)), 3), F.lit(0.0))
    return one.select("total", rows.alias("x")).select("x.status", F.col("x.n").cast("long").alias("n"), pct.alias("pct"))


def thousands(c: Column | str) -> Column:
    """A whole number with commas between triplets."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


# The lines of the run report, in order: a title, and the disposition it counts or the output it names.
COUNT_LINES = (
    ("Assembled reads ...................: ", "assembled"),
    ("Discarded reads ...................: ", "discarded"),
    ("Not assembled reads ...............: ", "unassembled"),
)
FILE_LINES = (
    ("Assembled reads file...............: ", "assembled"),
    ("Discarded reads file...............: ", "discarded"),
    ("Unassembled forward reads file.....: ", "unassembled_forward"),
    ("Unassembled reverse reads file.....: ", "unassembled_reverse"),
)


def report_lines(counts: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(n, line): the run report as text, in the order of ``n``; ``names`` are the outputs that it lists."""
    of = lambda c, status=None: F.coalesce(F.max(F.when(F.col("status") == status, F.col(c))) if status else F.sum(c), F.lit(0))
    one = counts.agg(of("n").alias("total"), *[of(c, s).alias(f"{c}_{s}") for _, s in COUNT_LINES for c in ("n", "pct")])
    lines = [F.concat(F.lit(title), thousands(f"n_{s}"), F.lit(" / "), thousands("total"), F.lit(" ("), F.format_string("%.3f", F.col(f"pct_{s}").cast("double")), F.lit("%)")) for title, s in COUNT_LINES]
    lines += [F.lit(title + names[key]) for title, key in FILE_LINES] if names else []
    return one.select(F.posexplode(F.array(*lines)).alias("n", "line")).select((F.col("n") + 1).alias("n"), "line")


def options_table(spark: SparkSession, options: MergeParams | Run) -> DataFrame:
    """(option, value) rows of the options that a run uses, with its files if a parsed command line is given."""
    files = [(k, getattr(options, k)) for k in ("left", "right", "output")] if isinstance(options, Run) else []
    params = options.params if isinstance(options, Run) else options
    rows = F.array(*[F.struct(F.lit(k).alias("option"), F.lit(v).alias("value")) for k, v in (*files, *params.describe())])
    return spark.range(1).select(F.inline(rows))


def frequency_lines(freqs: DataFrame) -> DataFrame:
    """(name, value): base frequencies and the number of uncalled bases, as text."""
    shares = [F.struct(F.lit(n).alias("name"), F.format_string("%f", c).alias("value")) for n, c in (("A", "pa"), ("C", "pc"), ("G", "pg"), ("T", "pt"))]
    return freqs.select(F.inline(F.array(*shares, F.struct(F.lit("uncalled").alias("name"), thousands("freqn").alias("value")))))
