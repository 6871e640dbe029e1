"""FASTQ files as tables, positional pairing, and FASTQ output.

Record numbers are made without a Python pass and without a shuffle of lines onto one task: each split of
a file knows its place (``_metadata``), one small aggregate counts the lines of each split, and a running
sum over splits turns a line's place within its split into its place in the file.  Both files of a pair are
then grouped by record number in one exchange, which assembles the records and pairs them at the same
time.  Compressed files are one split each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence
from ..plans.params import MergeParams

READ = "row_id long, header string, seq string, qual string"
BROADCAST_SPLITS = 1_000_000  # more rows of the table of splits (about 150 bytes each) are joined with a shuffle
PHASES = ("header", "seq", "plus", "qual")
# What is appended to the output prefix.
SUFFIXES = {
    "assembled": ".assembled.fastq",
    "unassembled_forward": ".unassembled.forward.fastq",
    "unassembled_reverse": ".unassembled.reverse.fastq",
    "discarded": ".discarded.fastq",
}


# ---- lines ----------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no long from 0, line string), files in order of their paths; blank lines at the end are left out."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
    )
    split = raw.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.max(F.when(F.trim("line") != "", F.col("_id"))).alias("_last"))
    order = Window.orderBy("_file", "_start")  # one row for each split
    split = split.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    split = split.withColumn("_end", F.max(F.col("_before") + F.col("_last") - F.col("_first")).over(Window.partitionBy()))
    split = split.select("_file", "_start", "_first", "_before", "_end")
    # Splits are packed into tasks, and none holds parts of two files.
    most = len(raw.inputFiles()) + raw.rdd.getNumPartitions()
    lines = raw.join(F.broadcast(split) if most <= BROADCAST_SPLITS else split, ["_file", "_start"])
    number = F.col("_before") + F.col("_id") - F.col("_first")
    return lines.where(number <= F.col("_end")).select(number.alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def checked(header: Column, seq: Column, plus: Column, qual: Column, row: Column) -> Column:
    """A condition that is true, or raises on a malformed record."""
    name = F.concat(F.lit("record "), row.cast("string"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    missing = empty(header) | empty(seq) | empty(qual) | plus.isNull() | ((F.length(plus) == 1) & (plus != "+"))
    error = F.when(missing, F.concat(name, F.lit(": entry is missing"))).when(F.length(seq) != F.length(qual), F.concat(name, F.lit(": sequence and quality differ in length")))
    return F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True)


def _phase(name: str, when: Column | None = None) -> Column:
    here = F.col("line_no") % 4 == PHASES.index(name)
    return F.max(F.when(here if when is None else here & when, F.col("line")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records from (line_no, line): ``row_id``, ``header``, ``seq``, ``qual``."""
    records = lines.groupBy(F.expr("line_no DIV 4").alias("row_id")).agg(*[_phase(p).alias(p) for p in PHASES])
    ok = checked(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"), F.col("row_id"))
    return records.where(ok).select("row_id", "header", "seq", "qual")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_lines(read_lines(spark, path))


# ---- pairs ----------------------------------------------------------------------------------------


def _agreed(paired: DataFrame, on_count_mismatch: str) -> DataFrame:
    """Pairs with both sides; a row of one side only raises, or is left out."""
    both = F.col("f_header").isNotNull() & F.col("r_header").isNotNull()
    if on_count_mismatch == "truncate":
        return paired.where(both)
    side = F.when(F.col("f_header").isNull(), "reverse").otherwise("forward")
    return paired.where(F.when(~both, F.raise_error(F.concat(F.lit("the "), side, F.lit(" reads are more than their mates"))).cast("boolean")).otherwise(True))


def pair_lines(forward: DataFrame, reverse: DataFrame, on_count_mismatch: str = "error") -> DataFrame:
    """Parses and pairs two files' lines in one exchange."""
    lines = forward.withColumn("_f", F.lit(True)).unionByName(reverse.withColumn("_f", F.lit(False)))
    sides = (("f", F.col("_f")), ("r", ~F.col("_f")))
    records = lines.groupBy(F.expr("line_no DIV 4").alias("row_id")).agg(*[_phase(p, here).alias(f"{s}_{p}") for s, here in sides for p in PHASES])
    for s, _ in sides:
        some = F.coalesce(*[F.col(f"{s}_{p}") for p in PHASES]).isNotNull()
        records = records.where(~some | checked(*[F.col(f"{s}_{p}") for p in PHASES], F.col("row_id")))
    return _agreed(records, on_count_mismatch).select("row_id", *[f"{s}_{p}" for s, _ in sides for p in PHASES if p != "plus"])


def pair_reads(forward: DataFrame, reverse: DataFrame, on_count_mismatch: str = "error") -> DataFrame:
    """Pairs tables of reads by ``row_id``."""
    named = lambda df, s: df.select("row_id", *[F.col(c).alias(f"{s}_{c}") for c in ("header", "seq", "qual")])
    return _agreed(named(forward, "f").join(named(reverse, "r"), "row_id", "full_outer"), on_count_mismatch)


def read_pairs(spark: SparkSession, forward: str | list[str], reverse: str | list[str], on_count_mismatch: str = "error") -> DataFrame:
    return pair_lines(read_lines(spark, forward), read_lines(spark, reverse), on_count_mismatch)


def validate_counts(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """One row: n_forward, n_reverse, and valid (both positive and equal)."""
    counts = forward.agg(F.count("*").alias("n_forward")).crossJoin(reverse.agg(F.count("*").alias("n_reverse")))  # one row each
    return counts.withColumn("valid", (F.col("n_forward") > 0) & (F.col("n_forward") == F.col("n_reverse")))


# ---- output ---------------------------------------------------------------------------------------


def output_names(prefix: str) -> dict[str, str]:
    return {k: prefix + v for k, v in SUFFIXES.items()}


def record(header: str, seq: str, qual: str) -> Column:
    """The four lines of a record; the text of the plus line is not kept."""
    return F.concat_ws("\n", F.col(header), F.col(seq), F.lit("+"), F.col(qual))


def output_records(result: DataFrame) -> dict[str, DataFrame]:
    """(row_id, side, record) for each output, from the rows of ``merge_pairs``.

    Discarded pairs are two records of one file, forward then reverse.
    """
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), record("f_header", "f_seq", "f_qual").alias("record")), F.struct(F.lit(1).alias("side"), record("r_header", "r_seq", "r_qual").alias("record"))))
    pick = lambda status: result.where(F.col("status") == status)
    one = lambda status, side, *c: pick(status).select("row_id", F.lit(side).alias("side"), record(*c).alias("record"))
    return {
        "assembled": one("assembled", 0, "f_header", "seq", "qual"),
        "unassembled_forward": one("unassembled", 0, "f_header", "f_seq", "f_qual"),
        "unassembled_reverse": one("unassembled", 1, "r_header", "r_seq", "r_qual"),
        "discarded": pick("discarded").select("row_id", both.alias("x")).select("row_id", "x.side", "x.record"),
    }


def write_outputs(result: DataFrame, prefix: str, mode: str = "errorifexists", single_file: bool = False) -> dict[str, str]:
    """Writes the four outputs in the order of the input: folders of ordered part files, or one part file each.

    The sort is by range, so parts follow one another and no task sees the whole output unless one file is asked for.
    """
    names = output_names(prefix)
    for key, rows in output_records(result).items():
        ordered = rows.orderBy("row_id", "side")
        if single_file:
            ordered = rows.coalesce(1).sortWithinPartitions("row_id", "side")
        ordered.select("record").write.mode(mode).text(names[key])
    return names


def capped_quality(qual: Column | str, params: MergeParams) -> Column:
    return sequence.capped(qual, params.cap, params.phred_base)
