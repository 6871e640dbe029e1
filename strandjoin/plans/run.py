"""A whole run: two FASTQ files in, four out, and a report."""

from __future__ import annotations

import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions.scoring import BaseFrequencies
from ..operators import frequencies, merge
from ..sources import fastq
from . import report
from .params import MergeParams, Run, parse_args, usage


def merge_files(spark: SparkSession, forward: str, reverse: str, params: MergeParams | None = None, engine: str = "arrow") -> DataFrame:
    """The merge of two files, as rows."""
    params = params or MergeParams()
    return merge.merge_pairs(fastq.read_pairs(spark, forward, reverse, params.on_count_mismatch), params, engine=engine)


def execute(spark: SparkSession, run: Run, mode: str = "errorifexists", single_file: bool = False) -> DataFrame:
    """Writes the outputs of a parsed command line and returns the disposition counts."""
    return _execute(spark, run, mode, single_file)[0]


def _execute(spark: SparkSession, run: Run, mode: str = "errorifexists", single_file: bool = False) -> tuple[DataFrame, BaseFrequencies]:
    pairs = fastq.read_pairs(spark, run.left, run.right, run.params.on_count_mismatch)
    freqs = frequencies.collect_frequencies(pairs, run.params.empirical_freqs)
    result = merge.merge_pairs(pairs, run.params, freqs).persist(StorageLevel.DISK_ONLY)  # six readers follow; what an executor loses is computed again
    try:
        fastq.write_outputs(result, run.output, mode, single_file)
        counts = report.disposition_counts(result).collect()
    finally:
        result.unpersist()
    return spark.createDataFrame([tuple(r) for r in counts], "status string, n long, pct double"), freqs


def main(argv: list[str] | None = None) -> int:
    run = parse_args(sys.argv[1:] if argv is None else argv)
    if run.help:
        print(usage())
        return 1
    spark = SparkSession.builder.appName("strandjoin").getOrCreate()
    for row in report.options_table(spark, run).collect():
        print(f"{row['option']}: {row['value']}")
    counts, freqs = _execute(spark, run)
    if run.params.empirical_freqs:
        for row in report.frequency_lines(spark.createDataFrame([freqs._asdict()])).collect():
            print(f"  {row['name']}: {row['value']}")
    for row in report.report_lines(counts, fastq.output_names(run.output)).orderBy("n").collect():
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
