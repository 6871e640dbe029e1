import pytest
from pyspark.sql import functions as F

from strandjoin.functions import cutoffs, scoring, sequence
from strandjoin.functions.scoring import BaseFrequencies, ScoreTable
from strandjoin.operators import frequencies
from strandjoin.plans.params import MergeParams, memory_bytes, parse_args, usage
from strandjoin.plans import report
from strandjoin.sources import fastq


def test_cutoffs_have_the_published_values():
    rows = (1, 5, 10, 15, 20, 25, 30, 40, 50, 99)
    assert [cutoffs.cutoff(0.05, m, 0.25) for m in rows] == [4, 4, 3, 2, 1, 0, -2, -4, -8, -25]
    assert [cutoffs.cutoff(0.01, m, 0.25) for m in rows] == [5, 5, 5, 4, 4, 2, 1, -1, -4, -20]
    assert [min(m for m in range(1, 100) if cutoffs.column(p, 25)[m] < 0) for p in (0.05, 0.01, 0.001, 0.0001)] == [27, 37, 53, 68]
    assert cutoffs.cutoff(1.0, 10, 0.25) is None and cutoffs.column(0.05, 30)[0] == 99
    assert cutoffs.cutoff(0.05, 500, 0.25) == cutoffs.cutoff(0.05, 99, 0.25) and cutoffs.q_bucket(0.2) == 25 and cutoffs.q_bucket(0.9) == 49


def test_column_and_table_scores_agree(spark):
    freqs = BaseFrequencies(0, 0, 0, 0, 0, 0, 0.3, 0.2, 0.15, 0.35, 0.275)
    letters = "ACGTNacnR"
    rows = [(x, y, qx, qy) for x in letters for y in letters for qx in (2, 17, 40) for qy in (0, 30)]
    df = spark.createDataFrame(rows, "x string, y string, qx int, qy int")
    for method in (1, 2, 3):
        table = ScoreTable(method, freqs, 33)
        ex, ey = F.pow(F.lit(10.0), -F.col("qx") / 10.0), F.pow(F.lit(10.0), -F.col("qy") / 10.0)
        score, oes = scoring.pair_score(F.col("x"), F.col("y"), ex, ey, method, freqs)
        import numpy as np

        for r in df.withColumn("s", score).withColumn("o", oes).collect():
            x, y = np.array([[ord(r["x"])]]), np.array([[ord(r["y"])]])
            a, b = table.codes(x, np.array([[r["qx"] + 33]])), table.codes(y, np.array([[r["qy"] + 33]]))
            assert table.lookup(table.score, a, b, x, y)[0, 0] == pytest.approx(r["s"], abs=1e-12)
            assert table.lookup(table.oes, a, b, x, y)[0, 0] == pytest.approx(r["o"], abs=1e-12)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACgtNR", "#I"), ("", ""), (None, None)], "s string, q string")
    got = df.select(sequence.reverse_complement("s").alias("rc"), sequence.uncalled("s").alias("n"), sequence.uncalled_ratio("s").alias("r"), sequence.suffix_from("s", 2).alias("e"), sequence.capped("q", 20).alias("c"), sequence.characters("s").alias("a")).collect()
    assert tuple(got[0]) == ("RNACGT", 1, 1 / 6, "gtNR", "#5", list("ACgtNR"))
    assert tuple(got[1]) == ("", 0, None, "", "", []) and got[2]["rc"] is None
    sequence.register(spark)
    assert spark.sql("SELECT dna_reverse_complement('AACG'), dna_uncalled('NnA'), phred_quality('I', 33)").first()[:] == ("CGTT", 2, 40)


def test_base_frequencies(spark):
    df = spark.createDataFrame([("AaCN", "GT"), (None, "n")], "f_seq string, r_seq string")
    row = frequencies.base_frequencies(df, "f_seq", "r_seq").first()
    assert tuple(row)[:6] == (2, 1, 1, 1, 2, 5) and row["pa"] == 0.4
    with pytest.warns(UserWarning):
        assert frequencies.collect_frequencies(spark.createDataFrame([("AAA", "A")], "f_seq string, r_seq string")) == BaseFrequencies.uniform()
    with pytest.warns(UserWarning):
        frequencies.collect_frequencies(spark.createDataFrame([], "f_seq string, r_seq string"))


def test_options():
    run = parse_args(["-f", "a.fq", "--reverse-fastq=b.fq", "-o", "out", "-p", "0.001", "-e", "-c", "30", "--quality-theshold", "9", "-v12"])
    assert (run.left, run.right, run.output) == ("a.fq", "b.fq", "out")
    assert run.params == MergeParams(p_value=0.001, empirical_freqs=False, cap=30, quality_threshold=9, min_overlap=12)
    for bad in (["-f", "a"], ["-x", "1"], ["-f", "a", "-r", "b", "-o", "c", "-p", "0.1"], ["-f", "a", "-r", "b", "-o", "c", "-u", "2"], ["-f"], ["-f", "a", "-r", "b", "-o", "c", "-j", "0"]):
        with pytest.raises(ValueError):
            parse_args(bad)
    assert memory_bytes("2K") == 2048 and parse_args(["-h"]).help and "--p-value" in usage() and "(default 0.01)" in usage() and "(required)" in usage()
    for field, value in (("min_overlap", 0), ("test_method", 3), ("score_method", 0), ("cap", -1), ("compat", "x"), ("on_count_mismatch", "x")):
        with pytest.raises(ValueError):
            MergeParams(**{field: value})


def test_report(spark):
    df = spark.createDataFrame([("assembled",)] * 2 + [("discarded",)], "status string")
    counts = report.disposition_counts(df)
    assert {tuple(r) for r in counts.collect()} == {("assembled", 2, 66.667), ("discarded", 1, 33.333), ("unassembled", 0, 0.0)}
    lines = [r["line"] for r in report.report_lines(counts, fastq.output_names("out")).orderBy("n").collect()]
    assert lines[0] == "Assembled reads ...................: 2 / 3 (66.667%)" and lines[2] == "Not assembled reads ...............: 0 / 3 (0.000%)"
    assert len(lines) == 7 and lines[4] == "Discarded reads file...............: out.discarded.fastq" and report.report_lines(counts).count() == 3
    assert report.disposition_counts(df.where("false")).where("n <> 0 OR pct <> 0").isEmpty()
    assert spark.range(1).select(report.thousands(F.lit(1234567))).first()[0] == "1,234,567"
