import glob
import gzip
from dataclasses import replace

import pytest

from strandjoin.operators import merge
from strandjoin.plans import run as runs
from strandjoin.plans.params import MergeParams, parse_args
from strandjoin.sources import fastq
from strandjoin.streaming import merge_stream
from tests import slow_merge
from tests.test_merge import LOOSE, SCHEMA, random_pairs


def write(path, records, end="\n", newline="\n", opener=open):
    text = newline.join(f"{h}{newline}{s}{newline}+{newline}{q}" for h, s, q in records) + end
    with opener(path, "wb") as f:
        f.write(text.encode())
    return str(path)


def reads(n):
    return [(f"@read{i}", "ACGT" * (1 + i % 5), "IIII" * (1 + i % 5)) for i in range(n)]


def rows(df):
    return [tuple(r) for r in df.orderBy("row_id").collect()]


def want(n):
    return [(i, *r) for i, r in enumerate(reads(n))]


def test_numbers_records_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "a.fq", reads(3000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = fastq.read_fastq(spark, path)
        assert fastq.read_lines(spark, path).rdd.getNumPartitions() > 3
        assert rows(df) == want(3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("end, newline", [("", "\n"), ("\n\n\n", "\n"), ("\r\n", "\r\n")])
def test_line_ends(spark, tmp_path, end, newline):
    assert rows(fastq.read_fastq(spark, write(tmp_path / "a.fq", reads(7), end, newline))) == want(7)


def test_gzip_and_empty(spark, tmp_path):
    assert rows(fastq.read_fastq(spark, write(tmp_path / "a.fq.gz", reads(9), opener=gzip.open))) == want(9)
    (tmp_path / "e.fq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "e.fq")).count() == 0


@pytest.mark.parametrize("text", ["@a\n\n+\nII\n", "@a\nAC\n-\nII\n", "@a\nAC\n+\nI\n", "@a\nAC\n+\nII\n@b\nAC\n"])
def test_malformed_records_raise(spark, tmp_path, text):
    (tmp_path / "bad.fq").write_text(text)
    with pytest.raises(Exception, match="record"):
        fastq.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_pairing(spark, tmp_path):
    a, b = write(tmp_path / "a.fq", reads(12)), write(tmp_path / "b.fq", reads(10))
    with pytest.raises(Exception, match="more than their mates"):
        fastq.read_pairs(spark, a, b).collect()
    by_lines = rows(fastq.read_pairs(spark, a, b, "truncate"))
    by_reads = rows(fastq.pair_reads(fastq.read_fastq(spark, a), fastq.read_fastq(spark, b), "truncate"))
    assert by_lines == by_reads == [(i, *r, *r) for i, r in enumerate(reads(10))]
    assert tuple(fastq.validate_counts(fastq.read_fastq(spark, a), fastq.read_fastq(spark, b)).first()) == (12, 10, False)


def test_whole_run(spark, tmp_path):
    data = [r for r in random_pairs(60, 11) if r[2] and r[5]]
    a = write(tmp_path / "a.fq", [(r[1], r[2], r[3]) for r in data])
    b = write(tmp_path / "b.fq", [(r[4], r[5], r[6]) for r in data])
    out = str(tmp_path / "out")
    args = parse_args(["-f", a, "-r", b, "-o", out, "-e", "-n", "1", "-v", "3", "-p", "1.0"])
    counts = {r["status"]: r["n"] for r in runs.execute(spark, args, single_file=True).collect()}
    expected = {"assembled": [], "unassembled_forward": [], "unassembled_reverse": [], "discarded": []}
    seen = {"assembled": 0, "unassembled": 0, "discarded": 0}
    for _, h1, f, fq, h2, r, rq in data:
        status, seq, qual, fo, fqo, ro, rqo, _ = slow_merge.merge(f, fq, r, rq, LOOSE, {c: 0.25 for c in "ACGT"})
        seen[status] += 1
        one, two = (h1, fo, "+", fqo), (h2, ro, "+", rqo)
        if status == "assembled":
            expected["assembled"] += [h1, seq, "+", qual]
        elif status == "discarded":
            expected["discarded"] += [*one, *two]
        else:
            expected["unassembled_forward"] += one
            expected["unassembled_reverse"] += two
    assert counts == seen
    for key, folder in fastq.output_names(out).items():
        lines = [x for p in sorted(glob.glob(f"{folder}/part-*")) for x in open(p).read().split("\n")[:-1]]
        assert lines == expected[key], key


def test_simulated_fragments_have_their_true_length(spark):
    data = [r for r in random_pairs(400, 21) if len(r[2]) > 15]
    got = merge.merge_pairs(spark.createDataFrame(data, SCHEMA), replace(LOOSE, p_value=0.01, min_overlap=10))
    for r in got.where("status = 'assembled'").collect():
        assert len(r["seq"]) == r["asm_len"] == len(r["qual"])


def test_stream_gives_the_same_rows(spark, tmp_path):
    data = random_pairs(40, 31)
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = merge_stream.merge_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), LOOSE)
    query = stream.writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = merge.merge_pairs(df, LOOSE)
    assert sorted(map(str, spark.table("merged").collect())) == sorted(map(str, batch.collect()))


def test_streams_of_reads_are_paired(spark, tmp_path):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(i, f"@r{i}", "ACGT", "IIII") for i in range(5)], "row_id long, header string, seq string, qual string").withColumn("ts", F.timestamp_seconds(F.col("row_id") + 1_000_000))
    one.write.parquet(str(tmp_path / "f"))
    one.where("row_id < 4").write.parquet(str(tmp_path / "r"))
    read = lambda p: spark.readStream.schema(one.schema).parquet(str(tmp_path / p))
    query = merge_stream.pair_streams(read("f"), read("r")).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["row_id"] for r in spark.table("paired").collect()) == [0, 1, 2, 3]


def test_default_options_are_the_documented_ones():
    assert MergeParams().describe()[:3] == [("p_value", "0.01"), ("min_overlap", "10"), ("max_asm_len", "999999")]
