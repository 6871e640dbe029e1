"""Times the headline queries and prints one JSON line.

``merge_150`` and ``merge_250`` merge reads of 150 and 250 bases, one pair for each customer: the work of a pair grows
with the product of its lengths.

BENCH_SF_DIR names the tables and BENCH_CPUS the threads.  Each query runs once to warm up and then
BENCH_RUNS times; the median counts.  Results are written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strandjoin.operators import frequencies, merge, overlap
from strandjoin.plans import queries as engine
from strandjoin.plans.params import MergeParams
from strandjoin.sources import fastq

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def long_pairs(spark: SparkSession, n: int):
    """Pairs of reads of ``n`` bases of a fragment of 1.4 n, or of 0.8 n for each tenth customer."""
    letters = lambda tag, k: "translate(concat(" + ", ".join(f"md5(concat(k, '{tag}{i}'))" for i in range(-(-k // 32))) + "), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    quality = lambda tag: letters(tag, n).replace("'ACGTACGTACGTACGT'", "'#%(+.147:=@BDFHI'")
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"substr({letters('a', 2 * n)}, 1, IF(k % 10 = 0, {n * 8 // 10}, {n * 14 // 10})) AS frag")
    return df.selectExpr(
        "k AS row_id", "concat('@read', k, '/1') AS f_header", f"substr(concat(frag, {letters('t', n)}), 1, {n}) AS f_seq", f"substr({quality('q')}, 1, {n}) AS f_qual",
        "concat('@read', k, '/2') AS r_header", f"substr(concat(translate(reverse(frag), 'ACGT', 'TGCA'), {letters('u', n)}), 1, {n}) AS r_seq", f"substr({quality('s')}, 1, {n}) AS r_qual",
    )


def headline(spark: SparkSession) -> dict:
    """Queries over the pairs derived from every order (150,000 at scale 0.1)."""
    pairs = engine.pairs(spark, SF_DIR, "orders", "o_orderkey").repartition(int(CPUS)).cache()
    pairs.count()
    params = MergeParams()
    uniform = MergeParams(empirical_freqs=False)
    longer = {n: long_pairs(spark, n).repartition(int(CPUS)).cache() for n in (150, 250)}
    ready = overlap.prepared(pairs, uniform)
    return {
        "base_frequencies": lambda: frequencies.base_frequencies(pairs, "f_seq", "r_seq"),
        "best_overlap": lambda: overlap.best_overlap(ready, uniform, engine.UNIFORM),
        "merge": lambda: merge.merge_pairs(pairs, params),
        "output_records": lambda: fastq.output_records(merge.merge_pairs(pairs, params))["assembled"],
        "pair_lines": lambda: fastq.pair_lines(engine._lines(pairs, "f"), engine._lines(pairs, "r")),
        **{f"merge_{n}": (lambda df: lambda: merge.merge_pairs(df, params))(df) for n, df in longer.items()},
        "report": lambda: engine.report.disposition_counts(merge.merge_pairs(pairs, params)),
    }


def timed(make) -> float:
    def once() -> float:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        return time.time() - began

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    spark = session()
    took = {name: timed(make) for name, make in headline(spark).items()}
    pairs = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "pairs": pairs, "merged_pairs_per_second": round(pairs / took["merge"])}))
    spark.stop()


if __name__ == "__main__":
    main()
