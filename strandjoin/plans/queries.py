"""The registered queries of the merge engine and their SQL for another engine.

Reads are derived from the keys of the given tables with functions that both engines have (digests,
translate, reverse, substr), so both see the same pairs: overlapping ones, short fragments whose reads run
through into adapters, unrelated mates, N bases, lower-case reads and base changes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, sequence
from ..functions.scoring import BaseFrequencies
from ..operators import consensus, frequencies, merge, overlap, significance, trim
from ..shared import new_folder
from ..sources import fastq
from ..streaming import merge_stream
from . import report, run
from .params import MergeParams, parse_args

# ---- derived reads --------------------------------------------------------------------------------

_DNA = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_QUALITY = "'0123456789abcdef', '#%(+.147:=@BDFHI'"


def _digests(*tags: str) -> str:
    return "concat(" + ", ".join(f"md5(concat(k, '{t}'))" for t in tags) + ")"


#: Steps of (column, expression); ``k`` is the key.
STEPS = (
    {"flen": "CAST(CASE WHEN k % 10 = 0 THEN 30 + k % 8 ELSE 52 + k % 21 END AS INT)", "nf": "CAST(40 + k % 7 AS INT)", "nr": "CAST(38 + k % 5 AS INT)",
     "frag": f"translate({_digests('a', 'b', 'c')}, {_DNA})", "mate": f"CASE WHEN k % 9 = 4 THEN translate({_digests('x', 'y', 'z')}, {_DNA}) ELSE translate({_digests('a', 'b', 'c')}, {_DNA}) END",
     "tail_f": f"translate({_digests('d', 'e')}, {_DNA})", "tail_r": f"translate({_digests('g', 'h')}, {_DNA})"},
    {"f0": "substr(concat(substr(frag, 1, flen), tail_f), 1, nf)", "r0": "substr(concat(translate(reverse(substr(mate, 1, flen)), 'ACGT', 'TGCA'), tail_r), 1, nr)", "p": "CAST(k % 30 AS INT)"},
    {"f_header": "concat('@read', k, '/1')", "r_header": "concat('@read', k, '/2')",
     "f_seq": "CASE WHEN k % 4 = 1 THEN concat(substr(f0, 1, p), 'N', substr(f0, p + 2)) WHEN k % 13 = 2 THEN lower(f0) ELSE f0 END",
     "r_seq": "CASE WHEN k % 6 = 1 THEN concat(substr(r0, 1, p), translate(substr(r0, p + 1, 1), 'ACGT', 'CATG'), substr(r0, p + 2)) WHEN k % 11 = 3 THEN concat('NN', substr(r0, 3)) ELSE r0 END",
     "f_qual": f"translate(substr({_digests('q', 'r')}, 1, nf), {_QUALITY})", "r_qual": f"translate(substr({_digests('s', 't')}, 1, nr), {_QUALITY})"},
)
PAIR = ("f_header", "f_seq", "f_qual", "r_header", "r_seq", "r_qual")


def pairs(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"))
    for step in STEPS:
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    return df.select(F.col("k").alias("row_id"), *PAIR)


def pairs_sql(table: str = "documents", key: str = "doc_id") -> str:
    sql = f"SELECT {key} AS k FROM {table}"
    for step in STEPS:
        sql = "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM ({sql})"
    return f"SELECT k AS row_id, {', '.join(PAIR)} FROM ({sql})"


# ---- queries --------------------------------------------------------------------------------------

UNIFORM = BaseFrequencies.uniform()
BASE = MergeParams(empirical_freqs=False)
ROUTED = replace(MergeParams(), quality_threshold=12, min_trim_len=12, max_uncalled=0.2, min_asm_len=45)
#: Letters decode to 32 (A) and 34 (C) at base 33, so this threshold trims first reads at two of these.
AS_PROGRAM = replace(MergeParams(), compat="reference", quality_threshold=36, min_trim_len=3, test_method=2, p_value=0.05, min_overlap=5, max_uncalled=0.5, min_asm_len=30)


def _ready(spark, sf_dir, params=BASE):
    return overlap.prepared(pairs(spark, sf_dir), params)


def _found(spark, sf_dir, method=2, engine="arrow"):
    params = replace(BASE, score_method=method)
    return overlap.best_overlap(_ready(spark, sf_dir, params), params, UNIFORM, engine)


def x_bases(spark, sf_dir):
    p = pairs(spark, sf_dir, "orders", "o_orderkey")
    return p.select("row_id", sequence.reversed_text("r_qual").alias("reversed"), sequence.complement("f_seq").alias("complemented"), sequence.reverse_complement("r_seq").alias("reverse_complemented"), sequence.at("f_seq", 4).alias("fifth"), sequence.length("f_seq").alias("n"), sequence.prefix("f_seq", 7).alias("begins"), sequence.suffix_from("f_seq", 30).alias("ends"))


def x_phred(spark, sf_dir):
    each = pairs(spark, sf_dir, "orders", "o_orderkey").select("row_id", F.posexplode(sequence.characters("f_qual")).alias("pos", "c"))
    return each.select("row_id", "pos", sequence.phred("c").alias("quality"), F.round(sequence.error_probability("c"), 9).alias("error"))


def x_uncalled(spark, sf_dir):
    return pairs(spark, sf_dir, "orders", "o_orderkey").select("row_id", sequence.uncalled("f_seq").alias("n_uncalled"), F.round(sequence.uncalled_ratio("f_seq"), 9).alias("ratio"))


def a1_base_counts(spark, sf_dir):
    return frequencies.base_counts(pairs(spark, sf_dir, "orders", "o_orderkey"), "f_seq", "r_seq")


def a2_base_frequencies(spark, sf_dir):
    f = frequencies.base_frequencies(pairs(spark, sf_dir, "orders", "o_orderkey"), "f_seq", "r_seq")
    return f.select("total", *[F.round(c, 9).alias(c) for c in ("pa", "pc", "pg", "pt", "q")])


def a3_uniform_frequencies(spark, sf_dir):
    u = frequencies.collect_frequencies(None, empirical=False)
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("pa", u.pa), ("pc", u.pc), ("pg", u.pg), ("pt", u.pt), ("q", u.q))])


def m2_pair_scores(method):
    def query(spark, sf_dir):
        places = F.sequence(F.lit(0), F.least(F.length("f_seq"), F.length("r_seq")) - 1)
        p = pairs(spark, sf_dir).select("row_id", "f_seq", "f_qual", "r_seq", "r_qual", F.explode(places).alias("pos"))
        x, y = sequence.at("f_seq", F.col("pos")), sequence.at("r_seq", F.col("pos"))
        ex, ey = (sequence.error_probability(sequence.at(c, F.col("pos"))) for c in ("f_qual", "r_qual"))
        score, oes = scoring.pair_score(x, y, ex, ey, method, UNIFORM)
        return p.select("row_id", "pos", F.round(score, 6).alias("score"), F.round(oes, 6).alias("oes"))

    return query


def o_best_overlap(method, engine="arrow"):
    def query(spark, sf_dir):
        return _found(spark, sf_dir, method, engine).select("row_id", "d", "overlap", "asm_len", F.round("score", 6).alias("score"), F.round("oes", 6).alias("oes"))

    return query


def p_significance(spark, sf_dir):
    found = _found(spark, sf_dir).where("d IS NOT NULL")
    tests = [significance.significant(replace(BASE, p_value=p, test_method=t), UNIFORM.q).alias(f"test{t}_{str(p).replace('.', '_')}") for t in (1, 2) for p in (1.0, 0.05, 0.01, 0.001, 0.0001)]
    return found.select("row_id", *tests)


def p_test_rows(spark, sf_dir):
    """Test 2 with the rows that the original program looks up."""
    found = _found(spark, sf_dir).where("d IS NOT NULL")
    tests = [significance.significant(replace(BASE, p_value=p, test_method=2, compat="reference"), UNIFORM.q).alias(f"test2_{str(p).replace('.', '_')}") for p in (0.05, 0.01, 0.001, 0.0001)]
    return found.select("row_id", significance.test_row(replace(BASE, compat="reference")).alias("row"), *tests)


def _assembled(spark, sf_dir, engine="arrow"):
    found = overlap.assembled(_ready(spark, sf_dir), BASE, UNIFORM, engine).where("d IS NOT NULL")
    return found.withColumn("m_qual", fastq.capped_quality("m_qual", BASE))


def p_gates(spark, sf_dir):
    m = _assembled(spark, sf_dir)
    params = replace(BASE, max_asm_len=70, max_uncalled=0.01)
    return m.select("row_id", significance.long_enough(params).alias("long_enough"), significance.length_in_range(params).alias("in_range"), significance.called_enough(params).alias("called"))


def c1_consensus(spark, sf_dir):
    return _assembled(spark, sf_dir).select("row_id", "m_seq", "m_qual")


def c1_consensus_native(spark, sf_dir):
    """By column functions."""
    found = consensus.merged(_found(spark, sf_dir).where("d IS NOT NULL"), BASE)
    return found.select("row_id", "m_seq", fastq.capped_quality("m_qual", BASE).alias("m_qual"))


def t_trim(spark, sf_dir):
    return overlap.assembled(_ready(spark, sf_dir), replace(BASE, quality_threshold=12), UNIFORM).select("row_id", "f_keep", "r_from")


def t_trim_native(spark, sf_dir):
    """By column functions."""
    r = _ready(spark, sf_dir)
    return r.select("row_id", trim.forward_length(F.col("f_seq"), F.col("f_qual"), 12, 33).alias("f_keep"), trim.reverse_start(F.col("r_seq"), F.col("r_qual"), 12, 33).alias("r_from"))


def _routed(spark, sf_dir, params=ROUTED):
    return merge.merge_pairs(pairs(spark, sf_dir), params)


ROUTES = ("row_id", "status", "seq", "qual", "f_seq", "f_qual", "r_seq", "r_qual")


def r1_merge(spark, sf_dir):
    return _routed(spark, sf_dir).select(*ROUTES)


def r1_merge_as_program(spark, sf_dir):
    """Trimming by letters and the rows of test 2 as in the original program."""
    return _routed(spark, sf_dir, AS_PROGRAM).select(*ROUTES)


def stream_merge(spark, sf_dir):
    """The merge as a stream, with uniform frequencies, until its input is used up."""
    where = new_folder(spark, "stream")
    pairs(spark, sf_dir).write.parquet(f"{where}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{where}/in").schema).parquet(f"{where}/in")
    merged = merge_stream.merge_stream(source, replace(ROUTED, empirical_freqs=False)).select(*ROUTES)
    written = merged.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    written.awaitTermination()
    return spark.read.schema(merged.schema).parquet(f"{where}/out")


def files_merge(spark, sf_dir):
    """The whole run over FASTQ files: reads are written, paired, merged and routed, and the outputs read again.

    ``place`` numbers the records of an output, which stand in the order of the input.
    """
    where = new_folder(spark, "files")
    p = pairs(spark, sf_dir).orderBy("row_id").select("row_id", *PAIR)
    for s, name in (("f", "R1"), ("r", "R2")):
        p.select(F.concat_ws("\n", f"{s}_header", f"{s}_seq", F.lit("+"), f"{s}_qual")).write.text(f"{where}/{name}.fastq")
    names = fastq.write_outputs(run.merge_files(spark, f"{where}/R1.fastq", f"{where}/R2.fastq", ROUTED), f"{where}/run")
    out = None
    for name, path in names.items():
        rows = fastq.read_fastq(spark, path).select(F.lit(name).alias("output"), F.col("row_id").alias("place"), "header", "seq", "qual")
        out = rows if out is None else out.unionByName(rows)
    return out


def k3_output_records(spark, sf_dir):
    out = None
    for name, rows in fastq.output_records(_routed(spark, sf_dir)).items():
        rows = rows.select(F.lit(name).alias("output"), "row_id", "side", "record")
        out = rows if out is None else out.unionByName(rows)
    return out


def k4_quality_cap(spark, sf_dir):
    return pairs(spark, sf_dir, "orders", "o_orderkey").select("row_id", sequence.capped("f_qual", 30).alias("capped"))


def k5_report(spark, sf_dir):
    return report.disposition_counts(_routed(spark, sf_dir))


def k6_numbers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", report.thousands(F.col("o_orderkey") * 1_000_003).alias("written"))


def k7_options(spark, sf_dir):
    return report.options_table(spark, parse_args(["-f", "a", "-r", "b", "-o", "c", "-p", "0.05", "--min-overlap=8"]))


def k5_report_lines(spark, sf_dir):
    return report.report_lines(report.disposition_counts(_routed(spark, sf_dir)), fastq.output_names("run1"))


def k8_frequency_lines(spark, sf_dir):
    return report.frequency_lines(frequencies.base_frequencies(pairs(spark, sf_dir, "orders", "o_orderkey"), "f_seq", "r_seq"))


def k1_output_names(spark, sf_dir):
    names = fastq.output_names("run1")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("output"), F.lit(v).alias("name")) for k, v in names.items()])))


def _lines(df: DataFrame, side: str) -> DataFrame:
    """A file's lines, from pairs numbered from 0."""
    four = F.array(F.col(f"{side}_header"), F.col(f"{side}_seq"), F.lit("+anything"), F.col(f"{side}_qual"))
    return df.select("row_id", F.posexplode(four).alias("i", "line")).select((F.col("row_id") * 4 + F.col("i")).alias("line_no"), "line")


def s1_parse_lines(spark, sf_dir):
    return fastq.parse_lines(_lines(pairs(spark, sf_dir), "f"))


def j1_pair_lines(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return fastq.pair_lines(_lines(p, "f"), _lines(p.where("row_id % 50 <> 7"), "r"), "truncate")


def j1_pair_reads(spark, sf_dir):
    p = pairs(spark, sf_dir, "orders", "o_orderkey")
    side = lambda s: p.select("row_id", *[F.col(f"{s}_{c}").alias(c) for c in ("header", "seq", "qual")])
    return fastq.pair_reads(side("f"), side("r"))


def j2_validate_counts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return fastq.validate_counts(p, p.where("row_id > 3"))


def sql_functions(spark, sf_dir):
    sequence.register(spark)
    pairs(spark, sf_dir).createOrReplaceTempView("strandjoin_pairs")
    return spark.sql("SELECT row_id, pos, dna_complement(f_seq) AS complemented, dna_reverse_complement(r_seq) AS reverse_complemented, dna_uncalled(f_seq) AS n_uncalled, phred_quality(c, 33) AS quality, round(phred_error(c, 33), 9) AS error FROM strandjoin_pairs LATERAL VIEW posexplode(split(f_qual, '')) AS pos, c")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole merge with default options."""
    return merge.merge_pairs(pairs(spark, sf_dir)).select("row_id", "status", "reason", "seq", "qual", "d", "overlap", "asm_len", "score", "oes")


def queries() -> dict:
    out = {f.__name__: f for f in (x_bases, x_phred, x_uncalled, a1_base_counts, a2_base_frequencies, a3_uniform_frequencies, p_significance, p_test_rows, p_gates, c1_consensus, c1_consensus_native, t_trim, t_trim_native, r1_merge, r1_merge_as_program, stream_merge, files_merge, k1_output_names, k3_output_records, k4_quality_cap, k5_report, k5_report_lines, k6_numbers, k7_options, k8_frequency_lines, s1_parse_lines, j1_pair_lines, j1_pair_reads, j2_validate_counts, sql_functions)}
    for m in (1, 2, 3):
        out[f"m2_pair_scores_{m}"] = m2_pair_scores(m)
        out[f"o_best_overlap_{m}"] = o_best_overlap(m)
    out["o_best_overlap_native"] = o_best_overlap(2, "native")
    return out


# ---- SQL ------------------------------------------------------------------------------------------


def _value_sql(method: int, n_score: str) -> tuple[str, str]:
    """(score, oes) of x, y, ex, ey with shares px, py and q."""
    eq = "((1-ex)*(1-ey) + ex*ey*(q-px*px)/((1-px)*(1-px)))"
    neq = "(1 - (1-ey)*ex*py/(1-px) - (1-ex)*ey*px/(1-py) - ex*ey*(q-px*px-py*py)/((1-px-py)*(1-px-py)))"
    known = "x IN ('A','C','G','T') AND y IN ('A','C','G','T')"
    oes = f"CASE WHEN x = 'N' OR y = 'N' THEN 2*q-1 WHEN NOT ({known}) THEN 0 WHEN x = y THEN 2*{eq}-1 ELSE -(2*{neq}-1) END"
    score = {
        1: oes,
        2: f"CASE WHEN x = 'N' OR y = 'N' THEN {n_score} WHEN NOT ({known}) THEN 0 WHEN x = y THEN {eq} ELSE -{neq} END",
        3: "CAST(CASE WHEN x = 'N' OR y = 'N' THEN -1 WHEN x = y THEN 1 ELSE -1 END AS DOUBLE)",
    }[method]
    return score, oes


_SHARE = "CASE {c} WHEN 'A' THEN pa WHEN 'C' THEN pc WHEN 'G' THEN pg WHEN 'T' THEN pt ELSE 0.25 END"
_UNIFORM_SQL = "SELECT 0.25::DOUBLE AS pa, 0.25::DOUBLE AS pc, 0.25::DOUBLE AS pg, 0.25::DOUBLE AS pt, 0.25::DOUBLE AS q"
_COUNT = "sum(length(f_seq) - length(translate(f_seq, '{a}{b}', '')) + length(r_seq) - length(translate(r_seq, '{a}{b}', '')))"
_COUNTS_SQL = "SELECT " + ", ".join(f"CAST({_COUNT.format(a=c, b=c.lower())} AS BIGINT) AS freq{c.lower()}" for c in "ACGTN") + " FROM pairs"
_FREQ_SQL = f"SELECT *, pa*pa + pc*pc + pg*pg + pt*pt AS q FROM (SELECT *, {', '.join(f'freq{c} / CAST(total AS DOUBLE) AS p{c}' for c in 'acgt')} FROM (SELECT *, freqa + freqc + freqg + freqt AS total FROM ({_COUNTS_SQL})))"


def _core(method: int, freqs: str = _UNIFORM_SQL) -> str:
    """CTEs: pairs, freq, ready, best (row_id, d, overlap, asm_len, score, oes)."""
    score, oes = _value_sql(method, "-(1-q)")
    return f"""
WITH pairs AS ({pairs_sql()}),
freq AS ({freqs}),
ready AS (SELECT row_id, f_header, r_header, f_seq, f_qual, translate(reverse(r_seq), 'ACGTacgt', 'TGCATGCA') AS r_seq, reverse(r_qual) AS r_qual, length(f_seq) AS nf, length(r_seq) AS nr FROM pairs),
shift AS (SELECT *, least(nf, d + nr) - greatest(0, d) AS ol FROM (SELECT *, unnest(range(1 - nr, nf)) AS d FROM ready)),
base AS (SELECT row_id, d, ol, nr, substr(f_seq, greatest(d, 0) + j + 1, 1) AS x, substr(r_seq, greatest(-d, 0) + j + 1, 1) AS y,
  pow(10.0, -(ascii(substr(f_qual, greatest(d, 0) + j + 1, 1)) - 33) / 10.0) AS ex, pow(10.0, -(ascii(substr(r_qual, greatest(-d, 0) + j + 1, 1)) - 33) / 10.0) AS ey
  FROM (SELECT *, unnest(range(0, ol)) AS j FROM shift)),
valued AS (SELECT row_id, d, ol, nr, {score} AS s, {oes} AS o FROM (SELECT base.*, freq.q, {_SHARE.format(c='x')} AS px, {_SHARE.format(c='y')} AS py FROM base, freq)),
scored AS (SELECT row_id, d, ol, d + nr AS asm_len, round(sum(s), 9) AS score, round(sum(o), 9) AS oes FROM valued GROUP BY ALL),
best AS (SELECT row_id, d, ol AS overlap, asm_len, score, oes FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, d DESC) = 1)"""


def _merged(core: str, cap: int = 40) -> str:
    """CTE m (row_id, m_seq, m_qual) besides best and ready."""
    quality = "CASE WHEN nx AND ny THEN least(u, v) WHEN nx THEN v WHEN ny THEN u WHEN x = y THEN u + v - 33 ELSE greatest(u, v) END"
    return (
        core
        + f""",
over AS (SELECT row_id, j, x, y, x IN ('N','n') AS nx, y IN ('N','n') AS ny, u, v FROM (
  SELECT row_id, j, substr(f_seq, greatest(d, 0) + j + 1, 1) AS x, substr(r_seq, greatest(-d, 0) + j + 1, 1) AS y,
    ascii(substr(f_qual, greatest(d, 0) + j + 1, 1)) AS u, ascii(substr(r_qual, greatest(-d, 0) + j + 1, 1)) AS v
  FROM (SELECT ready.*, d, overlap, unnest(range(0, overlap)) AS j FROM best JOIN ready USING (row_id)))),
middle AS (SELECT row_id, string_agg(CASE WHEN nx AND ny THEN 'N' WHEN nx THEN y WHEN ny THEN x WHEN x = y THEN x WHEN u > v THEN x ELSE y END, '' ORDER BY j) AS s,
  string_agg(chr(CAST(least({cap + 33}, {quality}) AS INT)), '' ORDER BY j) AS t FROM over GROUP BY row_id),
m AS (SELECT row_id, concat(substr(f_seq, 1, greatest(d, 0)), s, substr(r_seq, overlap + greatest(-d, 0) + 1)) AS m_seq,
  concat(substr(f_qual, 1, greatest(d, 0)), t, substr(r_qual, overlap + greatest(-d, 0) + 1)) AS m_qual FROM best JOIN ready USING (row_id) JOIN middle USING (row_id))"""
    )


def _trimmed(threshold: int, forward: str = "f_qual") -> str:
    low = f"ascii(substr({{q}}, i, 1)) - 33 < {threshold} AND ascii(substr({{q}}, i + 1, 1)) - 33 < {threshold}"
    return f"""
ft AS (SELECT row_id, min(i) AS i FROM (SELECT row_id, {forward}, unnest(range(1, nf)) AS i FROM ready) WHERE {low.format(q=forward)} GROUP BY 1),
rt AS (SELECT row_id, max(i) AS i FROM (SELECT row_id, r_qual, unnest(range(1, nr)) AS i FROM ready) WHERE {low.format(q='r_qual')} GROUP BY 1),
cutp AS (SELECT ready.row_id, CAST(coalesce(ft.i, nf) AS INT) AS f_keep, CAST(coalesce(rt.i, 0) AS INT) AS r_from FROM ready LEFT JOIN ft USING (row_id) LEFT JOIN rt USING (row_id))"""


def _cutoffs(q: str, p_values: tuple[float, ...]) -> str:
    """CTE cutoff (p, n, t): the score to exceed with overlap n, from the binomial law itself and not from this package's tables."""
    return f"""
chance AS (SELECT greatest(25, floor(least(({q}), 0.49) * 100)) / 100.0 AS v),
pmf AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(v) + (n - k) * ln(1 - v)) AS f FROM chance, (SELECT n, unnest(range(0, n + 1)) AS k FROM range(1, 200) AS s(n))),
cdf AS (SELECT n, k, least(sum(f) OVER (PARTITION BY n ORDER BY k), 1.0) AS f FROM pmf),
score AS (SELECT n, t, CAST(floor((t + n) / 2.0) AS INT) AS k FROM range(1, 200) AS s(n), range(-199, 200) AS r(t)),
joint AS (SELECT n, t, sum(CASE WHEN k < 0 THEN -1e9 WHEN k >= n THEN 0 ELSE ln(cdf.f) END) OVER (PARTITION BY t ORDER BY n DESC) AS l FROM score LEFT JOIN cdf USING (n, k)),
cutoff AS (SELECT p, n, min(t) AS t FROM joint, (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in p_values)}]) AS p) WHERE n <= 99 AND 1 - exp(2 * l) <= p + 1e-12 GROUP BY p, n
  UNION ALL SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in p_values)}]), 0, 99)"""


#: The overlap that the original program looks up in test 2.
_PROGRAM_ROW = "CASE WHEN nf > nr AND d >= 0 AND d < nf - nr THEN d WHEN nr > nf AND d < 0 AND d >= nf - nr THEN nr - nf + d ELSE overlap END"


_N = "length({c}) - length(translate({c}, 'Nn', ''))"


def _routed_sql(o: MergeParams = ROUTED, freqs: str = _FREQ_SQL) -> str:
    """CTE res: the merge with the given options."""
    as_program = o.compat == "reference"
    row = str(o.min_overlap) if o.test_method == 1 else (_PROGRAM_ROW if as_program else "overlap")
    return (
        _merged(_core(2, freqs))
        + ","
        + _trimmed(o.quality_threshold, "f_seq" if as_program else "f_qual")
        + ","
        + _cutoffs("SELECT q FROM freq", (o.p_value,))
        + f""",
tested AS (SELECT row_id, best.d, overlap, asm_len, oes, least({row}, 99) AS n FROM best JOIN ready USING (row_id)),
judged AS (SELECT ready.*, f_keep, r_from, m_seq, m_qual, coalesce(oes > t AND overlap >= {o.min_overlap} AND asm_len BETWEEN {o.min_asm_len} AND {o.max_asm_len} AND {_N.format(c='m_seq')} <= {o.max_uncalled} * asm_len, false) AS ok
  FROM ready JOIN cutp USING (row_id) LEFT JOIN tested USING (row_id) LEFT JOIN cutoff USING (n) LEFT JOIN m USING (row_id)),
kept AS (SELECT *, substr(f_seq, 1, f_keep) AS f_out, substr(f_qual, 1, f_keep) AS f_outq,
  CASE WHEN f_keep < {o.min_trim_len} THEN r_seq ELSE substr(r_seq, r_from + 1) END AS r_out, CASE WHEN f_keep < {o.min_trim_len} THEN r_qual ELSE substr(r_qual, r_from + 1) END AS r_outq FROM judged),
res AS (SELECT row_id, f_header, r_header, CASE WHEN ok THEN 'assembled' WHEN f_keep < {o.min_trim_len} OR length(r_out) < {o.min_trim_len} OR ({_N.format(c='f_out')}) / CAST(length(f_out) AS DOUBLE) >= {o.max_uncalled} OR ({_N.format(c='r_out')}) / CAST(length(r_out) AS DOUBLE) >= {o.max_uncalled} THEN 'discarded' ELSE 'unassembled' END AS status,
  CASE WHEN ok THEN m_seq END AS seq, CASE WHEN ok THEN m_qual END AS qual, CASE WHEN NOT ok THEN f_out END AS f_seq, CASE WHEN NOT ok THEN f_outq END AS f_qual, CASE WHEN NOT ok THEN r_out END AS r_seq, CASE WHEN NOT ok THEN r_outq END AS r_qual FROM kept)"""
    )


def oracle_sql() -> dict:
    orders = f"WITH pairs AS ({pairs_sql('orders', 'o_orderkey')}) "
    docs = f"WITH pairs AS ({pairs_sql()}) "
    out = {
        "x_bases": orders + "SELECT row_id, reverse(r_qual) AS reversed, translate(f_seq, 'ACGTacgt', 'TGCATGCA') AS complemented, translate(reverse(r_seq), 'ACGTacgt', 'TGCATGCA') AS reverse_complemented, substr(f_seq, 5, 1) AS fifth, CAST(length(f_seq) AS INT) AS n, substr(f_seq, 1, 7) AS begins, substr(f_seq, 31) AS ends FROM pairs",
        "x_phred": orders + "SELECT row_id, pos, CAST(ascii(c) - 33 AS INT) AS quality, round(pow(10.0, -(ascii(c) - 33) / 10.0), 9) AS error FROM (SELECT row_id, pos, substr(f_qual, pos + 1, 1) AS c FROM (SELECT *, CAST(unnest(range(0, length(f_qual))) AS INT) AS pos FROM pairs))",
        "x_uncalled": orders + f"SELECT row_id, CAST({_N.format(c='f_seq')} AS INT) AS n_uncalled, round(({_N.format(c='f_seq')}) / CAST(length(f_seq) AS DOUBLE), 9) AS ratio FROM pairs",
        "a1_base_counts": orders + _COUNTS_SQL,
        "a2_base_frequencies": orders + "SELECT total, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("pa", "pc", "pg", "pt", "q")) + f" FROM ({_FREQ_SQL})",
        "a3_uniform_frequencies": _UNIFORM_SQL,
        "k1_output_names": "SELECT * FROM (VALUES ('assembled', 'run1.assembled.fastq'), ('unassembled_forward', 'run1.unassembled.forward.fastq'), ('unassembled_reverse', 'run1.unassembled.reverse.fastq'), ('discarded', 'run1.discarded.fastq')) AS t(output, name)",
        "k4_quality_cap": orders + "SELECT row_id, translate(f_qual, '@ABCDEFGHI', '??????????') AS capped FROM pairs",
        "k6_numbers": "SELECT o_orderkey, format('{:,}', o_orderkey * 1000003) AS written FROM orders",
        "k7_options": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in (("left", "a"), ("right", "b"), ("output", "c"), ("p_value", "0.05"), ("min_overlap", "8"), ("max_asm_len", "999999"), ("min_asm_len", "50"), ("min_trim_len", "1"), ("quality_threshold", "0"), ("max_uncalled", "1.0"), ("test_method", "1"), ("empirical_freqs", "True"), ("score_method", "2"), ("phred_base", "33"), ("cap", "40"), ("on_count_mismatch", "error"), ("compat", "documented"), ("restore_reverse", "False"), ("normalise_case", "False"))) + ") AS t(option, value)",
        "k8_frequency_lines": orders + ", f AS (" + _FREQ_SQL + ") SELECT 'A' AS name, printf('%f', pa) AS value FROM f UNION ALL SELECT 'C', printf('%f', pc) FROM f UNION ALL SELECT 'G', printf('%f', pg) FROM f UNION ALL SELECT 'T', printf('%f', pt) FROM f UNION ALL SELECT 'uncalled', format('{:,}', freqn) FROM f",
        "s1_parse_lines": docs + "SELECT row_id, f_header AS header, f_seq AS seq, f_qual AS qual FROM pairs",
        "j1_pair_lines": docs + "SELECT * FROM pairs WHERE row_id % 50 <> 7",
        "j1_pair_reads": orders + "SELECT * FROM pairs",
        "j2_validate_counts": "SELECT count(*) AS n_forward, count(*) FILTER (doc_id > 3) AS n_reverse, count(*) > 0 AND count(*) = count(*) FILTER (doc_id > 3) AS valid FROM documents",
        "sql_functions": docs + f"SELECT row_id, translate(f_seq, 'ACGTacgt', 'TGCATGCA') AS complemented, translate(reverse(r_seq), 'ACGTacgt', 'TGCATGCA') AS reverse_complemented, CAST({_N.format(c='f_seq')} AS INT) AS n_uncalled, pos, CAST(ascii(substr(f_qual, pos + 1, 1)) - 33 AS INT) AS quality, round(pow(10.0, -(ascii(substr(f_qual, pos + 1, 1)) - 33) / 10.0), 9) AS error FROM (SELECT *, CAST(unnest(range(0, length(f_qual))) AS INT) AS pos FROM pairs)",
        "c1_consensus": _merged(_core(2)) + " SELECT row_id, m_seq, m_qual FROM m",
        "t_trim": _core(2) + "," + _trimmed(12) + " SELECT row_id, f_keep, r_from FROM cutp",
        "r1_merge": _routed_sql() + " SELECT row_id, status, seq, qual, f_seq, f_qual, r_seq, r_qual FROM res",
        "k5_report": _routed_sql() + " SELECT s AS status, count(row_id) AS n, round(100.0 * count(row_id) / (SELECT count(*) FROM res), 3) AS pct FROM (VALUES ('assembled'), ('discarded'), ('unassembled')) AS t(s) LEFT JOIN res ON status = s GROUP BY s",
        "p_gates": _merged(_core(2)) + f" SELECT row_id, overlap >= 10 AS long_enough, asm_len BETWEEN 50 AND 70 AS in_range, {_N.format(c='m_seq')} <= 0.01 * asm_len AS called FROM best JOIN m USING (row_id)",
    }
    out["c1_consensus_native"], out["t_trim_native"] = out["c1_consensus"], out["t_trim"]
    routes = f" SELECT {', '.join(ROUTES)} FROM res"
    out["r1_merge_as_program"] = _routed_sql(AS_PROGRAM) + routes
    out["stream_merge"] = _routed_sql(freqs=_UNIFORM_SQL) + routes
    out["files_merge"] = _routed_sql() + """, written AS (SELECT 'assembled' AS output, row_id, 0 AS side, f_header AS header, seq, qual FROM res WHERE status = 'assembled'
UNION ALL SELECT 'unassembled_forward', row_id, 0, f_header, f_seq, f_qual FROM res WHERE status = 'unassembled'
UNION ALL SELECT 'unassembled_reverse', row_id, 1, r_header, r_seq, r_qual FROM res WHERE status = 'unassembled'
UNION ALL SELECT 'discarded', row_id, 0, f_header, f_seq, f_qual FROM res WHERE status = 'discarded'
UNION ALL SELECT 'discarded', row_id, 1, r_header, r_seq, r_qual FROM res WHERE status = 'discarded')
SELECT output, row_number() OVER (PARTITION BY output ORDER BY row_id, side) - 1 AS place, header, seq, qual FROM written"""
    share = "format('{:,}', count(*) FILTER (status = '%s')) || ' / ' || format('{:,}', count(*)) || printf(' (%%.3f%%%%)', round(100.0 * count(*) FILTER (status = '%s') / count(*), 3))"
    counted = ((1, "Assembled reads ...................: ", "assembled"), (2, "Discarded reads ...................: ", "discarded"), (3, "Not assembled reads ...............: ", "unassembled"))
    named = ((4, "Assembled reads file...............: run1.assembled.fastq"), (5, "Discarded reads file...............: run1.discarded.fastq"), (6, "Unassembled forward reads file.....: run1.unassembled.forward.fastq"), (7, "Unassembled reverse reads file.....: run1.unassembled.reverse.fastq"))
    out["k5_report_lines"] = _routed_sql() + " " + " UNION ALL ".join([*[f"SELECT {n} AS n, '{text}' || {share % (s, s)} AS line FROM res" for n, text, s in counted], *[f"SELECT {n}, '{text}'" for n, text in named]])
    rec = lambda h, s, q: f"concat_ws(chr(10), {h}, {s}, '+', {q})"
    out["k3_output_records"] = _routed_sql() + f""" SELECT 'assembled' AS output, row_id, 0 AS side, {rec('f_header', 'seq', 'qual')} AS record FROM res WHERE status = 'assembled'
UNION ALL SELECT 'unassembled_forward', row_id, 0, {rec('f_header', 'f_seq', 'f_qual')} FROM res WHERE status = 'unassembled'
UNION ALL SELECT 'unassembled_reverse', row_id, 1, {rec('r_header', 'r_seq', 'r_qual')} FROM res WHERE status = 'unassembled'
UNION ALL SELECT 'discarded', row_id, 0, {rec('f_header', 'f_seq', 'f_qual')} FROM res WHERE status = 'discarded'
UNION ALL SELECT 'discarded', row_id, 1, {rec('r_header', 'r_seq', 'r_qual')} FROM res WHERE status = 'discarded'"""
    levels = (0.05, 0.01, 0.001, 0.0001)
    at = lambda p, n: f"(SELECT t FROM cutoff WHERE p = {p}::DOUBLE AND n = {n})"
    name = lambda p: str(p).replace(".", "_")
    by_overlap = lambda p: f"oes > max(t) FILTER (p = {p}::DOUBLE)"
    one = ", ".join(f"oes > {at(p, 10)} AS test1_{name(p)}" for p in levels)
    two = ", ".join(f"{by_overlap(p)} AS test2_{name(p)}" for p in levels)
    tested = lambda n: _core(2) + "," + _cutoffs("SELECT 0.25", levels) + f", tested AS (SELECT best.row_id, oes, {n} AS row FROM best JOIN ready USING (row_id)), two AS (SELECT row_id, row, {two} FROM tested JOIN cutoff ON n = least(row, 99) GROUP BY row_id, row, oes)"
    out["p_significance"] = tested("overlap") + f", one AS (SELECT row_id, {one} FROM best) SELECT true AS test1_1_0, true AS test2_1_0, one.*, two.* EXCLUDE (row_id, row) FROM one JOIN two USING (row_id)"
    out["p_test_rows"] = tested(_PROGRAM_ROW) + " SELECT two.* REPLACE (CAST(row AS INT) AS row) FROM two"
    for m in (1, 2, 3):
        rows = " SELECT ready.row_id, CAST(d AS INT) AS d, CAST(overlap AS INT) AS overlap, CAST(asm_len AS INT) AS asm_len, round(score, 6) AS score, round(oes, 6) AS oes FROM ready LEFT JOIN best USING (row_id)"
        out[f"o_best_overlap_{m}"] = _core(m) + rows
        score, oes = _value_sql(m, "-(1-q)")
        out[f"m2_pair_scores_{m}"] = f"""WITH pairs AS ({pairs_sql()}), freq AS ({_UNIFORM_SQL}),
b AS (SELECT row_id, pos, substr(f_seq, pos + 1, 1) AS x, substr(r_seq, pos + 1, 1) AS y, pow(10.0, -(ascii(substr(f_qual, pos + 1, 1)) - 33) / 10.0) AS ex, pow(10.0, -(ascii(substr(r_qual, pos + 1, 1)) - 33) / 10.0) AS ey FROM (SELECT *, CAST(unnest(range(0, least(length(f_seq), length(r_seq)))) AS INT) AS pos FROM pairs))
SELECT row_id, pos, round({score}, 6) AS score, round({oes}, 6) AS oes FROM (SELECT b.*, q, {_SHARE.format(c='x')} AS px, {_SHARE.format(c='y')} AS py FROM b, freq)"""
    out["o_best_overlap_native"] = out["o_best_overlap_2"]
    return out
