import random
from dataclasses import replace

import pytest

from strandjoin.functions.scoring import BaseFrequencies
from strandjoin.operators import merge
from strandjoin.plans.params import MergeParams
from tests import slow_merge

SCHEMA = "row_id long, f_header string, f_seq string, f_qual string, r_header string, r_seq string, r_qual string"
UNIFORM = {c: 0.25 for c in "ACGT"}
LOOSE = MergeParams(empirical_freqs=False, min_asm_len=1, min_overlap=3, p_value=1.0)


def random_pairs(n, seed):
    rng = random.Random(seed)
    text = lambda k, letters="ACGT": "".join(rng.choices(letters, k=k))
    rows = []
    for i in range(n):
        fragment = text(rng.randint(1, 45))
        nf, nr = rng.randint(1, 30), rng.randint(1, 30)
        f = (fragment + text(30))[:nf]
        r = slow_merge.revcomp(text(30) + fragment)[:nr]
        if rng.random() < 0.2:
            r = text(nr)
        change = lambda s: "".join(rng.choice("ACGTNnacR") if rng.random() < 0.08 else c for c in s)
        f, r = change(f), change(r)
        q = lambda s: "".join(chr(33 + rng.choice([2, 5, 11, 20, 30, 41])) for _ in s)
        rows.append((i, f"@r{i}/1", f, q(f), f"@r{i}/2", r, q(r)))
    return rows


def compare(spark, rows, params, engine="arrow", freqs=None):
    shares = dict(zip("ACGT", (freqs or BaseFrequencies.uniform()).shares, strict=True))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["row_id"]: r for r in merge.merge_pairs(df, params, freqs, engine).collect()}
    assert len(got) == len(rows)
    for i, _, f, fq, _, r, rq in rows:
        g = got[i]
        want = slow_merge.merge(f, fq, r, rq, params, shares)
        assert tuple(g[c] for c in ("status", "seq", "qual", "f_seq", "f_qual", "r_seq", "r_qual", "d")) == want, (i, f, r, g["reason"])


@pytest.mark.parametrize("params", [
    LOOSE,
    replace(LOOSE, score_method=1, cap=0),
    replace(LOOSE, score_method=3, quality_threshold=12, min_trim_len=4),
    replace(LOOSE, p_value=0.05, test_method=2, max_uncalled=0.1, max_asm_len=40, quality_threshold=12),
    replace(LOOSE, p_value=0.01, min_overlap=8, min_asm_len=15, max_uncalled=0.0),
])
def test_random_pairs(spark, params):
    compare(spark, random_pairs(250, repr(params)), params)


def test_native_engine_agrees(spark):
    compare(spark, random_pairs(80, 5), replace(LOOSE, quality_threshold=12), "native")


def test_skewed_frequencies(spark):
    freqs = BaseFrequencies(0, 0, 0, 0, 0, 0, 0.4, 0.1, 0.2, 0.3, 0.3)
    compare(spark, random_pairs(120, 6), replace(LOOSE, p_value=0.05), freqs=freqs)


def one(spark, f, r, params=LOOSE, fq=None, rq=None):
    row = (0, "@a/1", f, fq or "I" * len(f), "@a/2", r, rq or "I" * len(r))
    return merge.merge_pairs(spark.createDataFrame([row], SCHEMA), params).first()


def test_perfect_overlap_sums_and_caps_qualities(spark):
    frag = "ACGTTGCATGCCATGGATTACAGATCCGTA"
    got = one(spark, frag[:20], slow_merge.revcomp(frag[10:]))
    assert (got["status"], got["seq"], got["d"], got["overlap"]) == ("assembled", frag, 10, 10)
    assert got["qual"] == "I" * 30  # 40 + 40, capped at 40


def test_run_through_is_cut_off(spark):
    frag = "ACGTTGCATGCCATG"
    got = one(spark, frag + "TTTTT", slow_merge.revcomp("GGGGG" + frag))
    assert (got["seq"], got["d"]) == (frag, -5)


def test_mismatch_with_equal_quality_takes_second_read(spark):
    frag = "ACGTTGCATGCCATGGATTACAG"
    got = one(spark, frag, slow_merge.revcomp(frag[:11] + "T" + frag[12:]))
    assert got["seq"][11] == "T"


def test_n_takes_other_base_or_least_quality(spark):
    frag = "ACGTTGCATGCCATGGATTACAG"
    f, r = "N" + frag[1:5] + "N" + frag[6:], "N" + frag[1:]
    got = one(spark, f, slow_merge.revcomp(r), fq="5" * len(f))
    assert got["seq"] == "N" + frag[1:] and got["qual"][0] == "5" and got["qual"][5] == "I"


def test_nothing_scores_above_zero(spark):
    got = one(spark, "AAAAAAAA", slow_merge.revcomp("CCCCCCCC"))
    assert got["status"] == "unassembled" and got["d"] is None


def test_short_forward_leaves_reverse_untrimmed(spark):
    params = replace(LOOSE, quality_threshold=10, min_trim_len=5)
    got = one(spark, "AAAAAAAA", "GGGGGGGG", params, fq="I##IIIII", rq="I##IIIII")
    assert (got["status"], got["f_seq"], got["r_seq"]) == ("discarded", "AA"[:2], "CCCCCCCC")


def test_zero_uncalled_discards_every_unmerged_pair(spark):
    assert one(spark, "AAAAAAAA", "GGGGGGGG", replace(LOOSE, max_uncalled=0.0))["status"] == "discarded"


def test_empty_and_null_reads(spark):
    rows = [(0, "@a", "", "", "@b", "", ""), (1, None, None, None, None, "ACGT", "IIII"), (2, "@c", "A", "I", "@d", "N", "#")]
    got = {r["row_id"]: r for r in merge.merge_pairs(spark.createDataFrame(rows, SCHEMA), LOOSE).collect()}
    assert got[0]["status"] == "discarded" and got[1]["status"] == "discarded" and got[2]["d"] is None
    assert merge.merge_pairs(spark.createDataFrame([], SCHEMA), LOOSE).count() == 0


def test_reference_rules_for_trimming_and_test_rows(spark):
    params = replace(LOOSE, compat="reference", phred_base=64, quality_threshold=10)
    got = one(spark, "TTACTTT", "GGGGGGG", params, fq="h" * 7, rq="h" * 7)
    assert got["f_seq"] == "TTA"  # letters decode to 1 and 3, below 10
