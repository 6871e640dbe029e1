"""Simulated reads with errors under eight sets of options: a merged read has the length of its fragment."""

import random
from dataclasses import replace

import pytest

from strandjoin.operators import merge
from strandjoin.plans.params import MergeParams
from tests import slow_merge
from tests.test_merge import SCHEMA

LENGTH = 100
COMMON = MergeParams(max_asm_len=500, min_asm_len=50, min_trim_len=50, quality_threshold=10, max_uncalled=0.05)
# Mean fragment lengths and the options that differ.
CASES = (
    ("101", 101, {"test_method": 1}),
    ("150", 150, {"test_method": 2}),
    ("165", 165, {"test_method": 1, "min_overlap": 10}),
    ("180", 180, {"test_method": 1}),
    ("180 strict", 180, {"test_method": 1, "p_value": 0.001}),
    ("180 strict, observed", 180, {"test_method": 2, "p_value": 0.001}),
    ("190, no test", 190, {"test_method": 2, "p_value": 1.0}),
    ("250", 250, {"test_method": 2}),
)


def simulated(mean, seed, n=300):
    """Pairs of a random genome's fragments; a base of quality q is wrong with probability 10^(-q/10)."""
    rng = random.Random(seed)
    rows, true = [], []
    text = lambda k: "".join(rng.choices("ACGT", k=k))
    for i in range(n):
        size = max(60, round(rng.gauss(mean, mean / 10)))
        fragment = text(size)
        sides = []
        for s in (fragment, slow_merge.revcomp(fragment)):
            q = [max(2, min(40, round(38 - 12 * k / LENGTH + rng.gauss(0, 3)))) for k in range(LENGTH)]
            read = "".join(rng.choice("ACGT") if rng.random() < 10 ** (-v / 10) * 4 / 3 else c for c, v in zip((s + text(LENGTH))[:LENGTH], q, strict=True))
            sides += [read, "".join(chr(33 + v) for v in q)]
        rows.append((i, f"@r{i}/1", sides[0], sides[1], f"@r{i}/2", sides[2], sides[3]))
        true.append(size)
    return rows, true


@pytest.mark.parametrize("name, mean, options", CASES, ids=[c[0] for c in CASES])
def test_merged_reads_have_the_length_of_their_fragments(spark, name, mean, options):
    rows, true = simulated(mean, name)
    params = replace(COMMON, **{"min_overlap": 1, **options})
    got = {r["row_id"]: r["asm_len"] for r in merge.merge_pairs(spark.createDataFrame(rows, SCHEMA), params).where("status = 'assembled'").collect()}
    able = [i for i, size in enumerate(true) if size <= 2 * LENGTH - 30]
    assert sum(got.get(i) == true[i] for i in able) >= 0.98 * len(able)
    if params.p_value < 1:
        wrong = sum(got[i] != true[i] for i in got)
        assert wrong <= 0.05 * len(rows)
