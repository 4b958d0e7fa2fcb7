"""Pairs of reads compared a batch at once, against letter by letter."""

import random

import pytest

from helixlake.operators import cluster
from helixlake.plans.queries import QUERIES
from support import SF


@pytest.mark.parametrize("letters", ["ACGT", "ACGTé𝔸"])
def test_mismatches_are_those_of_letters(spark, letters):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(f"p{k}", text(n), text(n + rng.choice([0, 0, 3, -1]) if n else 2)) for k, n in enumerate([0, 1, 5, 5, 40, 100, 100] * 4)]
    pairs += [("x", None, "AC"), ("y", "AC", None), (None, "AC", "AG"), ("z", "ACGT", "ACGT")]
    want = [(k, i, p, q) for k, a, b in pairs for i, (p, q) in enumerate(zip(a or "", b or "")) if p != q]
    got = cluster.mismatches(spark.createDataFrame(pairs, "id string, a string, b string").repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_reads_come_with_their_strands(spark):
    plan = QUERIES["clu10_mismatches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
