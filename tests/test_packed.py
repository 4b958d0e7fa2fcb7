"""Sequences packed for an exchange: equal where the strings are."""

import random

from helixlake.functions import seqfn
from helixlake.operators import metrics
from helixlake.plans.queries import QUERIES
from support import SF


def test_packed_strings_are_equal_where_the_strings_are(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice("ACGT") for _ in range(rng.randrange(12))) for _ in range(800)} | {"A" * k for k in range(9)} | {"", "N", "ACGN", "é", "ACGTé", "ACG\x03"}
    rows = [(t,) for t in sorted(texts)] + [(t,) for t in sorted(texts)] + [(None,)]
    found = spark.createDataFrame(rows, "seq string").repartition(3).select("seq", seqfn.packed("seq").alias("p"))
    pairs = {(r["seq"], None if r["p"] is None else bytes(r["p"])) for r in found.collect()}
    assert len(pairs) == len({p for _, p in pairs}) == len(texts) + 1 and (None, None) in pairs
    same = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(100)),) for _ in range(20)], "seq string").select(seqfn.packed("seq").alias("p"))
    assert {len(r["p"]) for r in same.collect()} == {26}


def test_recovery_exchanges_packed_sequences(spark):
    found = metrics.recovery(spark.createDataFrame([("ACGT",), ("ACGTA",), ("NNA",), ("ACGT",)], "seq string"), spark.createDataFrame([("ACGT",), ("NNA",), ("NNA",), ("ACG",), (None,)], "seq string"))
    r = found.first()
    assert (round(r["fraction"], 9), r["redundancy"]) == (0.666666667, 1.5)
    plan = QUERIES["met18_recovery"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("_packed(") >= 2
