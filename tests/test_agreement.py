"""Agreement of labellings of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import metrics


def labelled(spark, cells):
    return spark.createDataFrame(cells, "t string, p string, n long")


def test_marginals_beyond_what_products_of_longs_hold(spark):
    big = 6_000_000_000
    r = metrics.agreement(labelled(spark, [("a", "x", big), ("b", "y", big)])).first()
    assert r["n"] == 2 * big and all(abs(r[s] - 1) < 1e-9 for s in ("nmi", "ami", "ari", "fmi", "homogeneity", "completeness", "v_measure", "purity"))
    r = metrics.agreement(labelled(spark, [(t, p, big) for t in "ab" for p in "xy"])).first()
    assert all(abs(r[s]) < 1e-9 for s in ("mi", "nmi", "ami", "ari", "homogeneity", "completeness")) and abs(r["purity"] - 0.5) < 1e-12


@pytest.mark.parametrize("a,b,n", [(10_000_000_000, 10_000_000_000, 30_000_000_000), (5, 10_000_000_000, 20_000_000_000), (3, 4, 9), (7, 9, 9), (1_000_000, 40, 1_000_050)])
def test_chances_sum_up_and_have_the_mean(spark, a, b, n):
    rows = metrics.likely_counts(spark.createDataFrame([(float(a), float(b), float(n))], "a double, b double, total double")).withColumn("g", F.lit(0))
    total = lambda term: sum(r["value"] for r in metrics.shared_by_chance(rows, ["g"], term).collect())
    got = {"all": total(lambda k, a, b, n: np.ones(len(k))), "mean": total(lambda k, a, b, n: k)}
    assert rows.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] < 5_000_000
    none = math.exp(sum(math.log1p(-b / (n - i)) for i in range(a))) if a <= 5 and a + b <= n else 0.0  # k = 0 isn't asked for
    assert abs(got["all"] + none - 1) < 1e-9 and abs(got["mean"] / (a * b / n) - 1) < 1e-9


def test_chance_against_factorials():
    for n in (1, 2, 9, 40, 200):
        for a in range(1, n + 1, max(1, n // 7)):
            for b in range(1, n + 1, max(1, n // 7)):
                k = np.arange(max(0, a + b - n), min(a, b) + 1, dtype=float)
                got = metrics.hypergeometric(k, *(np.full(len(k), float(x)) for x in (a, b, n)))
                want = [math.comb(a, int(x)) * math.comb(n - a, b - int(x)) / math.comb(n, b) for x in k]
                assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_small_negative_scores_are_written_as_zero(spark):
    scores = spark.createDataFrame([("f", -0.0001), ("g", 0.0625)], "pred_file string, ari double")
    assert metrics.rounded_report(scores, "ari").first()[0] == '{"pred_file":["f","g"],"ari":[0.0,0.062]}'
