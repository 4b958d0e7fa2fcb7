"""Nearest originals far beyond seeds, against all pairs."""

import random

import pytest
from helixlake.operators import metrics, nearest
from test_operators import lev


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        s[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("ACGT")]
    return "".join(s)


@pytest.mark.parametrize("strings", [7, 512])
def test_far_candidates_against_all_pairs(spark, monkeypatch, strings):
    monkeypatch.setattr(nearest, "STRINGS", strings)
    rng = random.Random(8)
    originals = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 40))) for _ in range(25)] + ["", "A", "ACGTN", "é漢🧬é漢🧬é漢🧬"]
    originals += originals[:2]
    found = [edited(rng, rng.choice(originals[:25]), n) for n in (0, 1, 3, 6, 8, 12) for _ in range(4)]
    found += ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(5)] + ["", "TTTTTTTTTTTT", "é漢🧬", "x" * 60, found[0], found[5]]
    want = {}
    for s in set(found):
        d, pos, t = min((lev(s, t), k, t) for k, t in enumerate(originals))
        want[s] = (t, 1.0 if d == 0 else 1 - d / len(t) if t else None, found.count(s))
    orig = spark.createDataFrame([*enumerate(originals), (99, None)], "pos int, seq string")
    rates = metrics.reconstruction_rate(orig, spark.createDataFrame([(s,) for s in [*found, None]], "seq string"))
    got = {r["seq"]: (r["nearest"], r["rate"], r["c"]) for r in rates.collect()}
    assert got.keys() == want.keys()
    for s, (t, rate, c) in want.items():
        assert got[s][0] == t and got[s][2] == c and (got[s][1] == rate or abs(got[s][1] - rate) < 1e-9)


def test_no_pair_beyond_its_radius_is_measured_and_bounds_hold():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(40)]
    near = [edited(rng, s, 9) for s in strings]
    profiles, sizes = nearest.profiles(strings), nearest.np.array([len(s) for s in strings])
    for k, s in enumerate(near):
        bound = nearest.least_distances(nearest.profiles([s])[0], len(s), profiles, sizes)
        real = [lev(s, t) for t in strings]
        assert all(b <= d for b, d in zip(bound, real, strict=True))
        assert (bound <= real[k]).sum() < 20  # most of the far ones are never measured


def test_no_originals_give_no_far_row(spark):
    orig = spark.createDataFrame([], "pos int, seq string")
    assert metrics.reconstruction_rate(orig, spark.createDataFrame([("ACGT",)], "seq string")).count() == 0
