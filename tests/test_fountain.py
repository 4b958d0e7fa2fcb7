"""The fountain codec gives whole files back."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators import codec, peeling


def segments(spark, files):
    rng = random.Random(8)
    return spark.createDataFrame([(f, k, "".join(rng.choice(letters) for _ in range(30))) for f, (n, letters) in enumerate(files) for k in range(n)], "file_id long, seg_no long, hex string")


def test_fountain_peels_back_whole_files_at_its_parameters(spark):
    # letters of the last file make most droplets of few segments fail the screens
    segs = segments(spark, [(1, "123456789ABCDE"), (2, "123456789ABCDE"), (7, "123456789ABCDE"), (165, "123456789ABCDE"), (1000, "123456789ABCDE"), (60, "0123459ACDF")])
    totals = segs.groupBy("file_id").agg(F.count("*").alias("total"))
    drops = codec.droplets(segs, totals).persist()
    back = {(r["file_id"], r["seg_no"]): r["hex"] for r in codec.peeled(drops).collect()}
    assert back == {(r["file_id"], r["seg_no"]): r["hex"] for r in segs.collect()}
    kept = {r["file_id"]: r["n"] for r in drops.groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert all(kept[r["file_id"]] >= 1.5 * r["total"] for r in totals.collect())


def test_fountain_refuses_files_that_no_droplet_can_carry(spark):
    segs = spark.createDataFrame([(3, 0, "0" * 30)], "file_id long, seg_no long, hex string")
    with pytest.raises(ValueError, match="1 files lack droplets"):
        codec.droplets(segs, segs.groupBy("file_id").agg(F.count("*").alias("total")), rounds=3)


def test_degrees_follow_the_robust_soliton():
    n, k = 20_000, 50
    seen = [0] * (k + 1)
    for d in range(n):
        members = codec.members_of(0, 1, d, k)
        assert len(set(members)) == len(members) and 0 <= members[0] and members[-1] < k
        seen[len(members)] += 1
    at = 0
    for degree, cumulative in enumerate(codec.soliton(k), 1):
        at += seen[degree]
        assert abs(at / n - cumulative) < 0.015


def rows_of(df):
    return sorted(map(tuple, df.select("file_id", "seg_no", "hex").collect()))


def test_edges_and_groups_peel_alike(spark):
    segs = segments(spark, [(1, "123456789ABCDE"), (2, "123456789ABCDE"), (40, "123456789ABCDE"), (130, "0123459ACDF")])
    totals = segs.groupBy("file_id").agg(F.count("*").alias("total"))
    columns = ["file_id", "droplet", "members", "hex", "seq"]
    by_groups = sorted(map(tuple, codec.droplets(segs, totals).select(columns).collect()))
    by_edges = codec.droplets(segs, totals, limit=0).select(columns).persist()
    assert sorted(map(tuple, by_edges.collect())) == by_groups
    assert rows_of(codec.peeled(by_edges, limit=0)) == rows_of(codec.peeled(by_edges)) == rows_of(segs)
    # a third of droplets is lost: both ways give the same segments, all right ones
    some = by_edges.where("droplet % 3 <> 1").unionByName(by_edges.where("droplet = 2"))
    found = rows_of(codec.peeled(some, limit=0))
    assert found == rows_of(codec.peeled(some)) and set(found) <= set(rows_of(segs)) and 0 < len(found)


def test_times_equal_those_of_a_walk_droplet_by_droplet(spark):
    rng = random.Random(21)
    rows = [(f, d, sorted(rng.sample(range(25), rng.choice([1, 2, 2, 3, 3, 5])))) for f in range(4) for d in range(18 + 8 * f)]
    want = set()
    for f in range(4):
        known, seen = set(), []
        for d, members in [(d, m) for g, d, m in rows if g == f]:
            seen.append(set(members))
            while True:
                new = {next(iter(m - known)) for m in seen if len(m - known) == 1}
                if not new:
                    break
                known |= new
                want |= {(f, s, d) for s in new}
    got = peeling.known_by(spark.createDataFrame(rows, "file_id long, droplet long, members array<long>"))
    assert {(r["file_id"], r["seg_no"], r["t"]) for r in got.collect()} == want and len(want) > 30


def test_a_refused_file_is_a_row_beside_the_others(spark):
    segs = segments(spark, [(5, "123456789ABCDE")]).unionByName(spark.createDataFrame([(3, 0, "0" * 30)], "file_id long, seg_no long, hex string"))
    totals = segs.groupBy("file_id").agg(F.count("*").alias("total"))
    drops = codec.droplets(segs, totals, rounds=3, refused="rows").persist()
    assert [(r["file_id"], r["droplet"], r["reason"]) for r in drops.where("reason IS NOT NULL").collect()] == [(3, None, "no droplets that pass the screens and peel among 56")]
    for limit in (0, 20_000):
        assert rows_of(codec.peeled(drops, limit)) == rows_of(segs.where("file_id = 0"))
        assert rows_of(codec.peeled(drops.limit(0), limit)) == []


def test_lost_empty_and_wide_droplets(spark):
    rows = [(1, None, "AB"), (1, [0], None), (1, [], "AB"), (1, [0, 1], "FFFFFFFFF0"), (1, [1], "0123456789"), (1, [1], "0123456789"), (2, [7], "")]
    found = spark.createDataFrame(rows, "file_id long, members array<long>, hex string").withColumn("packet", F.lit(1)).withColumn("w", F.lit(2))
    want = [(1, 0, f"{0xFFFFFFFFF0 ^ 0x0123456789:010X}"), (1, 1, "0123456789"), (2, 7, "")]
    assert rows_of(codec.peeled(found, limit=0)) == rows_of(codec.peeled(found)) == want
