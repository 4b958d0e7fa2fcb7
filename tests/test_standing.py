"""Files whose rows stand together are taken up as they pass: the same rows as by exchange."""

from pyspark.sql import functions as F

from helixlake.operators import cluster, simulate
from helixlake.plans import fixtures
from helixlake.sources import readers, writers


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def texts(spark):
    """Files of several rows, empty and null ones, a null key and one of many batches."""
    rows = [(k % 7, f"text {k} " * (k % 5)) for k in range(40)] + [(None, "no key"), (None, "no key"), (50, None), (51, ""), (52, "long one " * 9_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_reads_that_stand_together_are_the_same_reads(spark):
    a, b = (fixtures.reads_of(texts(spark), "doc_id", together=t) for t in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    task = b.withColumn("task", F.spark_partition_id())
    assert task.groupBy("file_id").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()


def test_candidates_are_told_apart_without_an_exchange_of_reads(spark):
    rows = fixtures.reads_of(texts(spark), "doc_id", together=True)
    got = writers.candidate_lines(rows, together=True)
    assert exchanges(got) == exchanges(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, writers.candidate_lines(rows).collect()))


def test_blocks_of_lines_in_order_equal_those_by_position(spark):
    import random

    rng = random.Random(4)
    files = [(k, [rng.choice([">a", ">", "ACGT", "T ", " A", "=", "", "xyz", None, "GG", "C"]) for _ in range(rng.randrange(60))]) for k in [*range(30), None]]
    lines = [(k, p, x) for k, found in files for p, x in enumerate(found)] + [(99, 0, ">long")] + [(99, p, "ACGT") for p in range(1, 25_000)]
    df = spark.createDataFrame(lines, "file_id long, pos long, line string")
    known = df.where("file_id IS NOT NULL")
    want = sorted(map(str, readers.cluster_blocks(known).collect()))
    for n in (1, 3):  # a file's lines may come in many batches, and files one after the other
        placed = df.repartition(n, "file_id").sortWithinPartitions("file_id", "pos")
        got = readers.cluster_blocks_in_order(placed)
        assert exchanges(got) == exchanges(placed)
        assert sorted(str(r) for r in got.collect() if r["file_id"] is not None) == want
        assert got.where("file_id IS NULL").count() > 0  # files without a key are one file


def test_purity_counts_its_reads_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, None), (None, "a")], "core long, tag string")
    got = cluster.purity(rows)
    assert tuple(got.first()) == (6, 2, 3, 3)
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_origin_blocks_in_order_equal_grouped_ones(spark):
    rows = [(f, p, c, "AC" * (p + 1), f"r{f}{p}{c}") for f in (*range(6), None) for p in range(9) for c in range((p * 7 + (f or 0)) % 5)]
    rows += [(9, 0, c, "LONG", f"x{c}") for c in range(25_000)]
    df = spark.createDataFrame(rows, "file_id long, pos long, copy int, seq string, read string")
    want = sorted(map(str, simulate.origin_blocks(df).collect()))
    for n in (1, 3):
        placed = df.repartition(n, "file_id").sortWithinPartitions("file_id", "pos", "copy")
        got = simulate.origin_blocks_in_order(placed)
        assert exchanges(got) == exchanges(placed)
        assert sorted(map(str, got.collect())) == want
    named = fixtures.reads_of(texts(spark), "doc_id", columns=("pos", "origin", "file_id"))
    whole = fixtures.strands_of(texts(spark), "doc_id")
    assert named.columns == ["pos", "origin", "file_id"] and named.count() == fixtures.COPIES * whole.count()
    assert named.select("file_id", "pos", "origin").exceptAll(whole.crossJoin(spark.range(fixtures.COPIES)).drop("id")).isEmpty()


def test_indexed_reads_with_odd_blanks_and_without_splitting(spark):
    lines = ["1 ACGT", "  2 \t AC GT ", "x AC", "\tAC", "3", "", "  ", "4 ACN", "5\tAC\tGT", "6 \t", "99999999999 A", None, "7\nAC"]
    df = spark.createDataFrame([(0, x) for x in lines], "file_id int, line string")
    got = readers.indexed_reads(df)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(1, "ACGT"), (2, "AC GT"), (None, "AC"), (None, "AC"), (5, "AC\tGT"), (6, ""), (None, "A"), (7, "AC")]
    assert sorted(((r["tag"], r["seq"]) for r in got.collect()), key=str) == sorted(want, key=str)
