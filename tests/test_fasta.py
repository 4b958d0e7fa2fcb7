"""Files in parallel: blocks of positions, numbers by ranges, and the data source."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators import preprocess, scan
from helixlake.sources import readers, writers
from helixlake.sources.fasta import FastaSource


@pytest.fixture(scope="module")
def fasta(spark):
    spark.dataSource.register(FastaSource)
    return spark


def parsed(data: bytes):
    """at, header, seq by one walk over a file's bytes."""
    out, at = [], 0
    for line in data.splitlines(keepends=True):
        if line.startswith(b">"):
            out.append([at, line[1:].decode().rstrip("\r\n"), ""])
        elif out:
            out[-1][2] += line.decode().strip()
        at += len(line)
    return [tuple(x) for x in out]


ODD = [b"", b"AC\nGT\n", b">a", b">a\n>b\n", b"junk\n>a x\nAC\nGT\n\n>b\r\nA C\r\n>c\n", b">" + b"h" * 40 + b"\n" + b"ACGT\n" * 9 + b"\n>z\nA", b"x>y\n>q\nA>C\nG\n", ">é\nñ\n>ü\nA".encode()]


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_ranges_of_any_size_give_each_record_once(fasta, tmp_path, size):
    for k, data in enumerate(ODD):
        (tmp_path / f"f{k}.fa").write_bytes(data)
    (tmp_path / "_hidden.fa").write_bytes(b">no\nA\n")
    rows = fasta.read.format("fasta").option("splitBytes", size).load(str(tmp_path)).collect()
    got = sorted((r["file_id"][-5:], r["at"], r["header"], r["seq"]) for r in rows)
    assert got == sorted((f"f{k}.fa", *x) for k, data in enumerate(ODD) for x in parsed(data))


def test_one_file_of_many_records_is_many_tasks(fasta, tmp_path):
    rng = random.Random(3)
    n = 200_000
    lines = "".join(f">r{k}\n{'ACGT'[k % 4] * (k % 7)}\n{rng.choice('ACGT')}\n" for k in range(n))
    (tmp_path / "one.fa").write_text(lines)
    df = fasta.read.format("fasta").option("splitBytes", 200_000).load(str(tmp_path / "one.fa"))
    assert df.rdd.getNumPartitions() >= 10
    r = df.withColumn("part", F.spark_partition_id()).agg(F.count("*"), F.count_distinct("header"), F.sum(F.length("seq")), F.count_distinct("part")).first()
    assert (r[0], r[1], r[2]) == (n, n, sum(k % 7 + 1 for k in range(n))) and r[3] >= 10
    placed = scan.running_counts(df, ["file_id"], "at", 1 << 16, n=F.lit(True))
    assert not placed.where(F.concat(F.lit("r"), (F.col("n") - 1).cast("string")) != F.col("header")).count()


def test_written_records_come_back_and_overwriting_replaces(fasta, tmp_path):
    rows = [(f"h{k}", "ACGT" * (k % 5), k) for k in range(100)] + [(None, None, 1)]
    df = fasta.createDataFrame(rows, "header string, seq string, more int").repartition(4)
    at = str(tmp_path / "out")
    read = lambda: sorted((r["header"], r["seq"]) for r in fasta.read.format("fasta").load(at).collect())
    want = sorted((h or "", s or "") for h, s, _ in rows)
    df.write.format("fasta").mode("append").save(at)
    assert read() == want
    df.write.format("fasta").mode("append").save(at)
    assert read() == sorted(want * 2)
    df.write.format("fasta").mode("overwrite").save(at)
    assert read() == want and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_a_failed_job_leaves_nothing(fasta, tmp_path):
    at = tmp_path / "out"
    bad = fasta.range(100).repartition(4).select(F.lit("h").alias("header"), F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise("A").alias("seq"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("fasta").mode("append").save(str(at))
    assert not at.exists() or not list(at.iterdir())
    with pytest.raises(Exception, match="header and seq"):
        fasta.range(3).write.format("fasta").mode("append").save(str(at))


def test_counts_in_blocks_equal_one_walk(spark):
    rng = random.Random(6)
    rows = [(f, p, rng.random() < 0.4, rng.random() < 0.5 if rng.random() < 0.9 else None) for f in ("a", None, "b") for p in sorted(rng.sample(range(-40, 900), 200))]
    df = spark.createDataFrame(rows, "file_id string, pos long, x boolean, y boolean").repartition(7)
    got = {(r["file_id"], r["pos"]): (r["cx"], r["cy"]) for r in scan.running_counts(df.where("file_id IS NOT NULL"), ["file_id"], "pos", 16, cx=F.col("x"), cy=F.col("y")).collect()}
    want, at = {}, {}
    for f, p, x, y in rows:
        if f is not None:
            a, b = at.get(f, (0, 0))
            at[f] = want[f, p] = (a + bool(x), b + bool(y))
    assert got == want


@pytest.mark.parametrize("partitions", [1, 6])
def test_numbers_by_ranges_equal_a_window(spark, partitions):
    rng = random.Random(8)
    rows = [(g, rng.randrange(50), k) for k in range(600) for g in [rng.choice(["hot"] * 6 + ["x", "y", None])]]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(5)
    got = {r["k"]: r["n"] for r in scan.numbered(df, ["g"], [F.desc("o"), "k"], "n", partitions).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[k] = n
    assert got == want
    assert not scan.numbered(df.limit(0), ["g"], ["o"]).count()


def test_one_file_in_blocks_keeps_clusters_and_labels(spark, monkeypatch):
    monkeypatch.setattr(scan.running_counts, "__defaults__", (8,))
    lines = []
    for c in range(30):
        lines.append(f">Seq{c}_Cluster{c}")
        lines += [*["ACGT"[j % 4] + "A" * j for j in range(c % 5)], "====", "n"]
    df = spark.createDataFrame([("f", p, x) for p, x in enumerate(lines)], "file_id string, pos long, line string").repartition(5)
    got = sorted((r["cluster_id"], r["member_no"], r["seq"]) for r in readers.cluster_blocks(df).collect())
    ids = iter(range(30))
    plain = []
    for c in range(30):
        if c % 5:
            i = next(ids)
            plain += [(i, j, "ACGT"[j % 4] + "A" * j) for j in range(c % 5)]
    assert got == plain
    assert sorted((r["position"], r["seq_label"]) for r in preprocess.position_labels(df).collect()) == [(c, c) for c in range(30)]
    members = spark.createDataFrame([("f", c, m, s) for c, m, s in plain], "file_id string, cluster_id int, member_no int, seq string")
    out = [r["line"] for r in writers.cluster_fasta(members).orderBy("pos").collect()]
    assert out == [x for i in range(24) for x in [f">Cluster{i}", *[s for c, _, s in plain if c == i]]]


def test_cluster_lines_of_one_file_over_many_partitions(spark):
    """Numbers and headers go on where a file, or a cluster, goes on in the next partition; files within one need no counts of others."""
    from helixlake.operators.scan import numbered
    from helixlake.sources import writers

    rows = [(f, c, m, f"S{f}.{c}.{m}") for f, cs in ((1, 7), (2, 1), (None, 3)) for c in range(0, 3 * cs, 3) for m in range(40 if f == 2 else 5)] + [(9, 4, 0, None)]
    members = spark.createDataFrame(rows, "file_id long, cluster_id long, member_no int, seq string").repartition(3)
    want = {}
    for f in {r[0] for r in rows}:
        lines = []
        for c in sorted({r[1] for r in rows if r[0] == f}):
            lines += [f">Cluster{c}", *[r[3] for r in rows if r[0] == f and r[1] == c]]
        want |= {(f, k): line for k, line in enumerate(lines)}
    found = writers.cluster_fasta(members)
    assert {(r["file_id"], r["pos"]): r["line"] for r in found.collect()} == want and found.count() == len(want)
    many = numbered(members, ["file_id"], ["cluster_id", "member_no"], partitions=17, kinds=("cluster_id", "c"))
    got = {(r["file_id"], r["r"]): (r["cluster_id"], r["c"], r["c_new"]) for r in many.collect()}
    for f in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == f)
        ids = sorted({c for c, _ in mine})
        assert [got[f, k] for k in range(len(mine))] == [(c, ids.index(c), m == 0) for c, m in mine]
