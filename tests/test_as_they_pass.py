"""Reads and segments that stand together: votes, numbers of FASTA lines and pairs of segments as they pass, equal to those by exchange."""

import random

import pytest
from pyspark.sql import functions as F
from support import SF

from helixlake.operators import codec, consensus
from helixlake.plans.queries import QUERIES
from helixlake.sources import readers, writers


def standing(spark):
    rng = random.Random(3)
    rows = []
    for file in (4, 2, 9, 1):
        for pos in rng.sample(range(60), 40):
            n = 700 if (file, pos) == (2, rows and rows[0][1]) else rng.randrange(1, 7)
            rows += [(file, pos, c, "".join(rng.choice("ACGTN") for _ in range(rng.choice([8, 8, 8, 7])))) for c in range(n)]
    rows.sort(key=lambda r: ((4, 2, 9, 1).index(r[0]), r[1], r[2]))
    return spark.createDataFrame(rows, "file_id long, pos long, copy int, seq string").coalesce(1)


@pytest.mark.parametrize("size", ["7", "64", "10000"])
def test_what_passes_in_order_equals_what_is_exchanged(spark, size):
    rows = standing(spark)
    members = rows.select("file_id", F.col("pos").alias("cluster_id"), F.col("copy").alias("member_no"), (F.col("pos") * 1_000 + F.col("copy")).alias("seq_label"), "seq")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for made in (lambda t: consensus.equal_length_votes(rows, ["file_id", "pos"], together=t), lambda t: writers.cluster_fasta(members, together=t), lambda t: writers.labelled_fasta(members, together=t)):
            passed = made(True)
            assert "Exchange" not in passed._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, passed.collect())) == sorted(map(str, made(False).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_pairs_of_segments_need_no_exchange(spark):
    rng = random.Random(2)
    files = spark.createDataFrame([(k, bytearray(rng.randrange(256) for _ in range(n))) for k, n in enumerate([0, 1, 15, 16, 30, 31, 700])] + [(7, None)], "file_id long, data binary").coalesce(2)
    made = codec.yin_yang_strands(files, 120)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = codec.yin_yang_pairs(readers.bit_segments(files, "file_id", F.col("data"), 120))
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["msa4_votes", "clu9_core_correction", "snk3_cluster_fasta", "snk4_labelled_fasta", "cod13_yin_yang"])
def test_queries_exchange_texts_alone(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("Exchange") <= 1
