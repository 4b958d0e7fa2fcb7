"""Files through all steps of a codec by batch, against plain versions; what a round trip shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators import codec
from helixlake.sources import readers


def files(spark):
    rng = random.Random(8)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 14, 15, 16, 700, 3_000)] + [b"\xff" * 60, None]
    return spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts)], "file_id long, data binary").coalesce(2)


@pytest.mark.parametrize("scheme", codec.SCHEMES)
@pytest.mark.parametrize("ecc", ["none", "hamming", "reed_solomon"])
def test_strands_are_those_of_one_column_after_another(spark, scheme, ecc):
    layout = codec.Layout(scheme, ecc, 120, 16)
    got = {(r["file_id"], r["pos"]): r["seq"] for r in codec.encode_files(files(spark), layout).collect()}
    bits = codec.with_index(readers.bit_segments(files(spark), "file_id", F.col("data")), 16)
    one = F.col("bits")
    if ecc == "hamming":
        one = codec.hamming_insert(one, layout.indexed)
    elif ecc == "reed_solomon":
        one = codec.seqfn.hex_to_bits(codec.rs_insert(codec.seqfn.bits_to_hex(one), 3))
    want = bits.select("file_id", "seg_no", codec.SCHEMES[scheme].encode(F.rpad(one, layout.padded, "0")).alias("seq"))
    assert got == {(r["file_id"], r["seg_no"]): r["seq"] for r in want.collect()}
    whole = codec.decode_files(codec.encode_files(files(spark), layout).repartition(3), layout, files(spark).select("file_id", readers.bit_size(F.col("data")).alias("bit_size")), facts=True)
    back = {r["file_id"]: r for r in whole.collect()}
    data = {r["file_id"]: bytes(r["data"] or b"") for r in files(spark).collect()}
    assert {k: bytes(r["data"]) for k, r in back.items()} == {k: d for k, d in data.items() if d}
    runs = lambda s: max((len(x) for x in codec_runs(s)), default=0)
    for k, r in back.items():
        mine = [s for (f, _), s in got.items() if f == k]
        assert (r["longest"], r["bases"], r["strands"]) == (max(map(runs, mine)), True, len(mine))


def codec_runs(s):
    out = []
    for c in s:
        if out and out[-1][-1] == c:
            out[-1] += c
        else:
            out.append(c)
    return out


def test_segments_that_follow_one_another_are_one_row_of_the_exchange(spark):
    layout = codec.Layout("base", "none", 120, 16)
    one = spark.createDataFrame([(1, bytearray(b"x" * 15_000))], "file_id long, data binary").coalesce(1)
    back = codec.decode_files(codec.encode_files(one, layout), layout, spark.createDataFrame([(1, 120_000)], "file_id long, bit_size long"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 3  # there, back and together; no column goes to Python and back
    assert len(bytes(back.first()["data"])) == 15_000
    cut = list(readers.cut_bits(codec.pa.array([b"x" * 15_000]), 120))
    batch = codec._runs(codec.pa.array([1] * 1_000), codec.pa.array(cut[1]), codec.flat.rows_of(48 + cut[2]), None)
    assert batch.num_rows == 1 and batch.column("packed")[0].as_py() == b"x" * 15_000


def test_odd_strands_decode_as_column_by_column(spark):
    rng = random.Random(9)
    layout = codec.Layout("base", "hamming", 24, 8)
    good = [r["seq"] for r in codec.encode_files(spark.createDataFrame([(1, bytearray(b"some bytes to be carried"))], "file_id long, data binary"), layout).collect()]
    odd = good + [s[:-3] for s in good] + [s + "AC" for s in good] + [s[:4] + "N" + s[5:] for s in good] + ["", None, "A", "".join(rng.choice("ACGT") for _ in range(19))]
    rows = spark.createDataFrame([(1, s) for s in odd], "file_id long, seq string").coalesce(1)
    bits = rows.select("file_id", F.substr(codec.base_decode(F.col("seq")), F.lit(1), F.lit(layout.coded)).alias("bits"))
    data, wrong = codec.hamming_remove(F.col("bits"), layout.indexed)
    want = codec.without_index(bits.select("file_id", data.alias("bits"), wrong.alias("wrong")), 8)
    names = ["file_id", "seg_no", "bits", "wrong"]
    assert [tuple(r) for r in codec.decode_segments(rows, layout).select(names).collect()] == [tuple(r) for r in want.select(names).collect()]
