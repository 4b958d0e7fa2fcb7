"""Codecs by batch against plain versions, on damaged, odd and missing values."""

import random

from pyspark.sql import functions as F

from helixlake.functions import seqfn
from helixlake.operators import codec


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").repartition(3)
    return [r["y"] for r in sorted(rows.select("i", make(F.col("x")).alias("y")).collect())]


def test_reed_solomon_rows_are_those_of_one_word_at_a_time(spark):
    code, rng, words = codec.ReedSolomon(3), random.Random(5), [None]
    for k in range(300):
        word = bytearray(code.encode(bytes(rng.randrange(256) for _ in range(rng.choice([1, 4, 17])))))
        for _ in range(k % 4):
            word[rng.randrange(len(word))] ^= rng.randrange(1, 256)
        words.append(bytes(word).hex().upper())
    got = column(spark, words, codec.rs_remove)
    assert [r and tuple(r) for r in got[1:]] == [(d.hex().upper(), g) for d, g in (code.decode(bytes.fromhex(w)) for w in words[1:])]
    assert column(spark, words, codec.rs_insert)[1:] == [code.encode(bytes.fromhex(w)).hex().upper() for w in words[1:]]


def test_schemes_are_numpy_and_give_bits_back(spark):
    rng = random.Random(6)
    bits = ["".join(rng.choice("01") for _ in range(n)) for n in (0, 16, 144, 1600)] + [None, "1" * 144, "0" * 144]
    for name, scheme in codec.SCHEMES.items():
        there = column(spark, bits, scheme.encode)
        assert [b and b[: len(a)] for a, b in zip([x or "" for x in bits], column(spark, there, scheme.decode), strict=True)] == bits, name
    plan = spark.range(1).select(codec.goldman_encode(F.lit("00"))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan or "PythonUDF" in plan


def test_goldman_stops_at_a_base_that_repeats(spark):
    whole = column(spark, ["00FF10"], codec.goldman_encode)[0]
    hurt = whole[:7] + whole[6] + whole[8:]
    assert column(spark, [whole, hurt, "", None], codec.goldman_decode) == ["00FF10", "00", "", None]


def test_reassembly_packs_bits_of_any_length_and_takes_one_of_equal_numbers(spark):
    parts = [(1, 1, "1010"), (1, 0, "0100"), (1, 0, "0100"), (1, 2, "01000001"), (2, 0, "01000001" * 2), (2, 1, "01000010")]
    sizes = spark.createDataFrame([(1, 16), (2, 24)], "file_id long, bit_size long")
    back = codec.reassembled(spark.createDataFrame(parts, "file_id long, seg_no long, bits string"), sizes)
    assert {r["file_id"]: bytes(r["data"]) for r in back.collect()} == {1: b"JA", 2: b"AAB"}
    assert "packed" in back._jdf.queryExecution().executedPlan().toString()


def test_a_code_of_another_length_is_no_error_of_the_batch(spark):
    word = column(spark, ["1011"], lambda c: codec.hamming_insert(c, 4))[0]
    flipped = word[:4] + ("1" if word[4] == "0" else "0") + word[5:]
    rows = spark.createDataFrame(list(enumerate([word, flipped, word[:3], None])), "i long, x string").coalesce(1)
    data, wrong = codec.hamming_remove(F.col("x"), 4)
    assert [tuple(r) for r in rows.select(data, wrong).collect()] == [("1011", False), ("1011", True), (word[2], None), (None, None)]
    assert column(spark, ["0041ff", "", None], lambda c: seqfn.bits_to_hex(seqfn.hex_to_bits(c))) == ["0041FF", "", None]
