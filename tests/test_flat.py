"""Steps that work on a whole batch of strings at once, against plain versions of them."""

import hashlib

import pytest

from helixlake.functions import seqfn
from helixlake.operators import cluster
from helixlake.plans import fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_strands_and_copies_of_odd_texts(spark):
    texts = [(1, "é\x00z" * 40), (2, ""), (3, None), (4, "a"), (5, "x" * 25)]
    rows = fixtures.strands_of(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id")
    want = []
    for key, text in texts:
        hexed = (text or "").encode().hex().upper()
        for pos in range(-(-len(hexed) // 50)):
            part = hexed[pos * 50 : pos * 50 + 50].ljust(50, "0")
            want.append((key, pos, "".join(seqfn.NT[int(d, 16) // 4] + seqfn.NT[int(d, 16) % 4] for d in part)))
    assert sorted(map(tuple, rows.collect())) == want
    assert "MapInArrow" in plan(rows)


def test_noisy_copies_of_strands_of_any_length(spark):
    strands = [(7, 0, "ACGT" * 25), (7, 1, "AC"), (7, 2, ""), (8, 1_234_567, "GATTACA"), (None, 3, "ACGT"), (9, 4, None)]
    rows = fixtures.noisy(spark.createDataFrame(strands, "file_id long, pos long, seq string"), 3)
    want = []
    for f, p, seq in strands:
        for c in range(3):
            m = hashlib.md5("|".join(str(x) for x in (f, p, c) if x is not None).encode()).hexdigest()
            out = seq
            for k in range(fixtures.DRAWS):
                n = int(m[8 * k : 8 * k + 8], 16)
                if out is not None and n // 100 % 2 and n % 100 < len(out):
                    out = out[: n % 100] + "CGTA"["ACGT".index(out[n % 100])] + out[n % 100 + 1 :]
            name = "-".join(x for x in (None if f is None else str(f), str(p).rjust(6, "0")[:6], str(c)) if x is not None)
            want.append((f, p, c, name, out))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)
    assert "MapInArrow" in plan(rows)


@pytest.mark.parametrize("prefix", [None, 9])
def test_codes_and_signatures_need_no_shuffle(spark, prefix):
    reads = [(1, "ACGTACGTAC"), (2, "ACG"), (3, None), (4, "ACGTNCGTACGTA"), (5, ""), (6, "TTTTTTTTTTT")]
    indexed = cluster.kmer_index(spark.createDataFrame(reads, "read_id long, seq string"), 4, prefix)
    cut = {k: (s or "")[:prefix] for k, s in reads}
    want = {k: [-1 if "N" in s[i : i + 4] else sum("ACGT".index(x) * 4**j for j, x in enumerate(s[i : i + 4])) for i in range(len(s) - 3)] for k, s in cut.items()}
    assert {r["read_id"]: r["codes"] for r in indexed.collect()} == want
    signed = cluster.signatures(indexed, 3, 5)
    assert {r["read_id"]: r["sig"] for r in signed.collect()} == {k: [min((a * c + b) % cluster.PRIME for c in codes) for a, b in cluster.affine(3, 5)] for k, codes in want.items() if codes}
    assert "Exchange" not in plan(signed)


def test_sizes_of_stars_are_those_of_their_edges(spark):
    reads = fixtures.noisy(spark.createDataFrame([(1, k, s) for k, s in enumerate(["ACGT" * 25, "GATTACA" * 10, "AC"])], "file_id long, pos long, seq string"), 6)
    sizes = cluster.star_sizes(reads)
    assert "Join" not in plan(sizes)
    want = cluster.star_edges(reads).groupBy("band", "centre").count()
    assert sorted(map(tuple, sizes.groupBy("band", "centre").sum("edges").collect())) == sorted(map(tuple, want.collect())) != []
