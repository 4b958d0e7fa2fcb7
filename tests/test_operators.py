"""Golden values, properties and brute force on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import seqfn
from helixlake.operators import cluster, codec, consensus, evaluate, greedy, jobs, metrics, primers, simulate
from helixlake.sources import readers, writers

#: The default primer pair.
PAIR = ("AAGGCAAGTTGTTACCAGCA", "TGCGACCGTAATCAAACCAA")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_label_metrics_golden(spark):
    # Label vectors and their scores.
    t, p = [1, 1, 1, 1, 2, 2, 2, 3, 3], [11, 11, 4, 11, 22, 111, 22, 22, 4]
    table = metrics.contingency(spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int"))
    r = metrics.agreement(table).first()
    for name, value in {"nmi": 0.585799, "ami": 0.320947, "ari": 0.313559, "fmi": 0.478091, "homogeneity": 0.654804, "completeness": 0.529952, "v_measure": 0.585799, "purity": 0.777778}.items():
        assert abs(r[name] - value) < 1e-6, name
    assert abs(metrics.assignment_accuracy(table) - 0.666667) < 1e-6


def test_label_metrics_of_one_cluster_each(spark):
    r = metrics.agreement(metrics.contingency(spark.createDataFrame([(1, 5)] * 4, "t int, p int"))).first()
    assert (r["nmi"], r["ami"], r["homogeneity"], r["completeness"], r["purity"]) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_labels_permuted_change_nothing(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(4)) for _ in range(200)]
    a = metrics.agreement(metrics.contingency(spark.createDataFrame(rows, "t int, p int"))).first()
    b = metrics.agreement(metrics.contingency(spark.createDataFrame([((t * 3 + 1) % 5, 9 - p) for t, p in rows], "t int, p int"))).first()
    assert all(abs(a[n] - b[n]) < 1e-9 for n in ("nmi", "ami", "ari", "fmi", "purity"))


def test_best_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(30):
        c = rng.integers(0, 20, (5, 5)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        assert c[np.arange(5), metrics.best_assignment(c)].sum() == best


def test_consensus_of_a_known_alignment(spark):
    rows = [
        "AAACAGAATTCCAG-TCTGA", "AAACAGAATT-CAG-TCTGA", "AAGTAGAATTCCAGGTCTGA", "AAACAGAATTCCAG-TCTGA",
    ]
    df = spark.createDataFrame([(1, r) for r in rows], "cluster int, aligned string")
    assert consensus.votes(df).first()["seq"] == "AAACAGAATTCCAGTCTGA"


def test_vote_ties_go_to_the_first_symbol_and_gaps_weigh_half(spark):
    df = spark.createDataFrame([(1, "CT-"), (1, "AG-"), (1, "AG-"), (1, "CTA")], "cluster int, aligned string")
    assert consensus.votes(df).first()["seq"] == "AG"
    df = spark.createDataFrame([(1, "-"), (1, "-"), (1, "A")], "cluster int, aligned string")
    assert consensus.votes(df).first()["seq"] == "A"


def test_star_alignment_recovers_a_strand_with_gaps(spark):
    strand = "ACGTTGCAAGGCTTACGATCCGATTACAGGCATGCA"
    reads = [strand[:k] + strand[k + 1 :] for k in (3, 9, 17, 25, 30)] + [strand]
    out = consensus.star_align(reads)
    assert len({len(x) for x in out}) == 1 and [x.replace("-", "") for x in out] == reads
    df = spark.createDataFrame([("c", i, r) for i, r in enumerate(reads)], "cluster string, member int, seq string")
    assert consensus.consensus(df).first()["seq"] == strand
    many = spark.createDataFrame([("c", i, reads[i % len(reads)]) for i in range(60)], "cluster string, member int, seq string")
    assert consensus.consensus(many, limit=10).first()["seq"] == strand


def test_melting_temperature_and_gc_golden(spark):
    rows = spark.createDataFrame([(p,) for p in PAIR], "seq string").select(F.round(seqfn.melting_temp("seq"), 2).alias("tm"), seqfn.gc_fraction("seq").alias("gc")).collect()
    assert [r["tm"] for r in rows] == [52.07, 52.36] and [r["gc"] for r in rows] == [0.45, 0.45]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("AAACCCCGT",), ("",), ("NNA",), ("CAT",)], "seq string")
    rows = df.select("seq", seqfn.revcomp("seq").alias("rc"), seqfn.revcomp(seqfn.revcomp("seq")).alias("back"), seqfn.longest_run("seq").alias("run"), seqfn.gc_fraction("seq").alias("gc"), seqfn.kmer_code("seq").alias("code")).collect()
    assert [r["run"] for r in rows] == [4, 0, 1, 1] and rows[0]["rc"] == "ACGGGGTTT" and all(r["back"] == r["seq"] for r in rows)
    assert rows[1]["gc"] is None and rows[2]["code"] == -1 and rows[3]["code"] == 49


def test_intra_distance_with_repeated_reads(spark):
    rows = [("a", 1, "ACGT"), ("a", 2, "ACGT"), ("a", 3, "AC"), ("b", 1, "A")]
    got = {r["cluster"]: r["distance"] for r in metrics.intra_distance(spark.createDataFrame(rows, "cluster string, member int, seq string")).collect()}
    assert abs(got["a"] - (0 + 2 + 2) / 3) < 1e-12 and got["b"] == 0.0


def test_recovery_and_reconstruction_rate(spark):
    orig = spark.createDataFrame([(0, "ACGTAC"), (1, "TTTTTT")], "pos int, seq string")
    found = spark.createDataFrame([("ACGTAC",), ("ACGTAC",), ("ACGTAA",)], "seq string")
    r = metrics.recovery(orig, found).first()
    assert (r["fraction"], r["redundancy"]) == (0.5, 2.0)
    rates = metrics.reconstruction_rate(orig, found)
    assert abs(metrics.mean_rate(rates).first()["rate"] - (1 + 1 + 5 / 6) / 3) < 1e-12
    none = metrics.recovery(orig, found.limit(0)).first()
    assert (none["fraction"], none["redundancy"]) == (0.0, 0.0)


def test_collisions_against_all_windows(spark):
    rng = random.Random(5)
    payload = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(25)]
    for k, p in enumerate(PAIR):
        payload[k] = payload[k][:20] + p[2:9] + "A" + p[10:16] + payload[k][34:]
    want = set()
    for i, p in enumerate(PAIR):
        for j, s in enumerate(payload):
            for a in range(len(p) - 11):
                w = p[a : a + 12]
                for b in range(len(s) - 9):
                    full, tail = s[b : b + 12], s[b + 12 : b + 14]
                    if len(full) == 12 and lev(w, full) <= 2 or len(tail) == 2 and tail == w[10:] and lev(w, s[b : b + 10]) <= 2:
                        want.add((i, j))
    pr = spark.createDataFrame(list(enumerate(PAIR)), "id int, seq string")
    pay = spark.createDataFrame([(0, j, s) for j, s in enumerate(payload)], "file_id int, pos int, seq string")
    assert {(r["primer_id"], r["pos"]) for r in primers.collisions(pr, pay).collect()} == want and want


def test_design_meets_every_rule(spark):
    p = primers.PrimerParams()
    rows = [r["seq"] for r in primers.design(primers.candidates(spark.range(750), "id", 8), p).collect()]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert 2 <= len(rows) <= p.number
    for a, b in itertools.combinations(rows, 2):
        assert sum(x != y for x, y in zip(a, b, strict=True)) >= p.hamming
        assert not {a[k : k + p.inter] for k in range(11)} & {rc(b)[k : k + p.inter] for k in range(11)}
    for s in rows:
        assert 0.45 <= (s.count("G") + s.count("C")) / 20 <= 0.55 and not any(x * 4 in s for x in "ACGT")
        assert not any(s[k : k + p.intra] in rc(s) for k in range(17))
    with pytest.raises(ValueError):
        primers.PrimerParams(gc_low=0.9)


def test_primers_added_and_removed(spark):
    df = spark.createDataFrame([(0, 0, "ACGT"), (0, 1, "")], "file_id int, pos int, seq string")
    assert [r["seq"] for r in primers.remove(primers.add(df, "AAA", "CC"), 3, 2).collect()] == ["ACGT", ""]
    assert [r["seq"] for r in primers.remove(df, 0, 0).collect()] == ["ACGT", ""]
    assert [r["seq"] for r in primers.remove(df, 0, 0, as_published=True).collect()] == ["", ""]


@pytest.mark.parametrize("scheme,ecc", [(s, e) for s in codec.SCHEMES for e in ("none", "hamming", "reed_solomon")])
def test_every_codec_round_trips(spark, scheme, ecc):
    data = [(0, bytes(range(256))), (1, b"a"), (2, "Zürich – ACGT".encode())]
    rows = spark.createDataFrame(data, "file_id long, data binary")
    layout = codec.Layout(scheme, ecc, 96, 16)
    strands = codec.encode_files(rows, layout)
    sizes = rows.select("file_id", readers.bit_size(F.col("data")).alias("bit_size"))
    back = {r["file_id"]: bytes(r["data"]) for r in codec.decode_files(strands.orderBy(F.desc("pos")), layout, sizes).collect()}
    assert back == dict(data)
    if scheme in ("goldman",):
        assert not strands.where(seqfn.has_run("seq", 2)).count()


def test_strict_layouts_refuse_misfits(spark):
    rows = spark.createDataFrame([(0, b"abc")], "file_id long, data binary")
    with pytest.raises(ValueError, match="divisible by 16"):
        codec.encode_files(rows, codec.Layout("grass", "none", 60, 5), strict=True)
    with pytest.raises(ValueError):
        codec.Layout("none such", "none", 60, 5)


def test_reed_solomon_corrects_up_to_half_its_checks():
    rng = random.Random(2)
    for checks in (2, 3, 6, 10):
        code = codec.ReedSolomon(checks)
        for _ in range(40):
            data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40)))
            word = bytearray(code.encode(data))
            for k in rng.sample(range(len(word)), min(len(word), rng.randrange(checks // 2 + 1))):
                word[k] ^= rng.randrange(1, 256)
            assert code.decode(bytes(word)) == (data, True)


def test_fountain_peels_back_to_its_segments(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789ABCDEF") for _ in range(30)) for _ in range(40)]
    segs = spark.createDataFrame([(7, k, h) for k, h in enumerate(hexes)], "file_id long, seg_no long, hex string")
    drops = codec.droplets(segs, segs.groupBy("file_id").agg(F.count("*").alias("total")), redundancy=2.0, gc=(0.2, 0.8), longest_run=6)
    back = {r["seg_no"]: r["hex"] for r in codec.peeled(drops).collect()}
    assert all(hexes[k] == h for k, h in back.items()) and len(back) >= 30


def test_no_errors_at_rate_zero_and_determinism(spark):
    rows = spark.createDataFrame([(0, 0, 0, "ACGTACGTAA"), (0, 1, 0, "")], "file_id int, pos int, copy int, seq string")
    rates = {b: {"s": 0.1, "i": 0.1, "pi": 0.1, "d": 0.1, "ld": 0.1} for b in "ACGT"}
    assert [r["read"] for r in simulate.with_errors(rows, {"s": 0.0}, rates, 1).orderBy("pos").collect()] == ["ACGTACGTAA", ""]
    noisy = lambda: [r["read"] for r in simulate.with_errors(rows, {"s": 0.3}, rates, 1).orderBy("pos").collect()]
    assert noisy() == noisy()
    with pytest.raises(ValueError):
        simulate.with_errors(rows, {"s": 0.9}, rates, 1)


def test_error_fold_against_a_plain_walk(spark):
    import hashlib

    rng = random.Random(9)
    rates = {b: {"s": 0.3, "i": w, "pi": 0.3, "d": 0.3, "ld": 0.2} for b, w in zip("ACGT", (0.1, 0.2, 0.3, 0.4), strict=True)}
    total = {"d": 0.1, "ld": 0.05, "i": 0.1, "s": 0.1}
    strands = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60))) for _ in range(60)]

    def pick(u, options):
        at, w = 0.0, sum(x for _, x in options)
        for v, x in options[:-1]:
            at += x / w
            if u < at:
                return v
        return options[-1][0]

    def read_of(pos, strand):
        """Over the original positions: what was put out so far and what is still to come make the strand's length."""
        out, skip = [], 0
        for j, base in enumerate(strand, 1):
            if skip:
                skip -= 1
                continue
            draws = hashlib.md5(f"5|0|{pos}|0|{j}".encode()).hexdigest()
            happens, which, value = (int(draws[k : k + 8], 16) / 2**32 for k in (0, 8, 16))
            now = len(out) + len(strand) - j + 1
            if happens >= sum(total.values()) * (1.5 if 3 * len(out) <= now else 0.75):
                out.append(base)
                continue
            kind = pick(which, [(k, rates[base][k]) for k in ("s", "pi", "d", "ld")])
            if kind == "s":
                out.append(simulate.OTHERS[base][int(value * 3)])
            elif kind == "pi":
                out += [pick(value, [(x, rates[x]["i"]) for x in "ATGC"]), base]
            elif kind == "ld":
                skip = pick(value, list(simulate.LONG)) - 1
        return "".join(out)

    rows = spark.createDataFrame([(0, k, 0, s) for k, s in enumerate(strands)], "file_id int, pos int, copy int, seq string")
    got = {r["pos"]: r["read"] for r in simulate.with_errors(rows, total, rates, 5).collect()}
    assert got == {k: read_of(k, s) for k, s in enumerate(strands)}


def test_copies(spark):
    rows = spark.createDataFrame([(0, k, "A") for k in range(300)], "file_id int, pos int, seq string")
    c = [r["copies"] for r in simulate.copies_skewed(rows, 5, 10, 1).collect()]
    assert min(c) == 5 and max(c) == 14
    assert [r["copies"] for r in simulate.copies_skewed(rows.limit(1), 5, 10, 1).collect()] == [5]
    d = [r["copies"] for r in simulate.copies_from_density(rows, "exp(-(x - 10) * (x - 10) / 8)", 0, 20, 1).collect()]
    assert 9 < sum(d) / len(d) < 11
    with pytest.raises(ValueError):
        simulate.copies_from_density(rows, "(select 1)", 0, 1, 1)
    assert simulate.parse_rate({"A": {"s": "2E-3"}}) == {"A": {"s": 0.002}}


def test_density_draws_use_every_cell_of_the_grid(spark):
    import hashlib

    rows = spark.createDataFrame([(0, k, "A") for k in range(400)], "file_id int, pos int, seq string")
    got = {r["pos"]: r["copies"] for r in simulate.copies_from_density(rows, "x", 0, 1000, 4).collect()}
    cells = [k + 0.5 for k in range(2000)]
    sums = list(itertools.accumulate(c / sum(cells) for c in cells))
    for pos in range(400):
        u = int(hashlib.md5(f"4|c|0|{pos}".encode()).hexdigest()[:8], 16) / 2**32
        assert got[pos] == round((next((k for k, c in enumerate(sums) if c >= u), 1999) + 0.5) * 0.5)
    assert len(set(got.values())) > 250


def test_stutter_repeats_and_deletes(spark):
    rows = spark.createDataFrame([(0, k, 0, "ACGT" * 10) for k in range(30)], "file_id int, pos int, copy int, seq string")
    reads = [r["read"] for r in simulate.with_stutter(rows, {b: {"i": 0.5, "s": 0.0} for b in "ACGT"}, 3).collect()]
    mean = sum(map(len, reads)) / len(reads)
    assert 30 < mean < 50 and set("".join(reads)) == set("ACGT")
    long = [r["read"] for r in simulate.with_stutter(rows, {b: {"i": 0.9999, "s": 0.0} for b in "ACGT"}, 3).collect()]
    assert max(len(list(g)) for r in long for _, g in itertools.groupby(r)) > 20_000  # no run is cut
    with pytest.raises(ValueError):
        simulate.with_stutter(rows, {"A": {"i": 1.0}}, 3)


def test_blocks_of_an_origin_and_its_reads(spark):
    rows = spark.createDataFrame([(1, 0, "AC", 1, "AG"), (1, 0, "AC", 0, "AC")], "file_id int, pos int, seq string, copy int, read string")
    assert [r["line"] for r in simulate.origin_blocks(rows).orderBy("k").collect()] == ["AC", "*" * 29, "AC", "AG", "", ""]


def plain_cores(rows, prefix, size=20, middle=10, drift=2, centre=40, most=3, new_core=8):
    """The sequential clustering by lists, within each prefix."""
    out, groups = {}, {}
    for read_id, seq in sorted(rows):
        cores = groups.setdefault(seq[:prefix], [])
        apart = lambda a, b: sum(x != y for x, y in itertools.zip_longest(a, b))
        parts = lambda d, seq=seq: {"head": seq[:size], "tail": seq[-size:], "c": seq[centre - d : centre - d + middle], "d": seq[len(seq) - centre - 2 - d :][:middle]}
        tried = [[(apart(parts(0)[name], core[1][name]), k) for k, core in enumerate(cores)] for name in ("head", "tail")]
        tried.append([(apart(parts(d)[name], core[1][name]), i, k) for i, (d, name) in enumerate((d, name) for d in range(-drift, drift + 1) for name in "cd") for k, core in enumerate(cores)])
        for how, found in zip(("head", "tail", "middle"), tried, strict=True):
            best = min(found, default=(1000, -1))
            if best[0] < most:
                out[read_id] = (cores[best[-1]][0], how)
                break
        else:
            if best[0] >= new_core:
                cores.append((read_id, parts(0)))
                out[read_id] = (read_id, "new")
            else:
                out[read_id] = (None, "dropped")
    return out


def test_sequential_cores_against_plain_lists(spark):
    rng = random.Random(21)
    rows = []
    for c in range(25):
        s = "ACGT"[c % 2] + "".join(rng.choice("ACGT") for _ in range(99))
        for k in range(8):
            t = list(s)
            for _ in range(rng.choice([0, 2, 9, 30])):
                t[rng.randrange(1, 100)] = rng.choice("ACGT")
            if k % 3 == 0:
                del t[rng.randrange(1, len(t))]
            if k == 4:
                t[1:20] = [rng.choice("ACGT") for _ in range(19)]
            rows.append((f"{rng.randrange(10**6):06d}-{c}-{k}", "".join(t)))
    got = {r["read_id"]: (r["core"], r["how"]) for r in cluster.sequential_cores(spark.createDataFrame(rows, "read_id string, seq string"), 1).collect()}
    assert got == plain_cores(rows, 1) and {how for _, how in got.values()} == {"new", "head", "tail", "middle", "dropped"}


def test_fuzzy_step_by_hand(spark):
    cores = spark.createDataFrame([(1, "AAAA"), (2, "ATCG"), (3, "AGCG"), (4, "ACCT"), (5, "AACC")], "label int, word string")
    words = spark.createDataFrame([(1, "AAAA"), (2, "TTCG"), (3, "ATTG"), (4, "AAGA"), (5, "AAAG"), (6, "ATCC"), (7, "CTCG"), (8, "ACCG")], "id int, word string")
    got = {r["id"]: (r["at"], r["nexts"]) for r in cluster.fuzzy_step(words, cores).collect()}
    assert got == {2: (0, "A"), 3: (2, "C"), 4: (2, "A"), 5: (3, "A"), 6: (3, "G"), 7: (0, "A"), 8: (3, "T")}


def test_words_that_differ_little_share_a_key(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        w, most = "".join(rng.choice("ACGT") for _ in range(rng.choice([7, 20, 33]))), rng.randrange(1, 4)
        t = list(w)
        for i in rng.sample(range(len(w)), most):
            t[i] = rng.choice("ACGT")
        rows.append((k, w, "".join(t), most))
    df = spark.createDataFrame(rows, "k int, a string, b string, most int")
    for most in (1, 2, 3):
        shared = df.where(F.col("most") == most).select(F.arrays_overlap(seqfn.near_keys(F.col("a"), most), seqfn.near_keys(F.col("b"), most)).alias("x"))
        assert all(r["x"] for r in shared.collect())


def test_greedy_stars_in_rounds_equal_one_sequence(spark):
    rng = random.Random(12)
    edges = sorted({(rng.randrange(6), c * 100 + min(a, b), c * 100 + max(a, b)) for c in range(9) for a, b in [rng.sample(range(12), 2) for _ in range(25)]})
    stars = {}
    for _, u, v in edges:
        if u not in stars and v not in stars:
            stars[u] = [v]
        else:
            for one, other in ((u, v), (v, u)):
                if one in stars:
                    stars[one].append(other)
    got = sorted((r["centre"], r["read"]) for r in greedy.greedy_stars(spark.createDataFrame(edges, "band int, centre long, read long")).collect())
    assert got == sorted((c, r) for c, rs in stars.items() for r in rs)


def test_cores_are_voted_down_by_many_reads_only(spark):
    cores = spark.createDataFrame([(1, "AAAAAA"), (2, "CCCCCC"), (3, "GGGGGG")], "id int, seq string")
    reads = [(1, "AATAAA")] * 6 + [(1, "AAAAAA")] * 9 + [(2, "CCTCCC")] * 5 + [(3, "GGTGGG")] * 6 + [(3, "GGGGGA")] * 7
    got = {r["id"]: r["seq"] for r in cluster.corrected_cores(cores, spark.createDataFrame(reads, "id int, b string")).collect()}
    assert got == {1: "AATAAA", 2: "CCCCCC", 3: "GGGGGA"}


def test_run_report_counts_stages(spark):
    rng = random.Random(2)
    strands = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(10)]
    reads = [(f"{c}-{k}", s) for c, s in enumerate(strands) for k in range(8 if c < 6 else 2)]
    r = cluster.run_report(spark.createDataFrame([(s,) for s in strands], "seq string"), spark.createDataFrame(reads, "read_id string, seq string")).first()
    assert (r["originals"], r["reads"], r["clusters"], r["good"], r["bad"], r["merged"], r["final"]) == (10, 56, 10, 6, 4, 10, 10) and r["seconds"] > 0


def test_reed_solomon_words_vanish_at_the_generators_roots():
    def times(a, b):
        out = 0
        while b:
            out, a, b = out ^ (a if b & 1 else 0), (a << 1) ^ (0x11D if a & 0x80 else 0), b >> 1
        return out

    code, rng = codec.ReedSolomon(3), random.Random(7)
    for _ in range(30):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 60)))
        word = code.encode(data)
        assert word[: len(data)] == data and len(word) == len(data) + 3
        zeros = 0
        for power in range(4):  # roots from the 0th or the 1st power of 2
            x, y = 1, 0
            for _ in range(power):
                x = times(x, 2)
            for c in word:
                y = times(y, x) ^ c
            zeros += y == 0
        assert zeros >= 3


def test_goldman_strands_turn_codes_into_other_bases(spark):
    texts = [b"a", b"\x00\xff" * 9, bytes(range(256))]
    rows = spark.createDataFrame([(t.hex().upper(),) for t in texts], "h string")
    codes = codec.ternary_codes()
    assert len(set(codes)) == 256 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    for t, r in zip(texts, rows.select(codec.goldman_encode(F.col("h")).alias("s"), codec.goldman_decode(codec.goldman_encode(F.col("h"))).alias("back")).collect(), strict=True):
        assert all(a != b for a, b in zip(r["s"], r["s"][1:], strict=False)) and set(r["s"]) <= set("ACGT")
        assert len(r["s"]) == sum(len(codes[b]) for b in t) and r["back"] == t.hex().upper()


def test_index_length_and_bases_as_digits(spark):
    rows = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 0)], "file_id int, seg_no int")
    assert {r["file_id"]: (r["total"], r["index_length"]) for r in codec.index_length(rows).collect()} == {1: (5, 3), 2: (1, 1)}
    assert spark.range(1).select(seqfn.nt_to_hex(F.lit("AAACGTTT"))).first()[0] == "01BF"
    jobs_rows = spark.createDataFrame([(1, 7, "x"), (3, 7, "x"), (2, 7, "y")], "id int, user int, dataType string")
    assert [r["id"] for r in jobs.latest_of(jobs_rows, 7, "x").collect()] == [3]


def test_a_report_has_all_six_series(spark):
    import json

    from helixlake.plans.queries import QUERIES

    out = json.loads(QUERIES["eva7_report_json"](spark, "/root/testdata/sf0.001").first()["report"])
    n = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert list(out["yAxis"]) == ["density", "longest_run", "motifs", "mean_gc", "local_gc", "mfe"] and len(out["xAxis"]) == n and all(len(v) == n for v in out["yAxis"].values())


def test_pairs_are_scored(spark):
    lines = spark.createDataFrame([(1, 0, "[(1, 1), (1, 2)]"), (1, 1, "(3, 3)"), (1, 2, "(1, 4)")], "file_id int, pos int, line string")
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "read long, tag string")
    assert tuple(metrics.pair_scores(lines, tags).first()) == (4, 1, 2, 2, 0.75)


def test_stutter_keeps_bases(spark):
    rows = spark.createDataFrame([(0, k, 0, "ACGT" * 10) for k in range(3)], "file_id int, pos int, copy int, seq string")
    assert all(r["read"] == "" for r in simulate.with_stutter(rows, {b: {"i": 0.0, "s": 0.0} for b in "ACGT"}, 3).collect())


def test_drift_clusters_follow_the_truth(spark):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        s = "".join(rng.choice("ACGT") for _ in range(100))
        for k in range(6):
            t = list(s)
            t[rng.randrange(100)] = rng.choice("ACGT")
            rows.append((f"{c:02d}-{k}", "".join(t)))
    got = cluster.drift_clusters(spark.createDataFrame(rows, "read_id string, seq string")).collect()
    assert len(got) == 72 and all(r["read_id"][:2] == r["core"][:2] for r in got) and len({r["core"] for r in got}) == 12
    sk = cluster.hash_sketch_clusters(spark.createDataFrame(rows, "read_id string, seq string")).collect()
    assert len(sk) == 72 and all(r["read_id"][:2] == r["centre"][:2] for r in sk)


def test_local_identity_and_folding():
    assert cluster.local_identity("ACGTACGT", "ACGTACGT") == 8 and cluster.local_identity("AAAA", "CCCC") == 0
    assert evaluate.fold_energy("GGGGCCAAAAGGCCCC") < -5 and evaluate.fold_energy("AAAAAAAAAAAA") == 0.0 and evaluate.fold_energy("") == 0.0


def test_report_json_and_errors(spark):
    import json

    strands = spark.createDataFrame([("f", 0, "GGCAAT"), ("g", 0, "AAAA")], "file_id string, pos int, seq string")
    sizes = spark.createDataFrame([("f", 12), ("g", 8)], "file_id string, bit_size int")
    out = json.loads(evaluate.report_json(evaluate.report(strands, sizes)).first()["report"])
    assert out["xAxis"] == ["f", "g"] and out["yAxis"]["longest_run"] == [2, 4] and out["yAxis"]["density"] == [2.0, 2.0]
    rows = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b")], "id int, user string, file_name string")
    fresh, clash = jobs.insertable(rows, rows.where("file_name = 'b'").select("user", "file_name"))
    assert [r["id"] for r in fresh.collect()] == [1] and sorted(r["id"] for r in clash.collect()) == [2, 3]


def test_text_files_keep_their_order(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(5000))
    (tmp_path / "a.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "a.txt")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line"] for r in rows] == text.split("\n") and [r["pos"] for r in rows] == list(range(5000))
    df = spark.createDataFrame([("x", k, f"ACGT{k}") for k in range(100)], "file_id string, pos int, line string")
    writers.write_lines(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"ACGT{k}" for k in range(100)]


def test_configurations():
    c = readers.TrieConfig.from_text('{\n // length\n "read_len": 200, "head": 10}', tail=5)
    assert (c.read_len, c.head, c.tail) == (200, 10, 5)
    assert readers.TrieConfig.from_args(["-L", "120", "-O", "x"]) == readers.TrieConfig(read_len=120, output="x")
