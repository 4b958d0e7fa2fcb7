"""Choices in rounds equal the sequential ones, whatever hangs together."""

import random

import pytest

from helixlake.operators import cluster, greedy


def plain_centres(asks, holds):
    centres, out = [], {}
    for node in sorted({n for n, _ in asks}):
        keys = {k for n, k in asks if n == node}
        found = [c for c in centres if keys & {k for n, k in holds if n == c}]
        out[node] = found[0] if found else node
        if not found:
            centres.append(node)
    return out


@pytest.mark.parametrize("seed,keys", [(1, 400), (2, 60), (3, 8), (4, 1)])
def test_centres_in_rounds(spark, seed, keys):
    rng = random.Random(seed)
    asks = sorted({(n, rng.randrange(keys)) for n in range(150) for _ in range(3)})
    holds = sorted({(n, k) for n, k in asks if rng.random() < 0.6})
    df = lambda rows: spark.createDataFrame(rows, "node long, key long")
    assert {r["node"]: r["centre"] for r in greedy.greedy_centres(df(asks), df(holds)).collect()} == plain_centres(asks, holds)


def test_a_chain_of_dependence_is_one_component(spark):
    """Each node asks for the key of the one before: every second becomes a centre, and all hang together."""
    asks = [(n, n) for n in range(24)] + [(n, n - 1) for n in range(1, 24)]
    got = greedy.greedy_centres(*(spark.createDataFrame(x, "node long, key long") for x in (asks, [(n, n) for n in range(24)])))
    assert {r["node"]: r["centre"] for r in got.collect()} == {n: n - n % 2 for n in range(24)}


def test_choices_among_nothing(spark):
    empty = spark.createDataFrame([], "node long, key long")
    assert not greedy.greedy_centres(empty, empty).count()
    assert not greedy.greedy_stars(spark.createDataFrame([], "band int, centre long, read long")).count()


def test_stars_of_one_giant_component(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(8), min(a, b), max(a, b)) for a, b in [rng.sample(range(150), 2) for _ in range(500)]})
    stars = {}
    for _, u, v in edges:
        if u not in stars and v not in stars:
            stars[u] = [v]
        else:
            for one, other in ((u, v), (v, u)):
                if one in stars:
                    stars[one].append(other)
    got = greedy.greedy_stars(spark.createDataFrame(edges, "band int, centre long, read long").repartition(6))
    assert sorted(map(tuple, got.collect())) == sorted((c, r) for c, rs in stars.items() for r in rs)


def test_sketches_join_centres_and_not_chains(spark):
    """Reads that share two slots with their neighbour only: components join all, the greedy choice does not."""
    rng = random.Random(7)
    slots = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(12)]
    rows = [(f"r{k:02d}", "".join(slots[(k + j) % 12] if j < 5 else "" for j in range(5))) for k in range(6)]
    rows += [(f"s{k:02d}", "".join(slots[j] if j in (k % 5, (k + 1) % 5) else "".join(rng.choice("ACGT") for _ in range(20)) for j in range(5))) for k in range(10)]
    reads = spark.createDataFrame(rows, "read_id string, seq string")
    sketched = cluster.sketches(reads, start=1, k=14, gap=2, drift=2, size=5)
    got = {r["read_id"]: r["centre"] for r in cluster.greedy_sketches(sketched).collect()}
    codes = {}
    for r in sketched.collect():
        codes.setdefault(r["read_id"], {}).setdefault(r["slot"], []).append((r["drift"], r["code"]))
    digits = lambda c: [(c >> (2 * p)) & 3 for p in range(14)]
    near = lambda a, b: sum(x != y for x, y in zip(digits(a), digits(b), strict=True)) <= 1
    want, centres = {}, []
    for r in sorted(codes):
        shared = lambda c, r=r: sum(any(near(x, y) for _, x in codes[r].get(s, []) for d, y in codes[c][s] if d == 2) for s in codes[c])
        found = [c for c in centres if shared(c) >= 2]
        want[r] = found[0] if found else r
        if not found:
            centres.append(r)
    assert got == want and 1 < len(centres) < len(want)


def test_cores_of_all_reads_in_one_order(spark):
    from test_operators import plain_cores

    rng = random.Random(31)
    founders = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(12)]
    rows = []
    for k in range(220):
        t = list(founders[k % 12] if k % 3 else "".join(rng.choice("ACGT") for _ in range(100)))
        for _ in range(rng.choice([0, 1, 4, 12])):
            t[rng.randrange(100)] = rng.choice("ACGT")
        rows.append((k, "".join(t)))
    got = {r["read_id"]: (r["core"], r["how"]) for r in cluster.sequential_cores(spark.createDataFrame(rows, "read_id long, seq string").repartition(5)).collect()}
    assert got == plain_cores(rows, 0)


def test_a_trie_with_deletes_looks_prefixes_up(spark):
    deltas = [(1, "ACGT", 1), (2, "ACCC", 1), (3, "AC", 1), (2, "ACCC", -1), (4, "GG", -1), (5, "ACGT", 1), (1, "ACGT", -1), (1, "ACGT", 1), (6, None, 1), (7, "", 1)]
    nodes = cluster.trie_nodes(cluster.live_words(spark.createDataFrame(deltas, "label int, word string, sign int")))
    asked = spark.createDataFrame([(p,) for p in ("", "A", "AC", "ACG", "ACC", "GG", "ACGTA")] + [(None,)], "prefix string")
    got = {r["prefix"]: (r["words"], r["label"]) for r in cluster.prefix_lookup(asked, nodes).collect()}
    assert got == {"": (4, 1), "A": (3, 1), "AC": (3, 1), "ACG": (2, 1), "ACC": (0, None), "GG": (0, None), "ACGTA": (0, None), None: (0, None)}


def test_words_that_are_live_twice_under_one_label_are_two_references(spark):
    deltas = [(1, "ACGT", 1), (1, "ACGT", 1), (1, "ACCC", 1), (2, "AC", 1), (2, "AC", 1), (2, "AC", -1)]
    nodes = cluster.trie_nodes(cluster.live_words(spark.createDataFrame(deltas, "label int, word string, sign int")))
    got = {r["prefix"]: (r["words"], r["label"]) for r in cluster.prefix_lookup(spark.createDataFrame([("A",), ("ACG",), ("AC",)], "prefix string"), nodes).collect()}
    assert got == {"A": (4, 1), "ACG": (2, 1), "AC": (4, 1)}


def test_cores_of_hot_prefixes_and_of_the_others_are_one_result(spark):
    """Prefixes with many reads go in rounds against all their cores, the others in a sorted stream; nulls, short reads and letters that are no bases among them."""
    from helixlake.durable import scratch

    rng = random.Random(11)
    seeds = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(12)]
    rows = [(k, "".join(c if rng.random() > 0.1 else rng.choice("ACGT") for c in rng.choice(seeds))) for k in range(900)]
    rows += [(900 + k, s) for k, s in enumerate(["", None, "ACG", "Ä" * 30, "N" * 45, "-" * 80, "ACGT" * 30])]
    reads = spark.createDataFrame(rows, "read_id long, seq string").repartition(4)
    with scratch(spark) as made:
        by_rounds, streamed = (sorted(map(tuple, cluster.sequential_cores(reads, 1, hot=n, prefixes=True).select("read_id", "p", "core", "how").collect()), key=str) for n in (100_000, 0))
        assert not any("cores-state" in path or "cores-settled" in path for path in made)  # reads are not written in each round
    assert by_rounds == streamed and len(by_rounds) == len(rows)
    assert {h for *_, h in streamed} == {"new", "head", "tail", "middle", "dropped"}
