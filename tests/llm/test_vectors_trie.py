"""Hard negatives, nearest neighbours and the prefix trie against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.llm import ann, hard_negatives, prefix_trie, queries

VECTORS = "vec_id long, embedding array<float>, label int, no string, d string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, is_anchor, k=5):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    out = []
    for a, la, x in kept:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), i, lab) for i, lab, y in kept if i != a))  # noqa: B905
        for ps, p, _ in [s for s in scored if s[2] == la][:k]:
            fit = [(i, -s) for s, i, lab in scored if lab != la and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(a, p, r, i, -ps, s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def plain_nearest(rows, is_query, k=5):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.pad(v, (0, width - len(v)))) for i, v in kept]
    return {q: sorted((-(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), i) for i, y in kept if i != q)[:k] for q, x in kept if is_query(q)}


def odd_vectors(seed, n=400, width=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.4) for _ in range(width)], r.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(60)]  # copies
    rows += [(900, None, 1), (901, [1.0, None, 0.5, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 2), (903, [float("inf")] + [0.0] * 5, 0), (904, [0.0] * 6, 1), (905, [], 1), (906, [0.5, 0.25], 2), (907, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("chunk", [10, 2_048])
def test_hard_negatives_equal_all_pairs(spark, chunk):
    rows = odd_vectors(chunk)
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, chunk=chunk, pivots=4, sample=50)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_repeated_rows_count_each_but_never_for_their_own_id(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2), (0, [1.0, 0.0], 1)]
    got = sorted(map(tuple, hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0).collect()))
    # two anchors, two positives each, two negatives for each of these
    assert len(got) == 8 and {r[:2] for r in got} == {(0, 1)} and {r[3] for r in got} == {2}
    assert sorted(map(tuple, ann.nearest(frame(spark, rows), F.col("vec_id") == 0).select("query_id", "rank", "vec_id").collect())) == sorted([(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 2)] * 2)


def test_vectors_of_empty_tables_and_nulls(spark):
    for rows in ([], [(1, None, 1), (None, [1.0], 1), (100, [float("nan")], 1)]):
        assert not hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0).count()
        assert not ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0).count()
    lone = [(100, [1.0, 2.0], 1)]
    assert not hard_negatives.hard_negatives(frame(spark, lone), F.col("vec_id") % 100 == 0).count() and not ann.nearest(frame(spark, lone), F.col("vec_id") % 100 == 0).count()


def test_scores_beyond_exact_integers_are_refused(spark):
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(frame(spark, [(100, [1e9, 1.0], 1)]), F.lit(True))


def test_brackets_hold(spark):
    x = np.floor(np.random.default_rng(1).normal(size=(300, 8)) * 50)
    longest = (x * x).sum(axis=1).max()
    rows = hard_negatives.longer(x, longest)
    p = hard_negatives.spread_pivots(x, longest, 5)
    d = hard_negatives.distances(rows, p)
    for q in x[:20]:
        dq = hard_negatives.distances(np.r_[q, 0.0][None, :], p)[0]
        near, far = np.abs(d - dq).max(axis=1), (d + dq).min(axis=1)
        score = x @ q
        assert (score <= ((q @ q) + longest - near**2) / 2 + 1e-6).all() and (score >= ((q @ q) + longest - far**2) / 2 - 1e-6).all()


@pytest.mark.parametrize("chunk", [10, 2_048])
def test_nearest_on_odd_rows(spark, chunk):
    rows = odd_vectors(5)
    want = plain_nearest(rows, lambda i: i % 20 == 0)
    got = {}
    for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, chunk=chunk, leaf=8, sample=40, recall=0.9999).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, len(near) + 1))
        hits += len({i for _, i in near} & {i for i, _ in got[q].values()})
        total += len(near)
        for i, s in got[q].values():
            assert i != q and s <= 1 + 1e-9
    assert hits >= 0.99 * total


def test_copies_are_ties_by_id(spark):
    rows = [(i, [0.3, 0.7, -0.2], 0) for i in range(500)] + [(1000, [0.3, 0.7, -0.2], 0)]
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(frame(spark, rows), F.col("vec_id") == 1000).orderBy("rank").collect()]
    assert got == [(k + 1, k) for k in range(5)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_the_table(spark, sf):
    from support import SF

    at = SF.replace("sf0.001", sf)
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    want = plain_nearest(rows, lambda i: i % 50 == 0)
    got = queries.op12_nearest(spark, at).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert len(got) == 5 * len(want) and hits >= 0.95 * len(got)
    exact = {(q, i): -s for q, near in want.items() for s, i in near}
    assert all(abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 2) - 5.991464547107979) < 1e-9 and abs(ann.chi_square_quantile(0.99, 8) - 20.090235029663233) < 1e-9


# --- prefix trie ---------------------------------------------------------------------------------


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children, out = {}, {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        below = children.get(key, [])
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", key[-1][1]) if w] if key else []
        out[key] = (sum(out[k][0] for k in below) or (0 if below else 1), (len(nodes[key]) - 1) * len(words) + sum(out[k][1] for k in below))
    rows = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(key)))
        rows.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children.get(key, [])), *out[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, i int").repartition(4)


def random_turns(seed):
    r = random.Random(seed)
    words = ["a", "b c", "", None, "d\te  f"]
    rows = [(c, k, r.choice(["user", None, "bot"]) if r.random() < 0.2 else "user", r.choice(words[:2]) if r.random() < 0.8 else r.choice(words)) for c in range(90) if c not in (20, 21) for k in range(r.randrange(9))]
    rows += [(500, k, "user", "a") for k in range(40)] + [(501, k, "user", "a") for k in range(37)]  # long ones
    rows += [(77, None, "user", "first"), (77, None, None, None), (78, 1, "bot", "b"), (78, 1, "bot", "b"), (None, 1, "user", "a"), (-5, 1, "user", "a"), (-41, 0, "bot", "a")]
    return rows


def nodes_of(df):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("block", [3, 4_096])
def test_trie_equals_a_plain_one(spark, block):
    rows = random_turns(block)
    assert nodes_of(prefix_trie.trie(turns_of(spark, rows), block=block)) == plain_trie(rows)


def test_collisions_are_split(spark):
    rows = random_turns(9)[:160]
    assert nodes_of(prefix_trie.trie(turns_of(spark, rows), primes=(3, 2))) == plain_trie(rows)


def test_trie_of_nothing_and_of_nulls(spark):
    assert nodes_of(prefix_trie.trie(turns_of(spark, []))) == []
    assert nodes_of(prefix_trie.trie(turns_of(spark, [(None, None, None, None)]))) == []
    rows = [(3, None, None, None), (3, None, None, None), (8, 1, None, " \t ")]
    assert nodes_of(prefix_trie.trie(turns_of(spark, rows))) == plain_trie(rows)


def test_a_chain_of_branches_is_summed(spark):
    """Conversation k leaves the way of k - 1 at turn k: chains hang from one another, 12 deep."""
    rows = [(20 * c, k, "user", f"w{min(k, c)} x" if k < c else f"end{c}") for c in range(1, 13) for k in range(c + 1)]
    assert nodes_of(prefix_trie.trie(turns_of(spark, rows), block=4)) == plain_trie(rows)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_prefix_trie"])
def test_new_queries_against_sql(spark, duck, name):
    from support import SF, same_rows

    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name]))
