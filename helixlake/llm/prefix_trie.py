"""Conversation prefix trie: every distinct sequence of first turns is a node.

Turns are numbered in their conversation, and a prefix gets a polynomial fingerprint, the sum of its turns' hashes times powers of a base,
modulo two primes. Sums of prefixes are numpy scans over blocks of `block` turns, to which the totals of earlier blocks are added, so a conversation of any length
is many tasks' work. Prefixes of one depth and fingerprint are candidates for one node. Each is compared, turn by turn, with its representative, the smallest
conversation: equal turns on equal verified parents. What differs is split off by parent and turn, again and again until nothing differs, so nodes are exact.

Since a node's smallest member is also that of the next node on its way, the trie falls into chains, each of one conversation: it begins at some depth and hangs from a node of
another chain. Subtree sums are sums along chains, plus those of chains that hang from them; these go up the tree of chains by doubling, in as many
rounds as the logarithm of its height.

Turns of a conversation with equal numbers are ordered by role and text. Rows that repeat are turns each. Null roles and texts are empty, turns that are null come first. Rows
with a null conv_id take no part. An empty table has no nodes, not even a root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.durable import durable, forget, join_checked
from helixlake.llm.arrow import map_batches
from helixlake.operators.scan import numbered

#: Turns of a block; the fingerprint's primes and bases.
BLOCK = 4_096
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525)
#: What isn't part of a word.
BLANK = r"[\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), role, text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], "i").select("conv_id", (F.col("i") + 1).alias("i"), "role", "text")


def shared_heads(turns: DataFrame, group: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, d, role, text), and conv_id, n, their number, of every conversation.

    A conversation's first turns come from the first of its group of `group` ids; how many is its id's checksum modulo `modulus`."""
    sizes = durable(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = sizes.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % modulus})
    met = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = durable(met.select("conv_id", "base", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("lent")), "convs")
    heads = turns.where(F.col("i") < modulus).select(F.col("conv_id").alias("base"), F.col("i").alias("d"), "role", "text")
    lent = convs.where("lent > 0").select("conv_id", "base", "lent").join(heads, "base").where("d <= lent").select("conv_id", "d", "role", "text")
    own = turns.where(F.col("i") > F.crc32(F.col("conv_id").cast("string")) % modulus).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % modulus)
    own = own.join(convs.where("lent < h").select("conv_id", "lent"), "conv_id", "left")
    kept = own.select("conv_id", (F.col("i") - F.col("h") + F.coalesce("lent", "h")).alias("d"), "role", "text")
    return lent.unionByName(kept), convs.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def _powers(base: int, of: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(of), dtype=np.uint64), np.uint64(base % prime), of.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return out


def fingerprints(turns: DataFrame, block: int = BLOCK, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> DataFrame:
    """turns (conv_id, d, role, text) with f1, f2: the fingerprints of the prefix that ends with the turn."""
    hashed = turns.withColumns({"block": F.floor((F.col("d") - 1) / block).cast("long"), "t1": F.xxhash64("role", "text"), "t2": F.xxhash64("text", F.lit(2), "role")})
    dealt = hashed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "d")

    def run(batches):
        last, carry = None, (0, 0)  # of the block that the batch before broke off in
        for b in batches:
            conv, blk, d = (b.column(n).to_numpy() for n in ("conv_id", "block", "d"))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (blk[1:] != blk[:-1])])
            runs = np.diff(np.r_[starts, len(conv)])
            on = last == (conv[0], blk[0])
            sums = []
            for k, (name, p, base) in enumerate(zip(("t1", "t2"), primes, bases, strict=True)):
                t = b.column(name).to_numpy().view(np.uint64) % np.uint64(p) * _powers(base, d, p) % np.uint64(p)
                if on:
                    t[0] = (t[0] + np.uint64(carry[k])) % np.uint64(p)
                total = np.cumsum(t, dtype=np.uint64)  # fewer than 2 ** 32 rows of less than 2 ** 31
                sums.append((total - np.repeat(total[starts] - t[starts], runs)) % np.uint64(p))
            last, carry = (conv[-1], blk[-1]), (int(sums[0][-1]), int(sums[1][-1]))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("conv_id", "block", "d", "role", "text")], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64))], ["conv_id", "block", "d", "role", "text", "f1", "f2"])

    within = durable(map_batches(dealt, run, "conv_id long, block long, d long, role string, text string, f1 long, f2 long"), "scanned")
    ends = within.where(F.col("d") % block == 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = durable(ends.select("conv_id", (F.col("block") + 1).alias("block"), F.sum("f1").over(earlier).alias("o1"), F.sum("f2").over(earlier).alias("o2")), "offsets")
    later = join_checked(within.where("block > 0"), before, ["conv_id", "block"], "inner")
    added = later.select("conv_id", "d", "role", "text", ((F.col("f1") + F.col("o1")) % primes[0]).alias("f1"), ((F.col("f2") + F.col("o2")) % primes[1]).alias("f2"))
    return within.where("block = 0").select("conv_id", "d", "role", "text", "f1", "f2").unionByName(added)


def verified(prefixes: DataFrame) -> DataFrame:
    """conv_id, d, text, node, rep, n: the verified node of each prefix, its smallest and its number of members.

    A prefix that differs from its node's representative in its turn or in its parent's node is moved to a node named by those."""
    named = durable(prefixes.select("conv_id", "d", "role", "text", (F.col("f1") * 2**31 + F.col("f2")).alias("node")), "prefixes")
    turn = named.select("conv_id", "d", "role", "text")
    now = durable(named.select("conv_id", "d", "node"), "nodes")
    while True:
        groups = durable(now.groupBy("d", "node").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "groups")
        parents = now.select("conv_id", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
        several = groups.where("n > 1").select("d", "node", "rep")
        full = durable(turn.join(now, ["conv_id", "d"]).join(several, ["d", "node"]).join(parents, ["conv_id", "d"], "left"), "several")
        # the representative is a member: its row is there once, and so is that of each node
        reps = full.where("conv_id = rep").select("d", "node", F.col("role").alias("r_role"), F.col("text").alias("r_text"), F.col("parent").alias("r_parent"))
        odd = full.join(reps, ["d", "node"]).where(~(F.col("role").eqNullSafe(F.col("r_role")) & F.col("text").eqNullSafe(F.col("r_text")) & F.col("parent").eqNullSafe(F.col("r_parent"))))
        odd = durable(odd.select("conv_id", "d", F.xxhash64("node", "parent", "role", "text").alias("moved")), "differing")
        if odd.isEmpty():
            break
        last, now = now, durable(now.join(odd, ["conv_id", "d"], "left").select("conv_id", "d", F.coalesce("moved", "node").alias("node")), "nodes")
        forget(last)
    return durable(turn.select("conv_id", "d", "text").join(now, ["conv_id", "d"]).join(groups, ["d", "node"]), "verified")


def ends_digest(ends: DataFrame) -> DataFrame:
    """rep, d, ends_sha256 from ends (rep, d, conv_id): the digest of the ids in order, joined by commas. Ids are streamed
    in order, never gathered, since a hash is made one id after another."""
    dealt = ends.select("rep", "d", "conv_id").repartition("rep", "d").sortWithinPartitions("rep", "d", "conv_id")

    def run(batches):
        at, digest = None, None
        for b in batches:
            rep, d, ids = (b.column(n).to_numpy() for n in ("rep", "d", "conv_id"))
            if not len(rep):
                continue
            cuts = np.r_[np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (d[1:] != d[:-1])]), len(rep)]
            done = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                joined = ",".join(map(str, ids[s:e].tolist())).encode()
                if at == (int(rep[s]), int(d[s])):
                    digest.update(b"," + joined)
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (int(rep[s]), int(d[s])), hashlib.sha256(joined)
            yield pa.RecordBatch.from_pylist([{"rep": r, "d": k, "ends_sha256": h} for r, k, h in done], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"rep": at[0], "d": at[1], "ends_sha256": digest.hexdigest()}], schema=schema)

    schema = pa.schema([("rep", pa.int64()), ("d", pa.int64()), ("ends_sha256", pa.string())])
    return map_batches(dealt, run, "rep long, d long, ends_sha256 string")


def chain_totals(chains: DataFrame, *values: str) -> DataFrame:
    """conv_id and values of chains (conv_id, up, values) summed over each chain and all that hang from it, at any depth.

    After k rounds a chain holds the sums of those fewer than 2 ** k steps below it, and knows the chain 2 ** k steps above."""
    now = durable(chains.select("conv_id", "up", *values), "chains")
    while not now.where("up IS NOT NULL").isEmpty():
        given = now.where("up IS NOT NULL").groupBy("up").agg(*[F.sum(v).alias(f"g_{v}") for v in values]).withColumnRenamed("up", "conv_id")
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        met = now.join(above, "up", "left").join(given, "conv_id", "left")
        last, now = now, durable(met.select("conv_id", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values]), "chains")
        forget(last)
    return now.select("conv_id", *values)


def suffix_sums(rows: DataFrame, block: int, *values: str) -> DataFrame:
    """rows (conv_id, d, values) with each value summed over the conversation's rows from d on, block by block."""
    blocked = rows.withColumn("block", F.floor(F.col("d") / block).cast("long"))
    onward = Window.partitionBy("conv_id", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "block").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select("conv_id", "block", *[F.sum(v).over(later).alias(f"l_{v}") for v in values]).where(f"l_{values[0]} IS NOT NULL")
    met = blocked.withColumns({v: F.sum(v).over(onward) for v in values}).join(totals, ["conv_id", "block"], "left")
    return met.withColumns({v: F.col(v) + F.coalesce(f"l_{v}", F.lit(0)) for v in values}).drop("block", *[f"l_{v}" for v in values])


def trie(conversations: DataFrame, group: int = 20, modulus: int = 4, block: int = BLOCK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = ordered_turns(conversations)
    rebuilt, sizes = shared_heads(turns, group, modulus)
    sizes = durable(sizes, "lengths")
    rows = verified(fingerprints(rebuilt, block, primes))
    all_of = sizes.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    words = F.size(F.array_remove(F.split("text", BLANK), "")).cast("long")
    root = all_of.select("conv_id", F.lit(0).cast("long").alias("d"), "n_convs", F.lit(0).cast("long").alias("saved"))
    own = durable(rows.where("rep = conv_id").select("conv_id", "d", F.col("n").alias("n_convs"), ((F.col("n") - 1) * words).alias("saved")).unionByName(root), "own")
    tops = own.groupBy("conv_id").agg(F.min("d").alias("top"), F.max("d").alias("bottom"))
    # where a chain hangs: the node of the turn before its first
    first = tops.where("top > 1").select("conv_id", (F.col("top") - 1).alias("d"))
    hung = first.join(rows.select("conv_id", "d", F.col("rep").alias("up")), ["conv_id", "d"])
    at_root = tops.where("top = 1").select("conv_id", F.lit(0).cast("long").alias("d")).crossJoin(F.broadcast(all_of.select(F.col("conv_id").alias("up"))))
    hung = durable(hung.select("conv_id", "d", "up").unionByName(at_root.select("conv_id", "d", "up")), "hung")
    branches = durable(hung.groupBy(F.col("up").alias("conv_id"), "d").agg(F.count("*").alias("c")), "branches")
    bottoms = tops.select("conv_id", "bottom")
    nodes = own.join(branches, ["conv_id", "d"], "left").join(bottoms, "conv_id")
    children = (F.col("d") < F.col("bottom")).cast("long") + F.coalesce("c", F.lit(0))
    nodes = durable(nodes.select("conv_id", "d", "n_convs", "saved", children.alias("n_children"), (children == 0).cast("long").alias("leaves")), "trie_nodes")
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).join(hung.select("conv_id", "up"), "conv_id", "left")
    totals = chain_totals(chains, "saved", "leaves")
    below = hung.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), "d").agg(F.sum("saved").alias("b_saved"), F.sum("leaves").alias("b_leaves"))
    with_below = nodes.join(below, ["conv_id", "d"], "left").select("conv_id", "d", "n_convs", "n_children", *[(F.col(v) + F.coalesce(f"b_{v}", F.lit(0))).alias(v) for v in ("saved", "leaves")])
    summed = suffix_sums(with_below, block, "saved", "leaves")
    ends = sizes.where("n > 0").select("conv_id", F.col("n").alias("d")).join(rows.select("conv_id", "d", "rep"), ["conv_id", "d"])
    turnless = sizes.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("d")).crossJoin(F.broadcast(all_of.select(F.col("conv_id").alias("rep"))))
    digests = ends_digest(ends.select("rep", "d", "conv_id").unionByName(turnless.select("rep", "d", "conv_id"))).withColumnRenamed("rep", "conv_id")
    out = summed.join(digests, ["conv_id", "d"], "left").join(hung.select("conv_id", (F.col("d") + 1).alias("d"), "up"), ["conv_id", "d"], "left")
    parent = F.when(F.col("d") > 0, F.coalesce("up", "conv_id"))
    return out.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
