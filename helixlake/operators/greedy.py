"""Greedy choices in a fixed order, made in parallel rounds.

A sequential rule looks at one element after another and lets it depend on those chosen before. Its outcome is that of rounds in which every
element decides that no undecided earlier one can influence: each round settles the first of all undecided ones at least, and in practice most of them. State
is a table, rounds are joins and minima, and no group of elements that depend on one another is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable, forget


def greedy_centres(asks: DataFrame, holds: DataFrame) -> DataFrame:
    """node, centre: in the order of node, each becomes a centre unless it asks for a key that an earlier centre holds; it
    goes to the first such centre then.

    asks and holds have node and key; every node must ask for a key, and centres are their own. Keys stand for links, so that many nodes with one
    key are as many rows and not their pairs."""
    asks, holds = durable(asks.select("node", "key").distinct(), "asks"), durable(holds.select("node", "key").distinct(), "holds")
    left, kept, chosen = asks, holds, None
    while not left.isEmpty():
        first = apart(kept.groupBy("key").agg(F.min("node").alias("first")), "key")
        waiting = left.join(first, "key").where("first < node").select("node").distinct()
        centres = durable(left.select("node").distinct().join(waiting, "node", "left_anti"), "centres")
        chosen = centres if chosen is None else chosen.unionByName(centres)
        taken = apart(kept.join(centres, "node").groupBy("key").agg(F.min("node").alias("first")), "key")
        settled = durable(left.join(taken, "key").where("first < node").select("node").unionByName(centres).distinct(), "settled")
        old = [x for x in (left, kept) if x is not asks and x is not holds]
        left, kept = durable(left.join(settled, "node", "left_anti"), "asks-left"), durable(kept.join(settled, "node", "left_anti"), "holds-left")
        for table in (*old, settled):
            forget(table)
    if chosen is None:
        return asks.select("node", F.col("node").alias("centre"))
    chosen = durable(chosen, "chosen")
    at = apart(holds.join(chosen, "node").groupBy("key").agg(F.min("node").alias("first")), "key")
    joined = asks.join(chosen, "node", "left_anti").join(at, "key").groupBy("node").agg(F.min("first").alias("centre"))
    return joined.unionByName(chosen.select("node", F.col("node").alias("centre")))


def greedy_stars(edges: DataFrame) -> DataFrame:
    """centre, read by the sequential rule over edges in order of band, centre and read: an edge goes to those of its
    ends that are stars already, which take its other end in; if neither is, its centre becomes one.

    An edge makes a star if neither of its ends is one by an earlier edge. It is settled once it is the first undecided edge of its centre and no
    undecided edge before it has its other end as centre."""
    at = F.struct("band", "centre", "read")
    every = durable(edges.select("band", "centre", "read").withColumn("at", at), "star-edges")
    left, stars = every, None
    while not left.isEmpty():
        first = durable(left.groupBy("centre").agg(F.min("at").alias("first")), "firsts")
        own = left.join(first, "centre").where("at = first").drop("first").distinct()
        other = first.select(F.col("centre").alias("read"), F.col("first").alias("other"))
        made = durable(own.join(other, "read", "left").where("other IS NULL OR other >= at").select("centre", "at").distinct(), "stars")
        stars = made if stars is None else stars.unionByName(made)
        since = made.select(F.col("centre").alias("node"), F.col("at").alias("since"))
        alive = left.join(apart(since.withColumnsRenamed({"node": "centre", "since": "s1"}), "centre"), "centre", "left").join(apart(since.withColumnsRenamed({"node": "read", "since": "s2"}), "read"), "read", "left")
        last, left = left, durable(alive.where("s1 IS NULL AND (s2 IS NULL OR s2 > at)").select("band", "centre", "read", "at"), "star-edges")
        if last is not every:
            forget(last)
    kind = edges.schema["centre"].dataType
    if stars is None:
        return every.select("centre", F.col("read").cast(kind).alias("read"))
    since = durable(stars, "star-times")
    takes = lambda star, other: every.join(apart(since.select(F.col("centre").alias(star), F.col("at").alias("since")), star), star).where("since <= at").select(F.col(star).alias("centre"), F.col(other).alias("read"))
    return takes("centre", "read").unionByName(takes("read", "centre"))
