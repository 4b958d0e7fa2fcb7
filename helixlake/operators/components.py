"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable, forget


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of each u at the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(apart(least, "u"), "u")
    if larger_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame):
    """Count and hash sum: equal for equal edge sets."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()


def connected(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node and root (smallest node of its component) of every node that has an edge (u, v).

    Self-loops and repeated edges do no harm; an empty table gives an empty one. Every round is
    written and read again; minima are pre-aggregated, and nothing but a count and a hash sum
    reaches the driver. Raises if `limit` rounds don't suffice (they are logarithmic in practice).
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(limit):
        if not mark["n"]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).where("u <> v").distinct()
        last, now = now, durable(_stars(large, False).where("u <> v").distinct(), "edges")
        forget(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {limit} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
