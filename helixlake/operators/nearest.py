"""The nearest originals, under edit distance, of strings that are too far from all of them for seeds.

Both sides are dealt into blocks, and a group is one block of either. Within a group the counts of short windows bound every
distance from below, in numpy; only pairs whose bound is within what is known already are measured. No pair is a row before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable

#: Letters of a window; the four letters A, C, G and T have bits of their own, others share them.
WINDOW = 4
#: Strings and letters of a block, at most (one string at least).
STRINGS, LETTERS = 512, 1 << 17


def profiles(strings: list[str]) -> np.ndarray:
    """Counts of each string's windows by their code (strings, 4 ** WINDOW)."""
    out = np.zeros((len(strings), 4**WINDOW), dtype=np.int32)
    for k, s in enumerate(strings):
        code = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) >> 1 & 3).astype(np.int64)
        n = len(code) - WINDOW + 1
        if n > 0:
            out[k] = np.bincount(sum(code[j : j + n] << 2 * j for j in range(WINDOW)), minlength=4**WINDOW)
    return out


def least_distances(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bound of the edit distances of a string to others, by profiles and lengths: an edit changes WINDOW windows on
    either side at most, and the length by one."""
    return np.maximum(-(-np.abs(others - one).sum(axis=1) // (2 * WINDOW)), np.abs(sizes - size))


def _blocked(rows: DataFrame, blocks: int, mine: str, other: str, others: int) -> DataFrame:
    """rows dealt into blocks, each once for every block of the other side."""
    dealt = rows.withColumn(mine, F.pmod(F.xxhash64("seq", F.lit(3)), F.lit(blocks)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def nearest(far: DataFrame, originals: DataFrame) -> DataFrame:
    """seq, c, t, pos, d: of each distinct string of far (seq, c) the nearest original (seq, pos), the first by pos among equals.

    First each string is measured against the one original of each group with the least bound; the least of these distances
    is its radius. Then all originals whose bound is within the radius are measured, no farther than that. A string near
    some original is so compared with few; one that is as far from all as chance has it is measured against all, in
    blocks. Nulls of either side take no part, and no original gives no row.
    """
    far = durable(far.where("seq IS NOT NULL").select("seq", "c"), "far")
    originals = durable(originals.where("seq IS NOT NULL").select("seq", "pos"), "originals")
    size = lambda r: (r["n"], min(STRINGS, max(1, LETTERS // max(1, r["longest"] or 1))))
    (n, a), (m, b) = (size(x.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("longest")).first()) for x in (far, originals))
    i, j = max(1, -(-n // a)), max(1, -(-m // b))
    right = _blocked(originals, j, "j", "i", i).select("i", "j", F.col("seq").alias("t"), "pos")

    def pairs(rows: DataFrame, closest: bool) -> DataFrame:
        """seq, c, most, t, pos of the pairs to measure: with each group's least bound, or all with a bound up to `most`."""

        def one(mine: pa.Table, other: pa.Table) -> pa.Table:
            strings, there = mine.column("seq").to_pylist(), other.column("t").to_pylist()
            ours, theirs = profiles(strings), profiles(there)
            sizes, most = np.array([len(t) for t in there], dtype=np.int64), mine.column("most").to_pylist()
            left, right = [], []
            for k, s in enumerate(strings if there else []):
                bound = least_distances(ours[k], len(s), theirs, sizes)
                at = np.array([bound.argmin()]) if closest else np.flatnonzero(bound <= most[k])
                left.append(np.full(len(at), k))
                right.append(at)
            left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
            return pa.table({**{k: mine.column(k).take(pa.array(left)) for k in ("seq", "c", "most")}, **{k: other.column(k).take(pa.array(right)) for k in ("t", "pos")}})

        sides = _blocked(rows, i, "i", "j", j).groupBy("i", "j").cogroup(right.groupBy("i", "j"))
        return sides.applyInArrow(one, f"seq string, c long, most int, t string, pos {originals.schema['pos'].dataType.simpleString()}")

    first = pairs(far.withColumn("most", F.lit(0)), True).withColumn("most", F.levenshtein("seq", "t"))
    radius = durable(first.groupBy("seq", "c").agg(F.min("most").alias("most")), "radius")
    met = pairs(radius, False).withColumn("d", F.expr("levenshtein(seq, t, most)")).where("d >= 0")
    best = met.groupBy("seq", "c").agg(F.min_by(F.struct("t", "pos", "d"), F.struct("d", "pos")).alias("m"))
    return best.select("seq", "c", "m.t", "m.pos", "m.d")
