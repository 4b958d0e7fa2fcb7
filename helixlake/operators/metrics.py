"""Quality of clusterings and of recovered sequences.

Agreement of two labellings is computed from their contingency table, whose size is that of the
label sets and not of the data. Pair counts use the same table, so nothing is compared pairwise
unless the measure is a distance between members.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.durable import durable
from helixlake.functions import seqfn
from helixlake.operators.nearest import nearest as nearest_originals
from helixlake.operators import assignment
from helixlake.operators.assignment import best_assignment  # noqa: F401
from helixlake.operators.cluster import purity
from helixlake.sources.readers import pair_file


def pair_scores(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of scores of a pair file's lines (file_id, pos, line; pairs of core and read): reads, minority, clusters,
    tags and purity. tags has read and tag, the true cluster. Nothing in the lines is evaluated."""
    pairs = pair_file(lines).select(F.col("a").alias("core"), F.col("b").alias("read"))
    found = purity(pairs.join(tags, "read").select("core", "tag"))
    return found.withColumn("purity", F.round(1 - F.col("minority") / F.col("reads"), 9))


def filled_labels(spark_range: DataFrame, labels: DataFrame) -> DataFrame:
    """i, label for every i of spark_range; unlabelled ones get -1, -2, ... in order, labels outside are ignored.

    The ranks of missing ids come from counts by block of ids, so no window spans all rows."""
    rows = spark_range.join(labels, "i", "left").withColumn("block", F.floor(F.col("i") / 100_000))
    missing = rows.where("label IS NULL")
    counts = missing.groupBy("block").agg(F.count("*").alias("c"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("block").orderBy("i")
    named = missing.withColumn("r", F.row_number().over(own)).join(F.broadcast(starts), "block").select("i", (-(F.col("r") + F.col("before"))).cast("long").alias("label"))
    return rows.where("label IS NOT NULL").select("i", F.col("label").cast("long").alias("label")).unionByName(named)


def contingency(pairs: DataFrame, *by: str) -> DataFrame:
    """by, t, p, n: how often each pair of labels occurs. Null labels count as a label of their own."""
    return pairs.groupBy(*by, "t", "p").agg(F.count("*").alias("n"))


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """ln(n!) less Stirling's formula for it, for n >= 0 (and 0 for n = 0, whose factorial the formula isn't used for)."""
    small = np.array([math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) if k else 0.0 for k in range(16)])
    x = np.maximum(n, 1.0)
    m = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / x
    return np.where(n < 16, small[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x for x > 0, without cancellation where x is near the mean."""
    v = (x - mean) / (x + mean)
    power, series = 2 * x * v, (x - mean) * v
    for j in range(1, 11):
        power = power * v * v
        series = series + power / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, series, x * np.log(x / mean) + mean - x)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln of the probability of x successes of n by the saddle-point expansion (Loader 2000): exact to rounding at any size."""
    with np.errstate(all="ignore"):
        inner = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * np.log(n / (2 * math.pi * x * (n - x)))
        none, every = -_deviance(n, n * q) - n * p, -_deviance(n, n * p) - n * q
    return np.select([n == 0, x == 0, x == n], [0.0, none, every], inner)


def hypergeometric(k: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The probability that b draws of n have k of the a marked ones; all four are doubles of whole numbers."""
    with np.errstate(all="ignore"):
        p, q = b / n, (n - b) / n
        spread = np.exp(_log_binomial(k, a, p, q) + _log_binomial(b - k, n - a, p, q) - _log_binomial(b, n, p, q))
    return np.where((a == n) | (b == n), (k == np.minimum(a, b)).astype(float), spread)


#: A sum over counts leaves out what lies this many standard deviations, and so many places, from the mean; counts of a range.
SIGMAS, PLACES, RANGE = 12, 60, 65_536


def likely_counts(cells: DataFrame) -> DataFrame:
    """cells (a, b, total, doubles of whole numbers) with lo and hi, ranges of the counts from 1 that a and b can share by chance.

    By Bernstein's inequality, which holds for draws without replacement too, what is left out has less than 1e-30 of the probability.
    Ranges are dealt to tasks, so a pair of large sizes is no one task's work, and no count is a row."""
    a, b, n = (F.col(c) for c in ("a", "b", "total"))
    mean = a * b / n
    reach = SIGMAS * F.sqrt(mean * (n - a) / n * (n - b) / F.greatest(n - 1, F.lit(1.0))) + PLACES
    least = F.greatest(F.lit(1.0), a + b - n, F.floor(mean - reach).cast("double")).cast("long")
    most = F.least(a, b, F.ceil(mean + reach).cast("double")).cast("long")
    ranged = cells.withColumns({"__lo": least, "__hi": most}).where("__lo <= __hi")
    starts = ranged.withColumn("lo", F.explode(F.expr(f"sequence(__lo, __hi, {RANGE})")))
    return starts.withColumn("hi", F.least("__hi", F.col("lo") + RANGE - 1)).drop("__lo", "__hi").repartition(F.xxhash64("a", "b", "lo"))


def shared_by_chance(ranges: DataFrame, by: list[str], term: Callable) -> DataFrame:
    """by, value: of each range (a, b, total, lo, hi) the sum of term(k, a, b, total) times k's probability."""
    kinds = ", ".join(f"`{c}` {ranges.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for batch in batches:
            a, b, n, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a", "b", "total", "lo", "hi"))
            sizes, out = (hi - lo + 1).astype(np.int64), np.zeros(len(lo))
            slab = np.cumsum(sizes) // (8 * RANGE)  # ranges whose counts are worked on together
            for s in np.unique(slab):
                at = np.flatnonzero(slab == s)
                row = np.repeat(at, sizes[at])
                k = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
                out += np.bincount(row, term(k, a[row], b[row], n[row]) * hypergeometric(k, a[row], b[row], n[row]), minlength=len(lo))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(out)], names=[*by, "value"])

    return ranges.select(*by, "a", "b", "total", "lo", "hi").mapInArrow(run, f"{kinds}, value double")


def _marginals(table: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums by label, as doubles: products of two don't overflow, and whole numbers below 2 ** 53 are exact."""
    return table.groupBy(*by, "t").agg(F.sum("n").cast("double").alias("a")), table.groupBy(*by, "p").agg(F.sum("n").cast("double").alias("b"))


def agreement(table: DataFrame, *by: str, expected: bool = True) -> DataFrame:
    """One row per group with n, mi, h_t, h_p, nmi, ami, ari, fmi, homogeneity, completeness, v_measure, purity.

    ami needs the expected mutual information: a sum over pairs of distinct marginal sizes, weighted by
    how many labels have them, and over the counts that they can share, cut where the rest is below rounding. Where both sides have one cluster, or there is nothing to disagree on, the
    scores are 1. expected=False leaves ami out."""
    by = list(by) or ["__all"]
    if by == ["__all"]:
        table = table.withColumn("__all", F.lit(0))
    rows, cols = _marginals(table, by)
    total = table.groupBy(*by).agg(F.sum("n").cast("double").alias("total"))
    table = table.withColumn("n", F.col("n").cast("double"))
    full = table.join(rows, [*by, "t"]).join(cols, [*by, "p"]).join(total, by)
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    joint = full.groupBy(*by).agg(F.max("total").alias("total"), F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("a") * (F.col("total") / F.col("b")))).alias("mi"), F.sum(choose("n")).alias("s"))
    side = lambda m, c, h, q: m.join(total, by).groupBy(*by).agg((-F.sum(F.col(c) / F.col("total") * F.ln(F.col(c) / F.col("total")))).alias(h), F.sum(choose(c)).alias(q), F.count("*").alias(f"k_{h}"))
    tops = table.groupBy(*by, "p").agg(F.max("n").alias("top")).groupBy(*by).agg(F.sum("top").alias("tops"))
    out = joint.join(side(rows, "a", "h_t", "qa"), by).join(side(cols, "b", "h_p", "qb"), by).join(tops, by)
    if expected:
        sizes_a = rows.groupBy(*by, "a").agg(F.count("*").alias("wa"))
        sizes_b = cols.groupBy(*by, "b").agg(F.count("*").alias("wb"))
        cells = likely_counts(sizes_a.join(sizes_b, by).join(total, by))
        sums = shared_by_chance(cells, [*by, "wa", "wb"], lambda k, a, b, n: k / n * np.log(k / a * (n / b)))
        emi = sums.groupBy(*by).agg(F.sum(F.col("wa") * F.col("wb") * F.col("value")).alias("emi"))
        out = out.join(emi, by)
    mean = (F.col("h_t") + F.col("h_p")) / 2
    ratio = lambda x, y, other=1.0: F.when(F.abs(y) > 1e-15, x / y).otherwise(other)
    pairs = F.col("total") * (F.col("total") - 1) / 2.0
    chance = ratio(F.col("qa") * F.col("qb"), pairs, 0.0)
    hom, com = ratio(F.col("mi"), F.col("h_t")), ratio(F.col("mi"), F.col("h_p"))
    trivial = (F.col("k_h_t") == 1) & (F.col("k_h_p") == 1)
    keep = [F.col(c) for c in by if c != "__all"]
    return out.select(
        *keep, F.col("total").cast("long").alias("n"), "mi", "h_t", "h_p",
        F.when(trivial, 1.0).otherwise(ratio(F.col("mi"), mean)).alias("nmi"),
        *([F.when(trivial, 1.0).otherwise(ratio(F.col("mi") - F.col("emi"), mean - F.col("emi"))).alias("ami")] if expected else []),
        ratio(F.col("s") - chance, (F.col("qa") + F.col("qb")) / 2 - chance).alias("ari"),
        ratio(F.col("s"), F.sqrt(F.col("qa") * F.col("qb")), 0.0).alias("fmi"),
        hom.alias("homogeneity"), com.alias("completeness"), ratio(2 * hom * com, hom + com, 0.0).alias("v_measure"),
        (F.col("tops") / F.col("total")).alias("purity"),
    )


def assignment_accuracy(table: DataFrame, limit: int = assignment.LABELS) -> float:
    """Share of rows on the best one-to-one assignment of predicted to true labels, 1 for an empty table.

    One number reaches the driver. See assignment.best_matching for what `limit` bounds."""
    total = table.agg(F.sum("n")).first()[0]
    return float(assignment.best_matching(table, limit).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / total) if total else 1.0


def intra_distance(members: DataFrame) -> DataFrame:
    """cluster, distance: mean edit distance of a cluster's pairs of members, 0 for single ones.

    members has cluster, member and seq. Repeated sequences are one row with a weight, so a cluster of
    many equal reads costs as much as a cluster of its distinct ones."""
    kinds = members.groupBy("cluster", "seq").agg(F.count("*").alias("w"))
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.seq") < F.col("b.seq")))
    sums = pairs.groupBy(F.col("a.cluster").alias("cluster")).agg(F.sum(F.levenshtein("a.seq", "b.seq") * F.col("a.w") * F.col("b.w")).alias("d"))
    sizes = kinds.groupBy("cluster").agg(F.sum("w").alias("n"))
    n = F.col("n")
    return sizes.join(sums, "cluster", "left").select("cluster", F.when(n > 1, F.coalesce("d", F.lit(0)) / (n * (n - 1) / 2.0)).otherwise(0.0).alias("distance"))


def inter_distance(centres: DataFrame) -> DataFrame:
    """sum, as_published (sum over k, then minus 1) and mean (over pairs) of the edit distances of centres.

    centres has cluster and seq; each pair is compared, so this is for centres rather than reads."""
    a, b = centres.alias("a"), centres.alias("b")
    pairs = a.join(b, F.col("a.cluster") < F.col("b.cluster"))
    total = pairs.agg(F.coalesce(F.sum(F.levenshtein("a.seq", "b.seq")), F.lit(0)).cast("long").alias("total"))
    k = centres.agg(F.count("*").alias("k"))
    pairs_of = F.nullif(F.col("k") * (F.col("k") - 1) / 2.0, F.lit(0.0))
    return total.join(F.broadcast(k)).select("total", (F.col("total") / F.col("k") - 1).alias("as_published"), (F.col("total") / pairs_of).alias("mean"))


def categorical_cohesion(rows: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """The category score: over ordered pairs r <> s, (n - 2d) if the labels agree, plus d, where d is the
    number of n attributes that differ. Pairs aren't formed: counts by value and by (label, value) give it."""
    spread = rows.select(F.col(label).alias("c"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(a).cast("string").alias("v")) for k, a in enumerate(attributes)])).alias("x"))
    cells = spread.groupBy("c", "x.k", "x.v").agg(F.count("*").alias("n"))
    sq = lambda df: df.agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("q"))
    within = sq(cells).withColumnRenamed("q", "within")
    across = sq(cells.groupBy("k", "v").agg(F.sum("n").alias("n"))).withColumnRenamed("q", "across")
    labels = rows.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n"))
    total = labels.agg(F.sum("n").cast("double").alias("N"), F.sum(F.col("n") * F.col("n")).cast("double").alias("same"))
    m = len(attributes)
    one = total.join(F.broadcast(within)).join(F.broadcast(across))
    d_all = m * F.col("N") * F.col("N") - F.col("across")
    d_same = m * F.col("same") - F.col("within")
    return one.select((m * (F.col("same") - F.col("N")) - 2 * d_same + d_all).alias("ncc"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """Variance ratio of labelled vectors (id, label, vector) from sums by label and dimension."""
    spread = vectors.select("label", F.posexplode("vector").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    cells = spread.groupBy("label", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dims = cells.groupBy("k").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    joined = cells.join(dims, "k")
    parts = joined.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n"), F.lit(2))).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.count_distinct("label").alias("k"), F.max("all_n").alias("n"),
    )
    return parts.select((F.col("between") * (F.col("n") - F.col("k")) / F.nullif(F.col("within") * (F.col("k") - 1), F.lit(0.0))).alias("calinski_harabasz"))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of a and b by inner products; those so small that digits would be lost, and what isn't finite, by differences."""
    both = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    out = both - 2 * (a @ b.T)
    i, j = np.nonzero(~(out > 1e-4 * both) | ~np.isfinite(both))
    out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return out


def silhouette(vectors: DataFrame, block: int = 4_096) -> DataFrame:
    """Mean silhouette (Euclidean) of vectors (id, label, vector).

    Vectors are dealt into blocks; every pair of blocks is one group, whose distances are summed by
    label in numpy. No pair of vectors is ever a row; a group holds two blocks whatever the data's size. The measure
    needs all n * n distances; each vector is copied 2 * n / block times."""
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.select("id", "label", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    sides = dealt.select("id", "label", "vector", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    left = sides.select(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("mine"), "id", "label", "vector")
    right = sides.select(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("mine"), "id", "label", "vector")

    def sums(rows: pa.Table) -> pa.Table:
        mine = rows.column("mine").to_numpy(zero_copy_only=False)
        x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), -1)
        label, key = rows.column("label").to_numpy(), rows.column("id").to_numpy()
        a, b, lb = x[mine], x[~mine], label[~mine]
        kinds = np.unique(lb)
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        of = (lb[:, None] == kinds[None, :]).astype(np.float64)
        out = np.concatenate([np.sqrt(squared_distances(a[k : k + 64], b)) @ of for k in range(0, len(a), 64)])
        return pa.table({
            "id": np.repeat(key[mine], len(kinds)), "label": np.repeat(label[mine], len(kinds)).astype(np.int64), "other": np.tile(kinds, len(a)).astype(np.int64),
            "d": out.ravel(), "n": np.tile([(lb == k).sum() for k in kinds], len(a)),
        })

    parts = left.unionByName(right).groupBy("i", "j").applyInArrow(sums, "id long, label long, other long, d double, n long")
    per = parts.groupBy("id", "label", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("other") == F.col("label"), F.struct("d", "n"))).alias("own")
    away = F.min(F.when(F.col("other") != F.col("label"), F.col("d") / F.col("n"))).alias("b")
    each = per.groupBy("id").agg(own, away)
    a = F.col("own.d") / (F.col("own.n") - 1)
    value = F.when((F.col("own.n") > 1) & F.col("b").isNotNull(), F.coalesce((F.col("b") - a) / F.nullif(F.greatest(F.col("b"), a), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return each.agg(F.avg(value).alias("silhouette"))


def recovery(originals: DataFrame, found: DataFrame) -> DataFrame:
    """fraction of distinct originals that occur among the candidates, and redundancy (hits per original over
    the fraction; 0 if none). Candidates are counted before the join. Sequences travel packed, four bases to a byte."""
    want = originals.select(seqfn.packed("seq").alias("seq")).distinct()
    have = found.select(seqfn.packed("seq").alias("seq")).groupBy("seq").agg(F.count("*").alias("c"))
    both = want.join(have, "seq", "left").agg(F.count("*").alias("n"), F.count("c").alias("hit"), F.coalesce(F.sum("c"), F.lit(0)).alias("hits"))
    fraction = F.col("hit") / F.nullif(F.col("n"), F.lit(0))
    return both.select(fraction.alias("fraction"), F.coalesce(F.col("hits") / F.col("n") / F.nullif(fraction, F.lit(0.0)), F.lit(0.0)).alias("redundancy"))


def _within(rest: DataFrame, originals: DataFrame, most: int) -> DataFrame:
    """seq, c, t, pos, d: originals within `most` edits of each candidate (seq, c).

    A candidate is cut into most + 1 pieces. Edits that few leave one piece whole, and move it by `most` places at
    most: candidates meet originals on a piece, and on the stretches where it can lie."""
    piece = lambda n, j: F.floor(n * j / (most + 1)).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(most))
    lengths = rest.select(F.length("seq").alias("n")).distinct()
    spots = F.flatten(F.transform(numbers, lambda j: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda o: F.struct(j.alias("j"), F.when(piece(F.col("n"), j) + o >= 0, F.substr("t", piece(F.col("n"), j) + o + 1, piece(F.col("n"), j + 1) - piece(F.col("n"), j))).alias("x")))))
    there = originals.select(F.col("seq").alias("t"), "pos").join(F.broadcast(lengths), F.abs(F.length("t") - F.col("n")) <= most).select("t", "pos", "n", F.explode(F.array_distinct(spots)).alias("p")).where("p.x IS NOT NULL")
    mine = rest.select("seq", "c", F.length("seq").alias("n")).select("seq", "c", "n", F.explode(F.transform(numbers, lambda j: F.struct(j.alias("j"), F.substr("seq", piece(F.col("n"), j) + 1, piece(F.col("n"), j + 1) - piece(F.col("n"), j)).alias("x")))).alias("p"))
    met = mine.join(there, ["n", "p"]).select("seq", "c", "t", "pos").distinct()
    return met.withColumn("d", F.levenshtein("seq", "t", most)).where("d >= 0")


def reconstruction_rate(originals: DataFrame, found: DataFrame, rounds: tuple[int, ...] = (2, 5)) -> DataFrame:
    """seq, nearest, rate of each distinct candidate with its count: 1 if it is an original, else 1 - its least
    edit distance over the length of the nearest original (the first by pos among equals; null if that is empty).

    Exact hits go by equi-join. Candidates near an original are found by seeds, for one number of edits after another
    (`rounds`): whoever has an original within that distance has its nearest one. What is farther away than the last of
    them goes by bounds on the counts of short windows (`nearest.nearest`). Null candidates and originals take no part."""
    have = durable(found.where("seq IS NOT NULL").groupBy("seq").agg(F.count("*").alias("c")), "candidates")
    want = durable(originals.groupBy("seq").agg(F.min("pos").alias("pos")), "originals")
    out = have.join(want, "seq", "left_semi").select("seq", F.col("seq").alias("nearest"), F.lit(1.0).alias("rate"), "c")
    rest = durable(have.join(want, "seq", "left_anti"), "inexact")
    rated = lambda m: m.select("seq", F.col("m.t").alias("nearest"), (1 - F.col("m.d") / F.nullif(F.length("m.t"), F.lit(0))).alias("rate"), "c")
    nearest = F.min_by(F.struct("t", "d"), F.struct("d", "pos")).alias("m")
    for most in rounds:
        near = durable(_within(rest, want, most).groupBy("seq", "c").agg(nearest), "near")
        out = out.unionByName(rated(near))
        rest = durable(rest.join(near.select("seq"), "seq", "left_anti"), "far")
    if rest.isEmpty():
        return out
    far = nearest_originals(rest, want)
    return out.unionByName(rated(far.select("seq", "c", F.struct("t", "d").alias("m"))))


def mean_rate(rates: DataFrame) -> DataFrame:
    return rates.agg((F.sum(F.col("rate") * F.col("c")) / F.sum("c")).alias("rate"))


def rounded_report(scores: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    """Scores by pred_file as columnar JSON, half-even to `digits`; a small negative score is 0.0 and not -0.0. One row per file is gathered."""
    rows = scores.agg(F.array_sort(F.collect_list(F.struct("pred_file", *[(F.bround(n, digits) + 0.0).alias(n) for n in names]))).alias("r"))
    columns = [F.expr(f"transform(r, x -> x.{n})").alias(n) for n in ("pred_file", *names)]
    return rows.select(F.to_json(F.struct(*columns)).alias("report"))
