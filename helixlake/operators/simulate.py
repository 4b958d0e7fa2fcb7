"""Synthesis and sequencing errors, reproducible: every draw is a hash of seed, strand, copy and step.

A read is a fold over its strand's original bases. What stands left of the current base is final, so
the strand's length at that moment is the output's length plus the bases that remain.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import rng
from helixlake.operators.scan import changes

#: Lengths of long deletions and their relative weights: fixed values.
LONG = ((2, 2.8e-4), (3, 7.75e-5), (4, 3.25e-5), (5, 1e-6), (6, 5.5e-8))
OTHERS = {"A": "TGC", "T": "AGC", "G": "ATC", "C": "ATG"}
BASES = "ATGC"


def parse_rate(value: object) -> object:
    """Numbers, or strings like 2E-3, in nested mappings too."""
    if isinstance(value, Mapping):
        return {k: parse_rate(v) for k, v in value.items()}
    return float(value)  # type: ignore[arg-type]


def rate_column(text: Column) -> Column:
    """The same for a column; null if malformed."""
    return text.try_cast("double")


def copies_vector(strands: DataFrame, counts: DataFrame, seed: int, low: int, high: int) -> DataFrame:
    """strands with copies: the given count by pos, else a draw from low..high."""
    drawn = F.lit(low) + F.pmod(rng.draw(rng.digest(seed, F.lit("n"), "file_id", "pos")), F.lit(high - low + 1))
    return strands.join(counts, ["file_id", "pos"], "left").withColumn("copies", F.coalesce("copies", drawn).cast("long"))


def normal_pair(digested: Column) -> tuple[Column, Column]:
    """Two standard normals from one digest (Box-Muller)."""
    radius = F.sqrt(-2 * F.ln((rng.draw(digested, 0) + 1) / float(rng.SPAN + 1)))
    angle = 2 * math.pi * rng.uniform(digested, 1)
    return radius * F.cos(angle), radius * F.sin(angle)


def copies_skewed(strands: DataFrame, low: int, high: int, seed: int, shape: float = 10.0) -> DataFrame:
    """strands with copies in low..low+high-1: skew-normal draws, stretched from their range to that one.
    One strand, or equal draws, get `low`."""
    if low < 0 or high < 1:
        raise ValueError("copies need low >= 0 and high >= 1")
    a, b = normal_pair(rng.digest(seed, F.lit("s"), "file_id", "pos"))
    delta = shape / math.sqrt(1 + shape * shape)
    drawn = strands.withColumn("z", delta * F.abs(a) + math.sqrt(1 - delta * delta) * b)
    ends = drawn.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    span = F.nullif(F.col("z1") - F.col("z0"), F.lit(0.0))
    scaled = F.coalesce((F.col("z") - F.col("z0")) / span, F.lit(0.0))
    return drawn.join(F.broadcast(ends)).withColumn("copies", F.bround(scaled * (high - 1) + low).cast("long")).drop("z", "z0", "z1")


_SAFE = re.compile(r"^[\sx0-9.eE+\-*/(),]*(?:(?:exp|sqrt|pow|abs|ln|sin|cos|greatest|least|pi)\b[\sx0-9.eE+\-*/(),]*)*$")


def copies_from_density(strands: DataFrame, density: str, low: float, high: float, seed: int, steps: int = 2_000) -> DataFrame:
    """strands with copies drawn from a density of x on [low, high] by inverting its cumulative sum on a grid.

    Only arithmetic and a few functions are allowed in the expression, which Spark parses; nothing is evaluated
    as code. The grid has `steps` cells of equal width; a draw finds its cell by halving."""
    if not _SAFE.match(density):
        raise ValueError("a density is made of x, numbers, + - * / ( ) and exp, sqrt, pow, abs, ln, sin, cos, greatest, least, pi")
    spark = strands.sparkSession
    grid = spark.range(steps).select(F.col("id"), (F.lit(low) + (F.col("id") + 0.5) * (high - low) / steps).alias("x"))
    values = [(r["x"], max(0.0, r["p"] or 0.0)) for r in grid.select("id", "x", F.expr(density).cast("double").alias("p")).orderBy("id").collect()]
    total = sum(p for _, p in values)
    if not total > 0:
        raise ValueError("the density is nowhere positive")
    sums, at = [], 0.0
    for _, p in values:
        at += p / total
        sums.append(at)
    u = rng.uniform(rng.digest(seed, F.lit("c"), "file_id", "pos"))
    table = F.array(*[F.lit(s) for s in sums])

    def halve(at: Column, _: Column) -> Column:
        """Keep the half of low..high that holds the first sum that isn't below u."""
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        above = F.get(table, middle) >= at["u"]
        return F.struct(at["u"].alias("u"), F.when(above, at["low"]).otherwise(F.least(middle + 1, at["high"])).alias("low"), F.when(above, middle).otherwise(at["high"]).alias("high"))

    start = F.struct(u.alias("u"), F.lit(0).alias("low"), F.lit(steps - 1).alias("high"))
    cell = F.aggregate(F.array(*[F.lit(0)] * math.ceil(math.log2(steps) + 1)), start, halve, lambda at: at["low"])
    return strands.withColumn("copies", F.bround(F.lit(low) + (cell + 0.5) * (high - low) / steps).cast("long"))


def replicated(strands: DataFrame) -> DataFrame:
    """One row per copy (from 0); strands with no copies vanish."""
    return strands.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).drop("copies")


def error_kind(u: Column, base: Column, rates: Mapping[str, Mapping[str, float]]) -> Column:
    """s, pi, d or ld by the base's relative weights."""
    out = None
    for b, r in rates.items():
        names = ("s", "pi", "d", "ld")
        total = sum(r.get(n, 0.0) for n in names) or 1.0
        at, picked = 0.0, None
        for n in names[:-1]:
            at += r.get(n, 0.0) / total
            picked = (F if picked is None else picked).when(u < at, n)
        out = (F if out is None else out).when(base == b, picked.otherwise("ld" if r.get("ld") else "s"))
    return out.otherwise("s")


def _weighted(u: Column, options: list[tuple[object, float]]) -> Column:
    total, at, picked = sum(w for _, w in options) or 1.0, 0.0, None
    for value, w in options[:-1]:
        at += w / total
        picked = (F if picked is None else picked).when(u < at, F.lit(value))
    last = F.lit(options[-1][0])
    return picked.otherwise(last) if picked is not None else last


def with_errors(reads: DataFrame, total: Mapping[str, float], rates: Mapping[str, Mapping[str, float]], seed: int) -> DataFrame:
    """reads (file_id, pos, copy, seq) with read: the strand after synthesis and sequencing errors.

    At every original base an error happens with the summed total rate, times 3/2 in the first third of the
    strand as it is by then and 3/4 beyond. Fully deleted reads stay, as ''."""
    p0 = sum(total.get(k, 0.0) for k in ("d", "ld", "i", "s"))
    if not 0 <= 1.5 * p0 <= 1:
        raise ValueError(f"the error rates add up to {p0}; 1.5 times that must be a probability")
    bases = [(b, rates.get(b, {}).get("i", 0.0)) for b in BASES]
    length = F.length("seq")

    def step(state: Column, j: Column) -> Column:
        base = F.substr("seq", j, F.lit(1))
        digested = rng.digest(seed, "file_id", "pos", "copy", j)
        u1, u2, u3 = (rng.uniform(digested, k) for k in range(3))
        done, rest = F.length(state["out"]), length - j + 1
        p = F.when(3 * done <= done + rest, 1.5 * p0).otherwise(0.75 * p0)
        kind = error_kind(u2, base, rates)
        other = F.lit(None).cast("string")
        for b, names in OTHERS.items():
            other = F.when(base == b, F.substr(F.lit(names), F.floor(u3 * 3).cast("int") + 1, F.lit(1))).otherwise(other)
        added = F.when(kind == "s", other).when(kind == "pi", F.concat(_weighted(u3, bases), base)).otherwise("")
        hit = u1 < p
        skipping = state["skip"] > 0
        out = F.when(skipping, state["out"]).when(hit, F.concat(state["out"], added)).otherwise(F.concat(state["out"], base))
        skip = F.when(skipping, state["skip"] - 1).when(hit & (kind == "ld"), _weighted(u3, list(LONG)) - 1).otherwise(0)
        return F.struct(out.alias("out"), skip.cast("int").alias("skip"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("skip"))
    folded = F.aggregate(F.sequence(F.lit(1), length), start, step, lambda s: s["out"])
    return reads.withColumn("read", F.when(length > 0, folded).otherwise(""))


def with_stutter(reads: DataFrame, rates: Mapping[str, Mapping[str, float]], seed: int) -> DataFrame:
    """Stutter mode: each base becomes n copies, n geometric in its `i` rate and 0 among them; then each
    base is substituted with its `s` rate. A rate of 1 or more has no finite n and is refused."""
    if any(r.get("i", 0.0) >= 1 for r in rates.values()):
        raise ValueError("a base's insertion rate must be below 1")
    length = F.length("seq")

    def by_base(base: Column, value) -> Column:
        out = F.lit(0.0)
        for b in BASES:
            out = F.when(base == b, value(rates.get(b, {}))).otherwise(out)
        return out

    def one(j: Column) -> Column:
        base = F.substr("seq", j, F.lit(1))
        digested = rng.digest(seed, "file_id", "pos", "copy", j)
        log = by_base(base, lambda r: F.lit(math.log(r["i"]) if r.get("i", 0) > 0 else -1e300))
        n = F.floor(F.ln((rng.draw(digested, 0) + 1) / float(rng.SPAN)) / log)
        u = rng.uniform(digested, 2)
        other = base
        for b, names in OTHERS.items():
            other = F.when(base == b, F.substr(F.lit(names), F.floor(u * 3).cast("int") + 1, F.lit(1))).otherwise(other)
        put = F.when(rng.uniform(digested, 1) < by_base(base, lambda r: F.lit(r.get("s", 0.0))), other).otherwise(base)
        return F.repeat(put, n.cast("int"))

    return reads.withColumn("read", F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), length), one), "")).otherwise(""))


def shuffled(reads: DataFrame, seed: int) -> DataFrame:
    """reads with rank (from 0) in a seeded order within each file."""
    w = Window.partitionBy("file_id").orderBy(rng.digest(seed, "file_id", "pos", "copy"), "pos", "copy")
    return reads.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def fasta_form(ranked: DataFrame) -> DataFrame:
    """`>Seq{rank}` and the read, empty reads left out."""
    rows = ranked.where("read <> ''")
    lines = F.array(F.concat(F.lit(">Seq"), F.col("rank").cast("string")), F.col("read"))
    return rows.select("file_id", "rank", F.posexplode(lines).alias("k", "line")).select("file_id", (2 * F.col("rank") + F.col("k")).alias("pos"), "line")


def indexed_form(ranked: DataFrame) -> DataFrame:
    """`{rank + 1} read`; the origin stays in columns beside it."""
    return ranked.where("read <> ''").select("file_id", F.col("pos").alias("origin_pos"), "copy", F.concat_ws(" ", (F.col("rank") + 1).cast("string"), F.col("read")).alias("line"))


def origin_blocks(reads: DataFrame) -> DataFrame:
    """Origin, a line of stars, its reads and two blank lines, as (file_id, origin pos, k, line)."""
    per = reads.groupBy("file_id", "pos", "seq").agg(F.array_sort(F.collect_list(F.struct("copy", "read"))).alias("rs"))
    lines = F.concat(F.array(F.col("seq"), F.lit("*" * 29)), F.transform("rs", lambda r: r["read"]), F.array(F.lit(""), F.lit("")))
    return per.select("file_id", "pos", F.posexplode(lines).alias("k", "line"))


def origin_blocks_in_order(reads: DataFrame) -> DataFrame:
    """The same of rows in order, those of a strand together in one partition and by copy: lines are put out as the rows pass, with no exchange."""
    kind = lambda c: reads.schema[c].dataType.simpleString()
    names = ["file_id", "pos", "seq", "read"]

    def run(batches):
        held, size = None, 0  # the row before, and how many of its strand have been
        for b in batches:
            if not b.num_rows:
                continue
            new = changes([b.column(c) for c in names[:3]], held and held[:3])
            at = np.arange(b.num_rows)
            begun = np.maximum.accumulate(np.where(new, at, -1))
            number = np.where(begun < 0, size + at, at - begun)  # of a read in its strand
            before = np.concatenate([[size], number[:-1] + 1])  # reads of the strand that ends before a new one
            ended = new & (before > 0)
            many = 1 + 2 * new + 2 * ended
            row = np.repeat(at, many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            place += np.where(ended[row], 0, 2)  # 0 and 1 are the end of the strand before
            place[~new[row]] = 4  # 2 and 3 begin a strand, 4 is the read
            past = place < 2
            n = b.num_rows
            lines = pa.concat_arrays([b.column("read"), b.column("seq"), pa.array(["*" * 29, ""], b.schema.field("read").type)])
            line = np.select([past, place == 2, place == 3], [2 * n + 1, n + row, 2 * n], row)
            k = np.select([past, place < 4], [before[row] + 2 + place, place - 2], number[row] + 2)
            first = [pa.array([held[i] if held else None], b.schema.field(c).type) for i, c in enumerate(names[:2])]
            owner = pa.array(row + np.where(past, 0, 1))
            files = [pa.concat_arrays([f, b.column(c)]).take(owner) for f, c in zip(first, names[:2], strict=True)]
            yield pa.RecordBatch.from_arrays([*files, pa.array(k.astype(np.int32)), lines.take(pa.array(line))], names=["file_id", "pos", "k", "line"])
            held, size = [b.column(c)[-1].as_py() for c in names], int(number[-1]) + 1
        if held:
            kinds = [b.schema.field(c).type for c in names]
            ends = [pa.array([held[i]] * 2, kinds[i]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array([size + 2, size + 3], pa.int32()), pa.array(["", ""], kinds[3])], names=["file_id", "pos", "k", "line"])

    return reads.select(*names).mapInArrow(run, f"file_id {kind('file_id')}, pos {kind('pos')}, k int, line string")
