"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

Unit vectors are projected onto a few Gaussian directions. The squared ratio of a projected to a true distance is chi-square distributed with as
many degrees of freedom as there are directions, whatever the data. A kd-tree over the projections gives a query's neighbours in
order of projected distance; each is verified on its whole vector, and the search stops once a neighbour as near as the k-th found would,
with probability `recall`, have been met already. Of the true neighbours, that share is found on average; ties at the k-th place aside.

The top of the kd-tree is fitted on a bounded sample (`sample` rows) and deals all rows into cells, so that a task holds what lies together; each
batch of a task has a tree of its own. The k-th best of the sample bounds a query's search from its start, so cells far from it are left at once.
Queries meet all rows in parts of `chunk`, which alone are broadcast.

Vectors that are null or zero or hold a component that is null or not finite take no part, nor do rows with a null vec_id, nor vectors
whose squared length is beyond the range of doubles. Shorter vectors count as followed by
zeros. Rows that repeat count each, but no row is a neighbour of a query with its vec_id. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable
from helixlake.llm.arrow import map_batches
from helixlake.llm.vectors import Best, bounded_sample, chunks, finite, first_of, matrix

#: Directions (an even number), the share of neighbours to be found, rows of the sample, queries at once, rows of a leaf, cells' rows in the sample.
DIRECTIONS, RECALL, SAMPLE, CHUNK, LEAF, CELL = 8, 0.98, 4_096, 2_048, 128, 64


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of an even number m of degrees of freedom stays below with probability p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def gaussian(width: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


def cosines(x: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Each row summed in the same order, so that equal vectors have equal cosines."""
    return (x * query).sum(axis=1) / (lengths * length)


def lengths_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Tree:
    """A kd-tree: medians of the widest direction, down to leaves of at most `leaf` points; order lists the points leaf by leaf."""

    def __init__(self, y: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(y))
        self.low, self.high, self.span, self.child = [], [], [], []
        self.cut: list[tuple[int, float]] = []
        todo = [(0, len(y), -1)]
        while todo:
            start, end, parent = todo.pop()
            own = y[self.order[start:end]]
            node = len(self.span)
            if parent >= 0:
                self.child[parent].append(node)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.span.append((start, end))
            self.child.append([])
            self.cut.append((0, 0.0))
            if end - start > leaf:
                axis, mid = int((self.high[-1] - self.low[-1]).argmax()), (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], mid)]
                self.cut[node] = (axis, float(y[self.order[start + mid], axis]))
                todo += [(start + mid, end, node), (start, start + mid, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def nearest_in(self, at: np.ndarray) -> np.ndarray:
        """Squared distance of a point from each node's box."""
        off = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        return (off * off).sum(axis=1)

    def cells(self, y: np.ndarray) -> np.ndarray:
        """The number of the leaf whose side of all cuts each point is on."""
        out, todo = np.zeros(len(y), dtype=np.int32), [(0, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            if not self.child[node]:
                out[rows] = self.span[node][0]
                continue
            axis, value = self.cut[node]
            left = y[rows, axis] < value
            # children are made left first
            todo += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out


def projected(rows: DataFrame, top: Tree, directions: np.ndarray) -> DataFrame:
    """vec_id, x, y of all rows: the projection of the unit vector, in order of the top tree's cells."""
    width, m = directions.shape

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), width)
            y = (x / lengths_of(x)[:, None]) @ directions
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * m), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), lists, pa.array(top.cells(y))], ["vec_id", "x", "y", "cell"])

    table = map_batches(rows.select("vec_id", "x"), run, "vec_id long, x array<double>, y array<double>, cell int")
    return durable(table.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"), "projected").drop("cell")


def search(table: DataFrame, shared, k: int, width: int, directions: int, stop: float, leaf: int) -> DataFrame:
    """no, vec_id, score: each task's k nearest for each query, none farther than the query's bound. shared holds no, vec_id, x, y, bound."""

    def run(batches):
        q = shared.value
        own = lengths_of(q["x"])
        best = [Best(k, np.float64) for _ in own]
        for b in batches:
            ids, x, y = b.column("vec_id").to_numpy(), matrix(b.column("x"), width), matrix(b.column("y"), directions)
            if not len(ids):
                continue
            tree = Tree(y, leaf)
            ids, x = ids[tree.order], x[tree.order]
            lengths = lengths_of(x)
            for i in range(len(own)):
                away = tree.nearest_in(q["y"][i])
                heap = [(away[0], 0)]
                while heap:
                    r2, node = heapq.heappop(heap)
                    least = max(q["bound"][i], best[i].scores[-1]) if best[i].full else q["bound"][i]
                    if r2 >= max(2 - 2 * least, 1e-12) * stop:
                        break
                    for c in tree.child[node]:
                        heapq.heappush(heap, (away[c], c))
                    if not tree.child[node]:
                        s, e = tree.span[node]
                        score = cosines(x[s:e], lengths[s:e], q["x"][i], own[i])
                        near = (score >= least - 1e-12) & (ids[s:e] != q["vec_id"][i])
                        best[i].add(score[near], ids[s:e][near])
        n = [len(t.ids) for t in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["no"], n)), pa.array(np.concatenate([t.ids for t in best])), pa.array(np.concatenate([t.scores for t in best]))], ["no", "vec_id", "score"])

    return map_batches(table, run, "no long, vec_id long, score double")


def nearest(rows: DataFrame, queries, k: int = 5, directions: int = DIRECTIONS, recall: float = RECALL, sample: int = SAMPLE, chunk: int = CHUNK, leaf: int = LEAF, seed: int = 12) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found of each row for which the column `queries` holds."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & finite("x"))
    square = F.aggregate("x", F.lit(0.0), lambda n, v: n + v * v)
    kept = kept.where((square > 0) & (square < float("inf")))
    width = kept.agg(F.max(F.size("x"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    some = bounded_sample(kept, sample).toArrow().combine_chunks()
    some_ids, some_x = some.column("vec_id").to_numpy(), matrix(some.column("x").combine_chunks(), width)
    some_lengths, axes = lengths_of(some_x), gaussian(width, directions, seed)
    table = projected(kept, Tree((some_x / some_lengths[:, None]) @ axes, CELL), axes)
    stop, out = chi_square_quantile(recall, directions), []
    for part in chunks(kept.where(queries), chunk):
        a = part.toArrow().combine_chunks()
        ids, x = a.column("vec_id").to_numpy(), matrix(a.column("x").combine_chunks(), width) if len(a) else np.zeros((0, width))
        lengths = lengths_of(x)
        others = np.where(some_ids == ids[:, None], -2.0, (x / lengths[:, None]) @ (some_x / some_lengths[:, None]).T)
        bound = np.partition(others, -k, axis=1)[:, -k] if len(some_ids) >= k else np.full(len(a), -2.0)
        shared = spark.sparkContext.broadcast({"no": a.column("no").to_numpy(), "vec_id": ids, "x": x, "y": (x / lengths[:, None]) @ axes, "bound": bound})
        found = first_of(search(table, shared, k, width, directions, stop, leaf), k, ["no"], "vec_id")
        out.append(durable(found.join(part.select("no", F.col("vec_id").alias("query_id")), "no").select("query_id", "rank", "vec_id", "score"), "nearest"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
