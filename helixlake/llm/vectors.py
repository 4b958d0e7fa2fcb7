"""What the vector operators share: usable rows, matrices of Arrow columns, chunks of a query set, the nearest few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.durable import durable


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles; a list shorter than width is followed by zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def bounded_sample(rows: DataFrame, size: int) -> DataFrame:
    """The `size` rows of the smallest hash of vec_id: a sample that doesn't depend on partitions."""
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size)


def chunks(queries: DataFrame, size: int) -> Iterator[DataFrame]:
    """A query set, written once with a number `no` for each row, in parts of about `size` rows: each is to be held against all rows in turn.
    Numbers and not ids are dealt, so that a repeated id doesn't fill a part."""
    table = durable(queries.withColumn("no", F.monotonically_increasing_id()), "queries")
    parts = -(-table.count() // size)
    for k in range(parts):
        yield table.where(F.pmod(F.xxhash64("no"), F.lit(parts)) == k)


def first_of(rows: DataFrame, k: int, by: list[str], other: str, score: str = "score") -> DataFrame:
    """rows with rank 1 to k by score, ties to the smaller other. Spark limits each task's rows before it deals them out."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best (score, id) so far: higher scores first, ties to the smaller id."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int, kind) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, kind), np.empty(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.ids) == self.k

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.full:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]
