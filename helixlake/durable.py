"""Tables that cut lineage: written to the folder the cluster shares, then read back.

A lost executor costs nothing but a re-read, whereas a cached or locally checkpointed block would
be gone. Paths go through Spark's own writers and readers, so any Hadoop file system will do.
"""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNT = itertools.count()
#: Temporary folders of local sessions by application; paths made within each open scratch().
_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only for a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="helixlake-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/helixlake/{name}-{next(_COUNT)}-{uuid.uuid4().hex[:12]}"
    for made in _OPEN:
        made.append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(table: DataFrame) -> None:
    """Delete a table that `durable` returned, once nothing reads it any more."""
    delete(table.sparkSession, table.durable_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end all tables and folders that operators make within. Their results are lazy and read
    such tables: consume them within, too."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not made]
        for path in made:
            delete(spark, path)


def _width(field: T.StructField) -> Column:
    """About how many bytes a column takes in a row of a broadcast."""
    at, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(at), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.aggregate(F.coalesce(at, F.array().cast(kind)), F.lit(24).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(at))), F.lit(0)) * 2 + 24  # digits take about half of what numbers do
    return F.lit(8)


def fits(small: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> bool:
    """Whether a table is within both bounds; no more than max_rows + 1 of its rows are read."""
    width = sum((_width(f).cast("long") for f in small.schema), F.lit(16).cast("long"))
    r = small.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return r["n"] <= max_rows and r["b"] <= max_bytes


def join_checked(big: DataFrame, small: DataFrame, on, how: str, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Join with `small` broadcast if its rows and bytes are within bounds, else by shuffle. `small` should be
    durable: it is measured first."""
    if fits(small, max_rows, max_bytes):
        small = F.broadcast(small)
    return big.join(small, on, how)


def apart(aggregated: DataFrame, *keys: str) -> DataFrame:
    """An aggregate dealt out by another hash of its keys, ahead of a join on them.

    Adaptive execution splits skewed partitions only of joins whose sides are plain exchanges. A side
    that ends in an aggregate on the join's keys is none; this gives it an exchange of its own, which
    carries only the aggregate's rows, so that the other side's hot key can be split.
    """
    return aggregated.repartition(F.xxhash64(*keys, F.lit(1)))
