"""Queries over the job result table and the file metadata table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable, join_checked

#: Messages that reach users as they are: fixed values, with the codecs' divisor rules in words.
KNOWN_ERRORS = (
    "Segment length must be divisible by 2",
    "Segment length must be divisible by 8",
    "Segment length must be divisible by 16",
)
MASKED = "internal error"
RESULT = "id long, result string, dataType string, error string, is_valid boolean, user long"
INFO = "id long, user long, file_name string, suffix_name string, content_type string, bit_size int, segment_length int, index_length int, total_count int, bits int, prime_segment_length int"


def latest(results: DataFrame) -> DataFrame:
    """The newest result of every user and type: one pass with partial aggregation, no window."""
    newest = results.groupBy("user", "dataType").agg(F.max_by(F.struct("id", "result", "error", "is_valid"), "id").alias("r"))
    return newest.select("user", "dataType", "r.id", "r.result", "r.error", "r.is_valid")


def latest_of(results: DataFrame, user: int, kind: str) -> DataFrame:
    return results.where((F.col("user") == user) & (F.col("dataType") == kind)).orderBy(F.desc("id")).limit(1)


def unread(results: DataFrame) -> DataFrame:
    """Unacknowledged results; callers filter by user and order by id."""
    return results.where(~F.col("is_valid")).select("user", "id", "error", "dataType")


def acknowledge(results: DataFrame, ids: DataFrame, user: int | None = None) -> DataFrame:
    """results with is_valid set for the given ids, of one user if given (others stay as they are)."""
    hit = results.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    own = F.lit(True) if user is None else F.col("user") == user
    return hit.withColumn("is_valid", F.col("is_valid") | (F.coalesce("__hit", F.lit(False)) & own)).drop("__hit")


def by_id(results: DataFrame, key: int, user: int | None = None) -> DataFrame:
    return results.where((F.col("id") == key) & (F.lit(True) if user is None else F.col("user") == user))


def masked(errors: DataFrame) -> DataFrame:
    """errors with the message replaced unless it is a known one; empty stays empty."""
    plain = F.col("error").isin(*KNOWN_ERRORS) | (F.col("error") == "")
    return errors.withColumn("error", F.when(plain, F.col("error")).otherwise(MASKED))


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


#: Rows of a join's result that a task should make.
TASK_ROWS = 4_000_000


def metadata_of(requests: DataFrame, info: DataFrame) -> DataFrame:
    """requests (user, file_name) with their metadata, and `error` where there is none.

    Names that are asked for often and known often give as many rows as both counts multiplied, so the join is cut by what it makes and not by what it
    reads: the requests of such a name are dealt over several tasks, each of which gets its metadata."""
    keys = ["user", "file_name"]
    asked, known = requests.groupBy(*keys).agg(F.count("*").alias("__a")), info.groupBy(*keys).agg(F.count("*").alias("__b"))
    made = asked.join(known, keys).withColumn("__m", F.col("__a").cast("double") * F.col("__b"))
    total = made.agg(F.sum("__m")).first()[0] or 0.0
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_ROWS))
    often = made.where(F.col("__m") > TASK_ROWS).select(*keys, F.least(F.col("__a"), F.ceil(F.col("__m") / TASK_ROWS)).cast("int").alias("__n"))
    often = durable(often, "often-asked")
    dealt, spread = requests.withColumn("__salt", F.lit(0)), info.withColumn("__salt", F.lit(0))
    if not often.isEmpty():
        salt = F.pmod(F.xxhash64(*requests.columns), F.coalesce("__n", F.lit(1))).cast("int")
        dealt = join_checked(requests, often, keys, "left").withColumn("__salt", salt).drop("__n")
        spread = join_checked(info, often, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    on = [*keys, "__salt"]
    joined = dealt.repartition(parts, *on).join(spread.repartition(parts, *on), on, "left").drop("__salt")
    return joined.withColumn("error", F.when(F.col("id").isNull(), "no such file"))


def insertable(rows: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows that would break the uniqueness of (user, file_name)). Of rows that clash
    with each other the first by id is inserted."""
    first = rows.groupBy("user", "file_name").agg(F.min("id").alias("id"))
    fresh = rows.join(first, ["user", "file_name", "id"], "left_semi").join(info.select("user", "file_name"), ["user", "file_name"], "left_anti")
    return fresh, rows.join(fresh.select("user", "file_name", "id"), ["user", "file_name", "id"], "left_anti")
