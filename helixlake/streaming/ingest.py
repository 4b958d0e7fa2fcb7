"""Reads as a stream: line files arrive in a folder and are parsed, counted and evaluated as they come.

The batch parsers work on rows of (file_id, pos, line); a stream of lines has no positions across
files, so only the line-wise forms are offered here, and everything else goes by micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixlake.functions import seqfn
from helixlake.operators import evaluate


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """file_id, line and arrived (the file's modification time) of text files as they appear."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived"))


def stream_reads(lines: DataFrame) -> DataFrame:
    """Sequences of FASTA or strand files: headers and blank lines dropped."""
    return lines.where(~F.col("line").startswith(">") & (F.trim("line") != "")).select("file_id", F.trim("line").alias("seq"), "arrived")


def windowed_scores(reads: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count, GC percent, longest run and motifs of reads by arrival window; reads later than `late` are dropped
    and the state of closed windows with them."""
    windows = reads.withWatermark("arrived", late).groupBy(F.window("arrived", width).alias("w"))
    scores = windows.agg(F.count("*").alias("n"), (F.avg(seqfn.gc_fraction("seq")) * 100).alias("mean_gc"), F.max(seqfn.longest_run("seq")).alias("longest_run"), F.sum(evaluate.motif_count("seq")).alias("motifs"))
    return scores.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_gc", "longest_run", "motifs")


def each_batch(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `handle` on every micro-batch of what is there, then stop. The batch number makes handlers idempotent."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def append_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet, exactly once by the sink's own log, then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
