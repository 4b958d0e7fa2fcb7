"""Exact dedup by a tree merge of sorted digest runs.

Every partition turns its rows into a sorted run of (key, winner, count). The runs are then merged
over a hypercube of 2**b slots: in each round a slot swaps with its fan_in - 1 partners so that
log2(fan_in) more bits of the slot number equal the key's leading bits. After b bits a slot holds
all entries of its key range. Equal keys collapse at every level, so a text with a third of all
rows is one entry per run from the first level on, and no slot ever gathers more than its share of
the distinct keys.

A slot receives its partners' runs one after another. It spools each to scratch and merges them in one
multiway pass that holds a batch of each run; nothing is sorted again. Runs are told apart by where
keys fall, so a shuffle that broke their order would cost time, not correctness.

A key is SHA-256, byte length and a second, independent 64-bit hash together: entries that disagree in
any of them stay apart at every level.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable, join_checked
from helixlake.llm.arrow import map_batches

WIDTH, SPOOL_BYTES, BATCH_ROWS, MOST_RUNS = 48, 1 << 20, 8_192, 128
NO_ID = -(2**63)
RUN = "key binary, slot int, keep_id long, group_size long, n_keep long"
NAMES = [x.split()[0] for x in RUN.split(", ")]
_SCHEMA = pa.schema([("key", pa.binary(WIDTH)), ("slot", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_keep", pa.int64())])


def identity(text: str = "text") -> Column:
    """A text's key: SHA-256, byte length and a second hash; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    number = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    return F.concat(F.unhex(F.sha2(value, 256)), number(F.octet_length(value).cast("long")), number(F.xxhash64(value, F.lit(7)))).alias("key")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return np.frombuffer(column.buffers()[1], dtype=f"S{WIDTH}")[column.offset : column.offset + len(column)]


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary(WIDTH)), *batch.columns[1:]], schema=_SCHEMA)


def collapse(batches: Iterator[pa.RecordBatch], largest: bool = True) -> Iterator[pa.RecordBatch]:
    """Make neighbours of equal key one entry in a sorted stream; the last entry waits for the next batch."""
    best = np.maximum if largest else np.minimum
    wait: pa.RecordBatch | None = None
    for batch in batches:
        rows = batch if wait is None else pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
        keys = _keys(rows)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ids, n_keep = rows.column("keep_id").to_numpy(), rows.column("n_keep").to_numpy()
        keep = best.reduceat(ids, at)
        same = ids == np.repeat(keep, np.diff(np.append(at, rows.num_rows)))
        sizes, kept = np.add.reduceat(rows.column("group_size").to_numpy(), at), np.add.reduceat(np.where(same, n_keep, 0), at)
        merged = pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), rows.column(1).take(pa.array(at)), pa.array(keep), pa.array(sizes), pa.array(kept)], schema=_SCHEMA)
        wait = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if wait is not None:
        yield wait


class Spool:
    """A sorted run, in memory while it is small and in the task's scratch space beyond."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115  closed when read to its end
        self.writer = pa.ipc.new_stream(self.file, _SCHEMA)

    def add(self, batch: pa.RecordBatch) -> None:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            self.writer.write_batch(batch.slice(k, BATCH_ROWS))

    def read(self) -> Iterator[pa.RecordBatch]:
        self.writer.close()
        self.file.seek(0)
        yield from pa.ipc.open_stream(self.file)
        self.file.close()


def runs_of(batches: Iterator[pa.RecordBatch]) -> list[Spool]:
    """The sorted runs that follow one another in a stream: a new one begins wherever a key falls."""
    runs: list[Spool] = []
    last = None
    for batch in batches:
        keys = _keys(batch)
        falls = (np.flatnonzero(keys[1:] < keys[:-1]) + 1).tolist()
        if last is None or keys[0] < last:
            runs.append(Spool())
        for a, b in zip([0, *falls], [*falls, len(keys)], strict=True):
            if a:
                runs.append(Spool())
            runs[-1].add(batch.slice(a, b - a))
        last = keys[-1]
    return runs


def multiway(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Merge sorted streams: whatever isn't above the least of their current batches' last keys can go out."""
    heads: list[list] = []  # stream, rest of its batch, keys of that
    for run in runs:
        if (batch := next(run, None)) is not None:
            heads.append([run, batch, _keys(batch)])
    while len(heads) > 1:
        bound = min(keys[-1] for _, _, keys in heads)
        parts = []
        for head in heads:
            n = int(np.searchsorted(head[2], bound, side="right"))
            if n:
                parts.append(head[1].slice(0, n))
                head[1], head[2] = head[1].slice(n), head[2][n:]
                if not len(head[2]) and (batch := next(head[0], None)) is not None:
                    head[1], head[2] = batch, _keys(batch)
        heads = [h for h in heads if len(h[2])]
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        yield rows if len(parts) == 1 else rows.take(pa.array(np.argsort(_keys(rows), kind="stable")))
    for run, batch, _ in heads:
        yield batch
        yield from run


def merge(batches: Iterator[pa.RecordBatch], largest: bool = True) -> Iterator[pa.RecordBatch]:
    """One sorted run without repeated keys from a stream of runs; at most MOST_RUNS are open at a time."""
    runs = runs_of(_fixed(batches))
    while len(runs) > MOST_RUNS:
        one = Spool()
        for batch in collapse(multiway([r.read() for r in runs[:MOST_RUNS]]), largest):
            one.add(batch)
        runs = [*runs[MOST_RUNS:], one]
    for batch in collapse(multiway([r.read() for r in runs]), largest):
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), *batch.columns[1:]], names=NAMES)


def tree_merge(rows: DataFrame, id_col: str = "doc_id", keep: str = "largest", fan_in: int = 8, slots: int | None = None) -> DataFrame:
    """Winner, size and winner's row count of each distinct key in rows (key and id_col).

    slots is rounded up to a power of two; the default follows spark.sql.shuffle.partitions. The
    result has key, keep_id (null if no row of the group has an id), group_size and n_keep.
    """
    spark = rows.sparkSession
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, math.ceil(math.log2(max(1, slots))))  # one round at least: there may be more partitions than slots
    step = max(1, int(math.log2(fan_in)))
    largest = keep == "largest"
    none = NO_ID if largest else 2**63 - 1
    prefix = F.shiftright(F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("int"), 24 - bits)
    start = F.pmod(F.spark_partition_id(), F.lit(1 << bits)).cast("int")
    one = F.lit(1).cast("long")
    first = rows.select("key", start.alias("slot"), F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("keep_id"), one.alias("group_size"), one.alias("n_keep"))
    runs = map_batches(first.sortWithinPartitions("key"), lambda batches: merge(batches, largest), RUN)
    for low in range(0, bits, step):
        mask = ((1 << min(step, bits - low)) - 1) << low
        target = F.col("slot").bitwiseAND(F.lit(~mask)).bitwiseOR(prefix.bitwiseAND(F.lit(mask))).cast("int")
        runs = map_batches(runs.withColumn("slot", target).repartitionById(1 << bits, F.col("slot")), lambda batches: merge(batches, largest), RUN)
    return runs.select("key", F.when(F.col("keep_id") != none, F.col("keep_id")).alias("keep_id"), "group_size", "n_keep")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 and n_keep.

    Null texts equal the empty text. Rows that repeat both id and text belong to one group, count
    in its size and are all marked kept if their id wins; n_keep counts them. Rows of null id never
    win over another; a group of them alone has keep_id null and is kept. Very long texts are one key
    like any. Columns beyond id and text are ignored, whatever their names. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("__hl_id"), identity(text))
    groups = tree_merge(rows, "__hl_id", keep, fan_in).where("group_size > 1")
    joined = rows.join(groups, "key", "left").withColumnRenamed("__hl_id", id_col)
    lone = F.col("group_size").isNull()
    keep_id = F.when(lone, F.col(id_col)).otherwise(F.col("keep_id"))
    return joined.select(
        F.col(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col(id_col).eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
        F.coalesce("n_keep", F.lit(1).cast("long")).alias("n_keep"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the copies of other rows; columns as they were, one row for each distinct text.

    Only decisions about copies are written and joined, broadcast if few enough; texts aren't
    shuffled then. Where the winner's row itself repeats, one of its rows stays.
    """
    found = durable(exact_groups(docs, id_col, text, keep).where("group_size > 1"), "copies")
    out = {"__hl_id": F.col(id_col), "__hl_sha": F.col("text_sha256")}
    lost = found.where("NOT kept").select(*[c.alias(n) for n, c in out.items()]).distinct()
    marked = docs.withColumn("__hl_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    hit = F.col(id_col).eqNullSafe(F.col("__hl_id")) & (F.col("__hl_digest") == F.col("__hl_sha"))
    left = join_checked(marked, lost, hit, "left_anti")
    twice = found.where("kept AND n_keep > 1").select(*[c.alias(n) for n, c in out.items()]).distinct()
    if not twice.isEmpty():
        again = join_checked(left, twice, hit, "left_semi").dropDuplicates([id_col, "__hl_digest"])
        left = join_checked(left, twice, hit, "left_anti").unionByName(again)
    return left.drop("__hl_digest")
