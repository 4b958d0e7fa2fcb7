"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths matter to a packing, and there are at most `capacity` of them. So the corpus is
reduced to a histogram of lengths; bins are planned over it as patterns with multiplicities, and
the pieces of each length are dealt to the planned places by rank. The plan's size is bounded by
the capacity and not by the corpus, while the packing is one of the whole corpus.

A pattern is filled greedily (largest length that fits the gap), then its smallest document of
length s leaves if two unpacked documents a + b fill the expanded gap (gap + s) more tightly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixlake.durable import durable
from helixlake.llm.arrow import map_batches

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids. A byte-level BPE whose ranks lie beside it as .tiktoken is run by tiktoken, which
    gives the same ids several times faster; texts that hold a special token's string are not."""
    from pathlib import Path

    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def exact() -> Tokenizer:
        return Tokenizer.from_file(path)

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return lambda text: exact().encode(text, add_special_tokens=False).ids
    import base64
    import json

    import public_tokenizers
    import tiktoken

    pairs = (line.split() for line in ranks.read_bytes().splitlines())
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    special = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])]
    return lambda text: exact().encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)


def cut(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces; the first piece takes the remainder."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, flush: int = 8 << 20) -> DataFrame:
    """Pieces of every document: id_col, piece, start, length and ids (little-endian uint32).

    Null texts count as empty: one piece that holds the separator alone. Repeated rows give pieces
    each. Batches of at most about `flush` bytes of ids leave a task at once.
    """
    path = path or tokenizer_path()
    schema = StructType.fromDDL("piece int, start long, length long, ids binary")
    schema = StructType([docs.schema[id_col], *schema.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            kind, out, held = batch.schema.field(0).type, [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "")
                ids.append(SEPARATOR)
                data = np.array(ids, dtype="<u4")
                starts = cut(len(data), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
                    out.append((doc, k, a, b - a, data[a:b].tobytes()))
                held += data.nbytes
                if held >= flush:
                    yield _batch(out, names, kind)
                    out, held = [], 0
            if out:
                yield _batch(out, names, kind)

    return map_batches(docs.select(F.col(id_col), F.col(text).alias("__hl_text")), run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, how many in a bin), ...]) that use up the histogram exactly."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit a sequence of {capacity}")
        left[length] += n
    sizes = np.arange(capacity + 1)
    plan = []
    while left.any():
        free, used, gap = left.copy(), {}, capacity

        def put(length: int, n: int, free=free, used=used) -> None:
            free[length] -= n
            used[length] = used.get(length, 0) + n
            if not used[length]:
                del used[length]

        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            put(int(fits[-1]), 1)
            gap -= int(fits[-1])
        if gap and used:
            small = min(used)
            room = gap + small
            largest = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = np.flatnonzero(free[:room])
            b = largest[room - a]
            b = np.where((a == b) & (free[a] < 2), largest[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if total.size and total.max() > small:
                k = int(total.argmax())
                put(small, -1)
                put(int(a[k]), 1)
                put(int(b[k]), 1)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: intervals sorted by (length, first rank)."""
    rows, taken, base = [], {}, 0
    for times, used in plan:
        offset = 0
        for length, n in used:
            first = taken.get(length, 0)
            rows.append((length, first, n, base, offset))
            taken[length] = first + times * n
            offset += length * n
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "n", "base", "offset"), table.T, strict=True))


def ranked(pieces: DataFrame, id_col: str, per_bucket: int = 20_000) -> DataFrame:
    """pieces with __hl_at: 0, 1, ... within each length. A length's pieces are ranked in hash buckets,
    whose offsets come from the counts by (length, bucket); no length is ever in one task."""
    spark = pieces.sparkSession
    buckets = max(8, pieces.count() // per_bucket, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = pieces.withColumn("__hl_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    counts = marked.groupBy("length", "__hl_bucket").agg(F.count("*").alias("__hl_n"))
    before = Window.partitionBy("length").orderBy("__hl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__hl_bucket", F.coalesce(F.sum("__hl_n").over(before), F.lit(0)).alias("__hl_before"))
    own = Window.partitionBy("length", "__hl_bucket").orderBy(id_col, "piece")
    local = marked.withColumn("__hl_rank", F.row_number().over(own) - 1)
    return local.join(offsets, ["length", "__hl_bucket"]).withColumn("__hl_at", F.col("__hl_rank") + F.col("__hl_before")).drop("__hl_bucket", "__hl_rank", "__hl_before")


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (id_col, piece, length and any others) with sequence_id and offset.

    Read more than once: pieces should be durable. Sequences are numbered from 0 and filled
    without gaps from offset 0. Other columns stay as they are, but for any named sequence_id or offset, which are
    replaced. Rows that repeat have places of their own. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = places(best_two_fit(counts, capacity))
    key = where["length"] << 44 | where["first"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64), side="right") - 1
        k = rank.to_numpy(np.int64) - where["first"][at]
        bin_, slot = np.divmod(k, where["n"][at])
        return pd.DataFrame({"sequence_id": where["base"][at] + bin_, "offset": where["offset"][at] + slot * length.to_numpy(np.int64)})

    placed = ranked(pieces, id_col).withColumn("__hl_place", place("length", "__hl_at"))
    return placed.select(*pieces.columns, F.col("__hl_place.sequence_id").alias("sequence_id"), F.col("__hl_place.offset").alias("offset"))


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Digest form of a packing: one row per piece with ids_crc32 in place of the ids."""
    pieces = tokenise(docs, id_col, text, path, capacity).select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(durable(pieces, "pieces"), id_col, capacity)
