"""Readers and parsers of the text formats: strand files, FASTA, indexed reads, cluster blocks, bits.

Readers give (file_id, pos, line); parsers take such rows, from files or any table, so a parser is a
plan over a scan. Windows hold a block of a file's positions, never a whole file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.durable import apart
from helixlake.functions import flat
from helixlake.operators.scan import changes, running_counts


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_id (its path), pos (line number from 0) and line of text files, splits read in parallel.

    A split's lines are numbered within it; counts of the splits before it in its file are added."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    blocks = rows.groupBy("file_id", "block").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_id", "block", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["file_id", "block"]).select("file_id", (F.col("n") - F.col("first") + F.col("before")).alias("pos"), "line")


def lines_of(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same from a column that holds whole files."""
    return rows.select(F.col(key).alias("file_id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def strand_lines(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Strand files: one strand per line, surrounding blanks off; blank lines dropped unless kept."""
    rows = lines.select("file_id", "pos", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("seq"))
    return rows if keep_blank else rows.where("seq <> ''")


def cut_bits(data: pa.Array, segment_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which value, number within it, bits as 0 and 1) of the segments of binary values; the last of each is padded with 0."""
    octets, at = flat.bytes_of(data)
    n = -(-np.diff(at) * 8 // segment_length)
    first = np.concatenate([[0], np.cumsum(n)])
    if segment_length % 8 == 0:
        bits = np.unpackbits(flat.moved(octets, at, first[:-1] * (segment_length // 8), int(first[-1]) * (segment_length // 8)))
    else:
        bits = flat.moved(np.unpackbits(octets), at * 8, first[:-1] * segment_length, int(first[-1]) * segment_length)
    return np.repeat(np.arange(len(n)), n), np.arange(first[-1]) - np.repeat(first[:-1], n), bits.reshape(-1, segment_length)


def segments_as(rows: DataFrame, key: str, data: Column, segment_length: int, write: Callable[[np.ndarray, np.ndarray], pa.Array], name: str) -> DataFrame:
    """file_id, seg_no and a string of each segment, which `write` makes of a batch's numbers and bits (a row of 0 and 1 each)."""

    def run(batches):
        for batch in batches:
            for b in flat.cut(batch, "data", 1 << 20):
                which, number, bits = cut_bits(b.column("data"), segment_length)
                yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(which)), pa.array(number), write(number, bits)], names=["file_id", "seg_no", name])

    given = rows.select(F.col(key).alias("file_id"), data.alias("data"))
    return given.mapInArrow(run, f"file_id {given.schema['file_id'].dataType.simpleString()}, seg_no long, {name} string")


def bit_segments(rows: DataFrame, key: str, data: Column, segment_length: int = 120) -> DataFrame:
    """file_id, seg_no, bits: 8 bits a byte, most significant first, the last segment padded with 0."""
    return segments_as(rows, key, data, segment_length, lambda number, bits: flat.rows_of(48 + bits), "bits")


def bit_size(data: Column) -> Column:
    return (F.octet_length(data) * 8).cast("long")


def fasta_sequences(lines: DataFrame) -> DataFrame:
    """Every line that isn't a header is a sequence."""
    return lines.where(~F.col("line").startswith(">")).select("file_id", "pos", F.trim("line").alias("seq"))


def fasta_labels(lines: DataFrame) -> DataFrame:
    """file_id, seq_label, cluster_label from headers >Seq{n}_Cluster{m}; a label's last header wins."""
    heads = lines.where(F.col("line").startswith(">")).select("file_id", "pos", F.regexp_extract("line", r"Seq(\d+)", 1).alias("s"), F.regexp_extract("line", r"Cluster(\d+)", 1).alias("c"))
    heads = heads.where("s <> '' AND c <> ''").select("file_id", "pos", F.col("s").cast("int").alias("seq_label"), F.col("c").cast("int").alias("cluster_label"))
    return heads.groupBy("file_id", "seq_label").agg(F.max_by("cluster_label", "pos").alias("cluster_label"))


def numbered_blocks(lines: DataFrame) -> DataFrame:
    """lines with block: how many headers stand above, 0 before the first; the header's own line counts. A file of any length
    is counted in blocks of positions."""
    return running_counts(lines, ["file_id"], "pos", block=F.col("line").startswith(">"))


def fasta_records(lines: DataFrame) -> DataFrame:
    """Multi-line FASTA: file_id, record (from 1), header, seq joined over its lines."""
    rows = numbered_blocks(lines).where("block > 0")
    rows = rows.groupBy("file_id", F.col("block").alias("record")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return rows.select("file_id", "record", F.expr("substr(ls[0].line, 2)").alias("header"), F.array_join(F.transform(F.expr("slice(ls, 2, size(ls))"), lambda x: F.trim(x["line"])), "").alias("seq"))


def length_band(rows: DataFrame, low: int = 100, high: int = 300) -> DataFrame:
    return rows.where(F.length("seq").between(low, high))


def indexed_reads(lines: DataFrame) -> DataFrame:
    """`{tag} {seq}` lines: those with an N are dropped, the first run of blanks separates."""
    rows = lines.where(~F.contains("line", F.lit("N")) & (F.trim("line") != ""))
    text = rows.select("file_id", F.trim("line").alias("line")).withColumn("at", F.regexp_instr("line", F.lit(r"\s"))).where("at > 0")  # a match ends where it is found
    tag = F.substr("line", F.lit(1), F.col("at") - 1).try_cast("int")
    return text.select("file_id", tag.alias("tag"), F.ltrim(F.substr("line", F.col("at")), F.lit(" \t\n\x0b\f\r")).alias("seq"))


def cluster_blocks(lines: DataFrame) -> DataFrame:
    """Cluster files: '>' starts a cluster, lines that start with A, C, G or T are members, '=' and other
    lines are skipped, clusters without members vanish. cluster_id counts from 0, member_no from 0.

    Headers and members are counted in blocks of positions; a member's number is its count less that of its cluster's first, so neither a file nor
    a cluster is one task's work."""
    counted = running_counts(lines, ["file_id"], "pos", block=F.col("line").startswith(">"), m=F.col("line").rlike("^[ATCG]"))
    rows = counted.where(F.col("line").rlike("^[ATCG]") & (F.col("block") > 0))
    firsts = rows.groupBy("file_id", "block").agg(F.min("m").alias("first"))
    known = apart(running_counts(firsts, ["file_id"], "block", id=F.lit(True)), "file_id", "block")
    return rows.join(known, ["file_id", "block"]).select("file_id", (F.col("id") - 1).cast("int").alias("cluster_id"), (F.col("m") - F.col("first")).cast("int").alias("member_no"), F.trim("line").alias("seq"))


def cluster_blocks_in_order(lines: DataFrame) -> DataFrame:
    """The same of lines that come in order, a file's all in one partition: counted as they pass, without an exchange or a sort. What is kept between batches
    are four numbers of the last file."""

    def run(batches):
        last, heads, clusters, member, held = None, 0, 0, -1, 0  # of the last file: headers, clusters, number of its last member and headers above that
        for b in batches:
            if not b.num_rows:
                continue
            data, at = flat.bytes_of(b.column("line"))
            begins = np.zeros(b.num_rows, np.uint8)
            begins[np.diff(at) > 0] = data[at[:-1][np.diff(at) > 0]]
            new = changes([b.column("file_id")], last)
            last = [b.column("file_id")[-1].as_py()]
            file, head = np.cumsum(new), begins == ord(">")
            total = np.cumsum(head)
            block = total - np.maximum.accumulate(np.where(new, total - head, -heads))
            rows = np.flatnonzero(np.isin(begins, np.frombuffer(b"ATCG", np.uint8)) & (block > 0))
            f, k, places = file[rows], block[rows], np.arange(len(rows))
            new_file = np.diff(f, prepend=0) != 0
            first = new_file | (np.diff(k, prepend=held) != 0)
            count = np.cumsum(first)
            cluster = count - np.maximum.accumulate(np.where(new_file, count - 1, -clusters)) - 1
            begun = np.maximum.accumulate(np.where(first, places, -1))
            number = np.where(begun < 0, member + 1 + places, places - begun)
            heads = int(block[-1])
            if len(rows) and f[-1] == file[-1]:
                clusters, member, held = int(cluster[-1]) + 1, int(number[-1]), int(k[-1])
            elif file[-1]:
                clusters, member, held = 0, -1, 0
            took = b.take(pa.array(rows))
            out = [took.column("file_id"), pa.array(cluster.astype(np.int32)), pa.array(number.astype(np.int32)), pc.utf8_trim(took.column("line"), " ")]
            yield pa.RecordBatch.from_arrays(out, names=["file_id", "cluster_id", "member_no", "seq"])

    kind = lines.schema["file_id"].dataType.simpleString()
    return lines.select("file_id", "line").mapInArrow(run, f"file_id {kind}, cluster_id int, member_no int, seq string")


def json_map(rows: DataFrame, column: str) -> DataFrame:
    """rows with `parsed`: a JSON object as a map of strings; null if malformed."""
    return rows.withColumn("parsed", F.from_json(column, "map<string,string>"))


def uploaded_strands(rows: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """file_id, pos, seq of uploaded texts: split, trimmed, blank parts left out; pos numbers what stays from 0."""
    parts = F.filter(F.transform(F.split(text, separator, -1), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.col(key).alias("file_id"), F.posexplode(parts).alias("pos", "seq")).withColumn("pos", F.col("pos").cast("long"))


def scheme_of(name: Column | str) -> Column:
    """The scheme in a coded file's name, `{prefix}_{scheme}{unix time}`; the prefix may hold underscores. Empty without one."""
    return F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"_([a-z]+)[0-9]+$", 1)


def pair_file(lines: DataFrame) -> DataFrame:
    """Pairs written as JSON arrays or Python tuples of integers, one or many to a line. Nothing is evaluated."""
    found = F.regexp_extract_all("line", F.lit(r"[\[(]\s*(-?\d+)\s*,\s*-?\d+\s*[\])]"), F.lit(0))
    rows = lines.select("file_id", "pos", F.posexplode(found).alias("k", "p"))
    inner = F.substr("p", F.lit(2), F.length("p") - 2)
    return rows.select("file_id", "pos", F.col("k").cast("long").alias("k"), F.substring_index(inner, ",", 1).cast("long").alias("a"), F.substring_index(inner, ",", -1).cast("long").alias("b"))


@dataclass(frozen=True)
class TrieConfig:
    """Parameters of segment clustering; the option letters are those of the command line it stands for."""

    input_path: str = ""
    read_len: int = 150
    vertical_drift: int = 3
    horizontal_drift: int = 3
    head: int = 20
    tail: int = 20
    processes: int = 0
    output: str = ""

    @classmethod
    def from_text(cls, text: str, **options) -> TrieConfig:
        """From JSON with // comments; options override."""
        import json
        import re

        body = json.loads(re.sub(r"(?m)^\s*//.*$|(?<=[\s,{])//[^\n]*", "", text) or "{}")
        known = {k: v for k, v in (body | options).items() if k in cls.__dataclass_fields__}
        return cls(**known)

    @classmethod
    def from_args(cls, args: list[str]) -> TrieConfig:
        names = {"-I": "input_path", "-L": "read_len", "-D": "horizontal_drift", "-V": "vertical_drift", "-H": "head", "-T": "tail", "-P": "processes", "-O": "output"}
        found = {names[k]: v for k, v in zip(args[::2], args[1::2], strict=True)}
        return cls(**{k: v if k in ("input_path", "output") else int(v) for k, v in found.items()})
