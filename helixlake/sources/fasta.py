"""Spark data source `fasta`: files of records, one `>` line and any number of sequence lines each, read and written in parallel.

    spark.dataSource.register(FastaSource)
    spark.read.format("fasta").option("splitBytes", 64 << 20).load("hdfs://host/folder")
    records.write.format("fasta").mode("append").save("/folder")

A file is cut into ranges of bytes, and a range has the records whose header begins in it, so one huge file is many tasks. Rows have file_id (the file's
path), at (the header's byte: the order in the file), header and seq. Surrounding blanks and line ends of sequence lines go; what stands before a file's first header is no record;
a record without sequence lines has an empty seq. Files whose names begin with . or _ are left out, and so are empty ones.

Written rows have header and seq, null ones empty, further columns are ignored. A task writes one file under a name that nobody reads, which the
commit moves into place once all tasks have ended; of a failed job nothing stays. `overwrite` takes the earlier files away after that.

Files are reached through pyarrow's file systems: local, HDFS and object stores.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = "file_id string, at long, header string, seq string"


def files_of(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of a path and its visible files, in order; a file's own path is one."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(path))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(inner) :].split("/") if p)
    return system, sorted((f for f in found if f.is_file and f.size and not (f is not info and hidden(f))), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    path: str
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


def records_of(stream: io.BufferedReader, start: int, end: int) -> Iterator[tuple[int, str, str]]:
    """at, header, seq of the records whose header begins within [start, end). The stream stands at max(start - 1, 0)."""
    at = start
    if start:
        at += len(stream.readline()) - 1  # the rest of the line before; nothing, if the range begins with a line
    header, begun, parts = None, 0, []
    for line in stream:
        if line.startswith(b">"):
            if header is not None:
                yield begun, header, "".join(parts)
            if at >= end:
                return
            header, begun, parts = line[1:].decode("utf-8", "replace").rstrip("\r\n"), at, []
        elif header is not None:
            parts.append(line.decode("utf-8", "replace").strip())
        elif at >= end:
            return
        at += len(line)
    if header is not None:
        yield begun, header, "".join(parts)


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Range]:
        _, files = files_of(self.path)
        cut = [Range(self.path, f.path, at, min(at + self.split_bytes, f.size)) for f in files for at in range(0, f.size, self.split_bytes)]
        return cut or [Range(self.path, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = files_of(self.path) if "://" not in self.path else (fs.FileSystem.from_uri(self.path)[0], None)
        rows, size = [], 0
        with system.open_input_file(partition.file) as raw:
            raw.seek(max(partition.start - 1, 0))
            for at, header, seq in records_of(io.BufferedReader(raw, 1 << 20), partition.start, partition.end):
                rows.append((partition.file, at, header, seq))
                size += len(header) + len(seq) + 64
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file_id", "at", "header", "seq"])


class FastaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = self._place()
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex[:12]}.fasta"  # each attempt its own
        system.create_dir(f"{folder}/_job-{self.job}", recursive=True)
        written = 0
        with system.open_output_stream(f"{folder}/_job-{self.job}/{name}") as out:
            for batch in iterator:
                for header, seq in zip(batch.column("header").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                    written += out.write(f">{header or ''}\n{seq or ''}\n".encode())
        return Written((name,) if written else ())

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._place()
        system.create_dir(folder, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file] if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{folder}/_job-{self.job}/{name}", f"{folder}/{name}")
        for f in old:
            system.delete_file(f.path)
        self._sweep(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*self._place())

    def _sweep(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_job-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_job-{self.job}")


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        if not {"header", "seq"} <= set(schema.names):
            raise ValueError("records to write need the columns header and seq")
        return FastaWriter(self.options["path"], overwrite)
