"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent zstandard frames, each holding whole WARC records, with the seek
table of the zstd seekable format (a skippable frame of compressed and decompressed frame sizes
and checksums) at its end. An index row maps a record to its frame and the offset within the
frame, so one record is read with two range reads: the seek table's tail and its frame.

Every task attempt writes a bundle under a name of its own and only the index rows of the attempt
that Spark commits count, so a retried or speculative task does no harm; `sweep` removes the rest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.durable import durable, fresh_path, join_checked
from helixlake.llm.arrow import map_batches

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Fixed values of the zstd seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}/{salt}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record. A revisit holds the HTTP head alone, and the digest and size of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT)]
        if refers_to is not None:
            fields += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload (empty for a revisit) of one record; ValueError if it is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block, end = rest[: (n := int(fields["Content-Length"]))], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] != "revisit" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("a payload differs from its digest")
    return fields, payload


class BundleWriter:
    """Records in, frames out; close() appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.sink, self.limit, self.coder = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.at = 0
        self.placed: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> Iterator[tuple]:
        """Index rows (without the bundle) of the frame that the record completes, if it does."""
        self.placed.append((page_id, self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        import xxhash

        if not self.open:
            return
        plain = b"".join(self.open)
        frame = self.coder.compress(plain)
        self.sink.write(frame)
        for page_id, offset, n in self.placed:
            yield page_id, len(self.table), self.at, len(frame), offset, n
        self.table.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.at += len(frame)
        self.open, self.placed, self.held = [], [], 0

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(source) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed size, checksum) of each frame, from the file's tail."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & HAS_CHECKSUM else 8
    source.seek(size - 9 - n * width)
    raw, out, at = source.read(n * width), [], 0
    for k in range(n):
        entry = struct.unpack_from("<III" if width == 12 else "<II", raw, k * width)
        out.append((at, entry[0], entry[1], entry[2] if width == 12 else -1))
        at += entry[0]
    return out


def read_frame(source, entry: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    source.seek(entry[0])
    plain = zstandard.ZstdDecompressor().decompress(source.read(entry[1]), max_output_size=max(1, entry[2]))
    if len(plain) != entry[2] or entry[3] not in (-1, xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF):
        raise ValueError("a frame differs from its seek table entry")
    return plain


def roles(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with record_type and refers_to.

    Of payloads equal by SHA-1 and length that have min_bytes or more, the row with the largest id
    is the response; null payloads are empty ones. A null id never wins over another. Columns beyond id, url and
    payload are ignored, whatever their names; rows that repeat are records each; an empty table gives an empty one.

    Only digests are shuffled: repeated ones are counted and written, and broadcast to the payloads as far as
    they are few (durable.join_checked).
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    key = [F.sha1(F.encode(body, "UTF-8")).alias("k"), F.octet_length(body).cast("long").alias("n")]
    digests = pages.select(F.col(id_col).alias("page_id"), *key).where(F.col("n") >= min_bytes)
    groups = digests.groupBy("k", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url"), body.alias("payload"), *key)
    marked = join_checked(rows, durable(groups, "repeated-payloads"), ["k", "n"], "left")
    again = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return marked.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("best")).alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str | None = None) -> DataFrame:
    """Write rows of `roles` as bundles in folder (a URI that executors share); return their index. date is that of
    capture, by default the time of the call."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        writer = name = None
        number = 0
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in INDEX.split(", ")])

        def rows_of(found) -> Iterator[pa.RecordBatch]:
            found = [(r[0], name, *r[1:]) for r in found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes, level)
                data = encode_record(page_id.as_py(), url.as_py(), payload.as_py().encode("utf-8", "surrogatepass"), kind.as_py(), refers_to.as_py(), date)
                yield from rows_of(writer.add(page_id.as_py(), data))
                if writer.at >= bundle_bytes:
                    yield from rows_of(writer.close())
                    writer.sink.close()
                    writer, number = None, number + 1
        if writer is not None:
            yield from rows_of(writer.close())
            writer.sink.close()

    return durable(map_batches(rows, run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point at: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. A frame is decompressed once for its neighbouring rows.

    Rows are dealt out by frames, READ_BYTES of records a task, and to all cores at least: adaptive execution would go by
    the bytes of the index, which is small."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        name = source = None
        frame, plain, table = -1, b"", []
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if source is not None:
                        source.close()
                    name, frame = r["bundle"], -1
                    source = fs.open_input_file(f"{root}/{name}")
                    table = seek_table(source)
                if r["frame"] != frame:
                    frame = r["frame"]
                    plain = read_frame(source, table[frame])
                fields, payload = decode_record(plain[r["record_offset"] : r["record_offset"] + r["record_bytes"]])
                page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                again = fields["WARC-Type"] == "revisit"
                out.append((page and int(page), fields.get("WARC-Target-URI"), None if again else payload, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], to and int(to)))
                held += len(payload)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    held = index.agg(F.sum("record_bytes")).first()[0] or 0
    tasks = max(held // READ_BYTES + 1, min(held // FRAME_BYTES + 1, index.sparkSession.sparkContext.defaultParallelism))
    dealt = index.repartition(int(tasks), "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset")
    return map_batches(dealt, run, schema)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0, date: str | None = None) -> tuple[DataFrame, str]:
    """Write pages as bundles; return the index and the folder. An empty table gives an empty index."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return write_bundles(roles(pages, id_col, payload, min_bytes), folder, date=date), folder


def sweep(spark: SparkSession, index: DataFrame, folder: str) -> int:
    """Delete bundles that the index doesn't name (left by task attempts that failed); their number."""
    from pyarrow.fs import FileSelector, FileSystem

    fs, root = FileSystem.from_uri(folder)
    there = [x.base_name for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".warc.zst")]
    if not there:
        return 0
    files = spark.createDataFrame([(x,) for x in there], "bundle string")
    lost = [r["bundle"] for r in files.join(index.select("bundle").distinct(), "bundle", "left_anti").collect()]
    for x in lost:
        fs.delete_file(f"{root}/{x}")
    return len(lost)
