"""Token counts as rollups kept up to date by signed deltas.

The state is a folder. Each batch of changes (inserts, revisions, deletes) is turned into signed
rows of a ledger: +count for what a document has now, -count for what it had. Their sums by (source,
lang, tokenizer) are the batch's delta; totals are the sum of the deltas.

A manifest lists the parts that count and the ids of all batches ever committed, folded ones too. A
commit writes its data under new names, then a new manifest, and renames that once to the next
generation's name: the newest manifest is the state, and whatever none names counts for nothing. So a
batch or a compaction that dies at any point leaves the state as it was and can be tried again, a
committed batch is never applied twice, and of two writers of one generation one fails. The ledger
is dealt into buckets by id, and a batch reads only those that its ids fall in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.durable import durable, fresh_path
from helixlake.llm.arrow import map_batches
from helixlake.llm.packing import encoder, tokenizer_path
from helixlake.llm.words import raw_words

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, docs long"
BUCKETS = 32
ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions by name: a Column builder, or the file of a public tokenizer.
TOKENIZERS: dict[str, Callable[[Column], Column] | str] = {
    "words_v1": lambda text: F.size(raw_words(text)).cast("long"),
    "bytes_v1": lambda text: F.octet_length(F.coalesce(text, F.lit(""))).cast("long"),
}
BPE = {"byte_bpe_50k_v1": "byte_bpe_50k.json"}


def counted(docs: DataFrame, tokenizers: dict | None = None, text: str = "text") -> DataFrame:
    """LEDGER rows of docs (doc_id, text, source, lang): one per row and tokenizer; null texts count 0."""
    tokenizers = TOKENIZERS | BPE if tokenizers is None else tokenizers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))
    files = {k: tokenizer_path(v) for k, v in tokenizers.items() if isinstance(v, str)}
    plain = {k: v for k, v in tokenizers.items() if not isinstance(v, str)}
    counts = F.array(*[F.struct(F.lit(k).alias("tokenizer"), v(F.col("text")).alias("tokens")) for k, v in plain.items()]) if plain else F.expr("cast(array() as array<struct<tokenizer: string, tokens: bigint>>)")
    rows = rows.select("doc_id", "source", "lang", counts.alias("counts"), "text")
    if files:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                more = []
                for old, value in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                    whole = value.as_py() or ""
                    more.append([*old, *({"tokenizer": k, "tokens": len(encoder(f)(whole))} for k, f in files.items())])
                kind = pa.list_(pa.struct([("tokenizer", pa.string()), ("tokens", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more, type=kind)], names=["doc_id", "source", "lang", "counts"])

        rows = map_batches(rows, run, "doc_id long, source string, lang string, counts array<struct<tokenizer: string, tokens: bigint>>")
    spread = rows.select("doc_id", "source", "lang", F.explode("counts").alias("c"))
    return spread.select("doc_id", "source", "lang", "c.tokenizer", "c.tokens", F.lit(1).cast("long").alias("docs"))


def bucket_of(doc_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Rollup:
    """Totals in a folder of a Hadoop file system that executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or fresh_path(spark, "token-counts")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """generation, parts (name and batch of each) and done (ids of all committed batches) of the newest one."""
        at = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        last = max((n for n in names if n.isdigit()), default=None)
        if last is None:
            return {"generation": 0, "parts": [], "done": []}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{last}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, old: dict, parts: list[dict], done: list[str]) -> None:
        """Make the next generation the state; FileExistsError if another writer was first."""
        new = {"generation": old["generation"] + 1, "parts": parts, "done": done}
        draft = self._path(f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        to = self._path(f"{self.folder}/manifests/{new['generation']:012d}")
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            raise FileExistsError(f"another writer has committed generation {new['generation']}")

    def committed(self) -> list[str]:
        """Ids of committed batches, those of folded ones too, sorted."""
        return sorted(self.manifest()["done"])

    def _read(self, parts: list[dict], kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/parts/{x['name']}/{kind}" for x in parts]
        none = self.spark.createDataFrame([], schema)
        for path in paths:
            none = none.unionByName(self.spark.read.schema(schema).parquet(path))
        return none

    def _net(self, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read(parts, "ledger", f"{LEDGER}, bucket int")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets))
        net = rows.groupBy("doc_id", *GROUP).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        return net.where("docs <> 0 OR tokens <> 0")

    def ledger(self) -> DataFrame:
        """Net count per document, group and tokenizer; rows that cancel out are gone."""
        return self._net(self.manifest()["parts"])

    def _totals(self, parts: list[dict]) -> DataFrame:
        return self._read(parts, "rollup", ROLLUP).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """docs and tokens by group; groups without documents left are gone."""
        return self._totals(self.manifest()["parts"])

    def _write(self, batch: str, signed: DataFrame, delta: DataFrame | None = None) -> dict:
        """Ledger rows and their sums as a new part that no manifest names yet."""
        part = {"name": uuid.uuid4().hex, "batch": batch}
        at = f"{self.folder}/parts/{part['name']}"
        rows = signed.select("doc_id", *GROUP, "tokens", "docs", bucket_of("doc_id").alias("bucket"))
        # By ranges: a task has few buckets, and a bucket as many tasks as its size asks for.
        rows.repartitionByRange("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{at}/ledger")
        if delta is None:
            delta = self._read([part], "ledger", f"{LEDGER}, bucket int").groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.coalesce(8).write.parquet(f"{at}/rollup")
        return part

    def apply(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch; False if it is committed already, and nothing changes then.

        upserts are LEDGER rows: a document that the ledger has is revised (all its old rows leave),
        any other is inserted. deletes has doc_id; unknown ids change nothing, and an id in both is
        revised. Repeated rows of an upsert count as often as they occur. Rows of null id can be
        inserted but neither revised nor deleted. Columns beyond those named are ignored.
        """
        old = self.manifest()
        if batch in old["done"]:
            return False
        signed = self.spark.createDataFrame([], LEDGER)
        if upserts is not None:
            upserts = durable(upserts.select(*signed.columns), "upserts")
            signed = signed.unionByName(upserts)
        gone = [x.select(F.col("doc_id").cast("long").alias("doc_id")) for x in (upserts, deletes) if x is not None]
        if gone and old["parts"]:
            ids = durable((gone[0] if len(gone) == 1 else gone[0].union(gone[1])).distinct(), "touched")
            touched = [r[0] for r in ids.select(bucket_of("doc_id")).distinct().collect()]  # at most BUCKETS
            was = self._net(old["parts"], touched).join(ids, "doc_id", "left_semi")
            signed = signed.unionByName(was.withColumns({"tokens": -F.col("tokens"), "docs": -F.col("docs")}).select(*signed.columns))
        self._commit(old, [*old["parts"], self._write(batch, signed)], [*old["done"], batch])
        return True

    def compact(self) -> None:
        """Fold all parts into one. Totals and committed ids stay as they are; the old parts' files remain until `vacuum`."""
        old = self.manifest()
        if len(old["parts"]) > 1:
            self._commit(old, [self._write("", self._net(old["parts"]), self._totals(old["parts"]))], old["done"])

    def vacuum(self) -> int:
        """Delete files that the newest manifest doesn't name; the number of parts deleted. For when no other
        writer and no reader of an older state is at work."""
        now = self.manifest()
        parts, manifests = self._path(f"{self.folder}/parts"), self._path(f"{self.folder}/manifests")
        stale = [x.getPath() for x in self._fs.listStatus(parts) if x.getPath().getName() not in {p["name"] for p in now["parts"]}] if self._fs.exists(parts) else []
        old = [x.getPath() for x in self._fs.listStatus(manifests) if x.getPath().getName() != f"{now['generation']:012d}"] if self._fs.exists(manifests) else []
        for path in [*stale, *old]:
            self._fs.delete(path, True)
        return len(stale)


def rolled_up(docs: DataFrame, labels: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """Totals by source, lang and tokenizer after these batches over docs: all rows are inserted; documents of low
    quality are revised, to the source with `/low` behind it, and toxic ones deleted; the state is compacted;
    and the first batch is retried, which changes nothing.

    Null sources and languages are groups of their own (a low document of null source is of `/low`), null and
    empty texts count 0 words and tokens. Texts are counted whole. Rows that repeat count each; revising or
    deleting an id concerns all its rows. An empty table gives an empty one.
    """
    state = Rollup(docs.sparkSession)
    rows = durable(counted(docs, tokenizers), "counted")
    state.apply("0001-insert", rows)
    bad = labels.where("toxic = 1").select("doc_id").distinct()
    low = labels.where("quality = 0").select("doc_id").distinct().join(bad, "doc_id", "left_anti")
    revised = rows.join(low, "doc_id", "left_semi").withColumn("source", F.concat(F.coalesce("source", F.lit("")), F.lit("/low")))
    state.apply("0002-revise", revised, bad)
    state.compact()
    state.apply("0001-insert", rows)
    return state.totals()
