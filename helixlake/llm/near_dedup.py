"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Documents with the same word sequence form a node. MinHash signatures of nodes are cut into bands,
whose count and rows come from the threshold and a target recall; nodes that share a band hash lie
in one bucket and are candidates. No closure of candidates is taken, since texts that are merely
alike chain without end. Instead a node goes to one neighbourhood, named by the smallest label
within two steps of it, and the pairs of a neighbourhood are verified there. A candidate pair whose
nodes went to different neighbourhoods is verified in the first bucket it shares. So every candidate
pair is verified exactly once, on full n-gram sets. Units (neighbourhoods and buckets) are cut into
blocks of bounded size; every pair of blocks is one group's work, counts the links of its nodes and
yields a spanning forest of the true links. Components of the true links are the classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable, join_checked
from helixlake.llm.arrow import hand_back, map_batches, steady
from helixlake.operators.components import connected

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK_NODES, BLOCK_GRAMS, FINE_NODES, FINE_BLOCKS = 512, 400_000, 128, 32
#: Steps over which a neighbourhood spreads.
STEPS = 2
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have while a pair at the threshold shares a band with
    probability `recall` and bands x rows <= hashes. More rows mean fewer false candidates."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


class _WordHashes(dict):
    """64-bit hashes of words with A-Z lower-cased; forgets everything once it holds `limit` words."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        super().__init__()
        self.limit, self.digest = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word.translate(_LOWER).encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None, known: _WordHashes) -> np.ndarray:
    found = _WORD.findall(text or "")
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def gram_hashes(h: np.ndarray, n: int = N) -> np.ndarray:
    """Hashes of all n-grams in order; fewer words than n make one gram, none make none."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = (out * _STEP) ^ h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
    return out * _MIX


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def band_hashes(grams: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(documents, bands) array of 64-bit band hashes of documents that have grams each."""
    flat = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]])
    a, b = _permutations(bands * rows)
    out = np.zeros((len(grams), bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(grams), band + 1, dtype=np.uint64) * _MIX
        for k in range(band * rows, band * rows + rows):
            value = (value ^ np.minimum.reduceat(flat * a[k] + b[k], at)) * _STEP
            value ^= value >> np.uint64(31)
        out[:, band] = value
    return out


def signatures(docs: DataFrame, id_col: str, text: str, bands: int, rows: int, chunk: int = 1 << 17) -> DataFrame:
    """doc_id, text_key, node (hash of the word sequence), n_grams and bands of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _WordHashes()
        for batch in batches:
            start, held, size, nodes = 0, [], 0, []

            def emit(stop: int, batch=batch) -> pa.RecordBatch:
                full = [k for k, g in enumerate(held) if len(g)]
                found: list[list | None] = [None] * len(held)
                if full:
                    for k, row in zip(full, band_hashes([held[k] for k in full], bands, rows).view(np.int64), strict=True):
                        found[k] = row
                part = batch.slice(start, stop - start)
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array([len(g) for g in held], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n_grams", "bands"])

            for k, value in enumerate(batch.column(2)):
                h = word_hashes(value.as_py(), known)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                held.append(gram_hashes(h))
                size += len(h)
                if size >= chunk:
                    yield emit(k + 1)
                    start, held, size, nodes = k + 1, [], 0, []
            if held:
                yield emit(batch.num_rows)

    kind = docs.schema[id_col].dataType.simpleString()
    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    return map_batches(rows_in, run, f"doc_id {kind}, text_key long, node binary, n_grams int, bands array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """node, label (its 64-bit hash), n_grams, band, bucket and least (the bucket's smallest label) for each
    bucket that holds more than one node. Labels only deal out work: equal ones of different nodes do no harm."""
    spread = nodes.select("node", F.xxhash64("node").alias("label"), "n_grams", F.posexplode("bands").alias("band", "bucket"))
    met = spread.groupBy("bucket").agg(F.count("*").alias("c"), F.min("label").alias("least")).where("c > 1").drop("c")
    return spread.join(apart(met, "bucket"), "bucket")


def neighbourhoods(shared: DataFrame, steps: int = STEPS) -> DataFrame:
    """node and home: the smallest label within `steps` shared buckets of the node."""
    homes = shared.groupBy("node").agg(F.min("least").alias("home"))
    for _ in range(steps - 1):
        homes = durable(homes, "homes")
        least = shared.select("node", "bucket").join(homes, "node").groupBy("bucket").agg(F.min("home").alias("home"))
        homes = shared.select("node", "bucket").join(apart(least, "bucket"), "bucket").groupBy("node").agg(F.min("home").alias("home"))
    return durable(homes, "homes")


def units(nodes: DataFrame) -> DataFrame:
    """node, home and places: array of (unit, band, block, blocks) of each node that has candidates. A neighbourhood
    is a unit with band -1. A bucket whose nodes have several homes is one too, unless an earlier band has a bucket
    of the same nodes: any pair's first shared bucket is among those kept."""
    shared = durable(shared_buckets(nodes), "shared")
    homes = neighbourhoods(shared)
    spots = durable(shared.select("node", "label", "n_grams", "band", "bucket").join(homes, "node"), "spots")
    per = spots.groupBy("bucket", "band").agg(F.count("*").alias("k"), F.min("home").alias("low"), F.max("home").alias("high"), F.bit_xor("label").alias("x"), F.bit_xor(F.xxhash64("label", F.lit(1))).alias("y"))
    mixed = per.where("low <> high").groupBy("k", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("m")).select("m.band", "m.bucket")
    inside = spots.groupBy("node", "n_grams", "home").agg(F.lit(-1).alias("band")).select("node", "n_grams", "home", F.col("home").alias("unit"), "band")
    across = spots.join(apart(mixed, "bucket", "band"), ["bucket", "band"]).select("node", "n_grams", "home", F.col("bucket").alias("unit"), "band")
    rows = durable(inside.unionByName(across), "units")
    sizes = rows.groupBy("unit", "band").agg(F.count("*").alias("k"), F.sum(F.col("n_grams").cast("long")).alias("g")).where("k > 1")
    # Many small blocks spread a hot group over tasks, few large ones copy it less: fine up to FINE_BLOCKS of them.
    fine = F.least(F.ceil(F.col("k") / FINE_NODES), F.lit(FINE_BLOCKS))
    blocks = F.greatest(fine, F.ceil(F.col("k") / BLOCK_NODES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    dealt = rows.join(apart(sizes, "unit", "band"), ["unit", "band"]).select("node", "home", F.struct("unit", "band", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks")).alias("place"))
    return dealt.groupBy("node", "home").agg(F.collect_list("place").alias("places"))  # at most one place per band and one more


def overlaps(grams: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections of sets of unique hashes; grams that only one set has are left out first, the
    others are counted in strips of at most `cells` cells."""
    m = len(grams)
    out = np.zeros((m, m), dtype=np.float32)
    flat, owner = np.concatenate(grams), np.repeat(np.arange(m, dtype=np.int32), [len(g) for g in grams])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    take = shared[column]
    owner, column = owner[take], (np.cumsum(shared) - 1)[column[take]]
    width = max(64, cells // max(1, m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((m, min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def links_within(grams: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of those wanted pairs that reach the threshold; sets whose sizes differ too much can't."""
    size = np.array([len(g) for g in grams], dtype=np.float64)
    wanted = wanted & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9)
    np.fill_diagonal(wanted, False)
    hit = np.zeros_like(wanted)
    met = np.flatnonzero(wanted.any(axis=1))
    if len(met):
        both = overlaps([grams[k] for k in met]).astype(np.float64)
        near = both >= threshold * (size[met][:, None] + size[met][None, :] - both) - 1e-9
        hit[np.ix_(met, met)] = near & wanted[np.ix_(met, met)]
    return hit


def first_shared(bands: np.ndarray) -> np.ndarray:
    """Number of the first band whose hash each pair of rows shares; as many as there are bands if none is."""
    first = np.full((len(bands), len(bands)), bands.shape[1], dtype=np.int16)
    for band in range(bands.shape[1] - 1, -1, -1):
        first[bands[:, band][:, None] == bands[:, band][None, :]] = band
    return first


def _roots(hit: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component."""
    root = np.arange(len(hit))
    while True:
        low = np.minimum(root, np.where(hit, root[None, :], len(hit)).min(axis=1, initial=len(hit)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verify(docs: DataFrame, members: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """node, root and links for each node and pair of blocks it is in; members has node, rep_id, rep_key, n_docs,
    bands, home and places."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    same = (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    names = ["node", "n_docs", "bands", "home", "places"]
    texts = join_checked(rows, members, same, "inner").select(*names, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            blobs = [np.unique(gram_hashes(word_hashes(x.as_py(), known))).tobytes() for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(blobs, pa.binary())], names=[*names, "grams"])

    place = "struct<unit: long, band: int, block: int, blocks: int>"
    found = map_batches(texts, sets, f"node binary, n_docs long, bands array<long>, home long, places array<{place}>, grams binary")
    spread = found.select("node", "n_docs", "bands", "home", "grams", F.explode("places").alias("p"))
    pairs = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    pairs = pairs.select("p.unit", "p.band", F.least("p.block", "other").alias("i"), F.greatest("p.block", "other").alias("j"), "p.block", "node", "n_docs", "home", "bands", "grams")

    def judge(table: pa.Table) -> pa.Table:
        steady()
        nodes, at = np.unique(np.array(table.column("node").to_pylist(), dtype="S16").view("V16"), return_index=True)  # repeated rows
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        table = table.take(pa.array(at))
        names = table.column("node").to_pylist()
        wanted = np.ones((len(names), len(names)), dtype=bool)
        if i != j:
            block = table.column("block").to_numpy()
            wanted &= block[:, None] != block[None, :]
        if band >= 0:
            home = table.column("home").to_numpy()
            wanted &= (home[:, None] != home[None, :]) & (first_shared(np.array(table.column("bands").to_pylist(), dtype=np.int64)) == band)
        hit = links_within([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("grams")], wanted, threshold)
        if len(names) > 64:
            hand_back()
        return pa.table({
            "node": pa.array(names, pa.binary()),
            "root": pa.array([names[k] for k in _roots(hit)], pa.binary()),
            "links": pa.array((hit @ table.column("n_docs").to_numpy().astype(np.float64)).astype(np.int64)),
        })

    return pairs.groupBy("unit", "band", "i", "j").applyInArrow(judge, "node binary, root binary, links long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, text_key, class_id, n_links and class_size.

    n_links counts the other documents whose n-gram sets have a Jaccard similarity of threshold or
    more with the document's own, copies included; class_id is the smallest id of the component of
    links (null if it has none). Texts of fewer than five words have one gram; texts without words,
    null ones among them, link to nothing and are classes of their own. Repeated rows count as
    copies. An empty table gives an empty one.
    """
    bands, rows = bands_for(threshold, recall)
    rows_of = durable(signatures(docs, id_col, text, bands, rows), "signatures")
    full = rows_of.where("n_grams > 0")
    rep = F.struct(F.col("doc_id").isNull().alias("lacks"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    nodes = durable(full.groupBy("node").agg(F.count("*").alias("n_docs"), F.min(rep).alias("rep"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "nodes")
    dealt = durable(units(nodes), "dealt")
    bands_met = F.when(F.exists("places", lambda p: p["band"] >= 0), F.col("bands"))  # few nodes are in another unit than their home
    members = nodes.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"), "n_docs", "bands").join(dealt, "node").withColumn("bands", bands_met)
    judged = durable(verify(docs, durable(members, "members"), id_col, text, threshold), "judged")
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(judged.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    info = nodes.select("node", "n_docs", "rep").join(links, "node", "left").join(classes, "node", "left")
    info = info.where("n_docs > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    of_class = info.groupBy("root").agg(F.min("rep.id").alias("class_id"), F.min("rep").alias("best"), F.sum("n_docs").alias("class_size"))
    info = info.join(apart(of_class, "root"), "root").select("node", "class_id", "best", "class_size", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    joined = rows_of.select("doc_id", "text_key", "n_grams", "node").join(info, "node", "left")
    lone = (F.col("n_grams") == 0) | F.col("links").isNull()
    return joined.select(
        "doc_id",
        "text_key",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(lone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (lone | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.key")))).alias("stays"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one of smallest id; columns as they were.

    If the row that stays repeats exactly, its repetitions stay too (drop exact copies first).
    """
    lost = jaccard_classes(docs, id_col, text, threshold).where("NOT stays").select(F.col("doc_id").alias("__hl_id"), F.col("text_key").alias("__hl_key")).distinct()
    hit = (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hl_key")) & F.col(id_col).eqNullSafe(F.col("__hl_id"))
    return join_checked(docs, durable(lost, "near-copies"), hit, "left_anti")
