"""Hard-negative mining by a pivot table.

Vectors get one more component, which makes all of them equally long: the larger an inner product, the smaller the Euclidean distance. Every
row stores its distances from a few pivots. By the triangle inequality they bracket its distance from an anchor, so its score: rows
whose bracket misses what is looked for are left out, block by block and row by row, and the survivors' scores are computed exactly.

Scores are integers. The bracket is widened by more than its rounding, so results are exact; pivots and blocks change only the work.

The pivots come from a bounded sample (`sample` rows). Anchors meet all rows in parts of `chunk` anchors, which alone are broadcast; no pair of
vectors is ever a row but the few best of a task. Rows with a null vec_id, label or vector or with a component that is null or not finite take no
part. Vectors that are shorter than others count as followed by zeros. Rows that repeat count each, but no row counts for an anchor of the same vec_id.
An empty table gives no rows. Further columns are ignored. Raises if a vector is so long that scores leave the exact integers of a double.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable
from helixlake.llm.arrow import map_batches
from helixlake.llm.vectors import Best, bounded_sample, chunks, finite, first_of, matrix

#: Pivots, rows they are chosen from, anchors held against all rows at once.
PIVOTS, SAMPLE, CHUNK = 16, 2_048, 2_048
LONGEST = 1 << 52


def whole_numbers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x (components times scale, rounded down) and n2 (its squared length) of the rows that take part."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    square = F.aggregate(F.col("x"), F.lit(0.0), lambda n, v: n + v.cast("double") * v.cast("double"))
    return kept.select("vec_id", "label", x.alias("x")).withColumn("n2", square)


def spread_pivots(x: np.ndarray, longest: float, pivots: int) -> np.ndarray:
    """Pivots in the longer space, each the row farthest from those before it."""
    rows = longer(x, longest)
    if not len(rows):
        return rows
    found, away = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(found) < min(pivots, len(rows)) and away.max() > 0:
        found.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[found[-1]]) ** 2).sum(axis=1))
    return rows[found]


def longer(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that makes their squared length `longest`. Anchors get 0 instead, so that their inner products stay."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def pivot_table(rows: DataFrame, pivots: np.ndarray, longest: float, width: int) -> DataFrame:
    """rows (vec_id, label, x) with d, their distances from the pivots, in rings: by nearest pivot, then distance from it."""

    def run(batches):
        for b in batches:
            d = distances(longer(matrix(b.column("x"), width), longest), pivots)
            near = d.argmin(axis=1)
            away = d[np.arange(len(d)), near]
            d = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), d, pa.array(near.astype(np.int32)), pa.array(away)], ["vec_id", "label", "x", "d", "near", "away"])

    table = map_batches(rows.select("vec_id", "label", "x"), run, "vec_id long, label long, x array<bigint>, d array<double>, near int, away double")
    return durable(table.repartitionByRange("near", "away", "vec_id").sortWithinPartitions("near", "away"), "pivots").select("vec_id", "label", "x", "d")


def search(table: DataFrame, shared, same: bool, k: int, width: int, longest: float) -> DataFrame:
    """no, key, vec_id, score: each task's k best rows for each anchor and window of scores.

    shared holds the anchors' no, vec_id, label, x, d and windows (least, most, key); same: whether rows of the anchor's label are looked for, or the others."""
    slack = 1.0 + 1e-9 * longest

    def run(batches):
        a = shared.value
        best = [[Best(k, np.int64) for _ in w] for w in a["windows"]]
        a2 = (a["x"] ** 2).sum(axis=1)
        for b in batches:
            x, d = matrix(b.column("x"), width), matrix(b.column("d"), a["d"].shape[1])
            ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            if not len(ids):
                continue
            low_d, high_d = d.min(axis=0), d.max(axis=0)
            for i in range(len(a["no"])):
                # the block's bracket first
                gap = np.maximum(np.maximum(low_d - a["d"][i], a["d"][i] - high_d), 0).max()
                most = (a2[i] + longest - gap * gap) / 2 + slack
                floors = [max(lo, t.scores[-1]) if t.full else lo for (lo, *_), t in zip(a["windows"][i], best[i], strict=True)]
                if all(f > most for f in floors):
                    continue
                near, far = np.abs(d - a["d"][i]).max(axis=1), (d + a["d"][i]).min(axis=1)
                high, low = (a2[i] + longest - near * near) / 2 + slack, (a2[i] + longest - far * far) / 2 - slack
                fit = ((labels == a["label"][i]) == same) & (ids != a["vec_id"][i])
                wanted = np.zeros(len(ids), dtype=bool)
                for w, (_, hi, _) in enumerate(a["windows"][i]):
                    sure = low[fit & (high <= hi) & (low >= floors[w])]
                    if len(sure) >= k:
                        floors[w] = max(floors[w], np.partition(sure, -k)[-k])
                    wanted |= fit & (high >= floors[w]) & (low <= hi)
                at = np.flatnonzero(wanted)
                exact = (x[at] @ a["x"][i]).astype(np.int64)
                for w, (lo, hi, _) in enumerate(a["windows"][i]):
                    hit = (exact >= lo) & (exact <= hi)
                    best[i][w].add(exact[hit], ids[at[hit]])
        found = [(a["no"][i], a["windows"][i][w][2], t) for i, tops in enumerate(best) for w, t in enumerate(tops) if len(t.ids)]
        if found:
            n = [len(t.ids) for *_, t in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], n), pa.int64()), pa.array(np.repeat([f[1] for f in found], n), pa.int64()), pa.array(np.concatenate([t.ids for *_, t in found])), pa.array(np.concatenate([t.scores for *_, t in found]))], ["no", "key", "vec_id", "score"])

    return map_batches(table, run, "no long, key long, vec_id long, score long")


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which the column `anchors` holds. Their positives are the best rows of the same label; for each, the best rows of other labels whose score is from
    `least` to `most` percent of the positive's are its negatives. Higher scores come first, ties by smaller vec_id."""
    spark = rows.sparkSession
    kept = durable(whole_numbers(rows, scale), "whole")
    size = kept.agg(F.max("n2").alias("n2"), F.max(F.size("x")).alias("w")).first()
    longest, width = float(size["n2"] or 0), max(size["w"] or 0, 1)
    if longest >= LONGEST:
        raise ValueError(f"squared lengths must stay below {LONGEST}; the largest is {longest:.6g}")
    found = [r["x"] + [0] * (width - len(r["x"])) for r in bounded_sample(kept, sample).select("x").collect()]
    points = spread_pivots(np.array(found, dtype=np.float64).reshape(-1, width), longest, pivots)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not len(points):
        return spark.createDataFrame([], schema)
    table, out = pivot_table(kept, points, longest, width), []
    for part in chunks(kept.where(anchors), chunk):
        a = part.select("no", "vec_id", "label", "x").toArrow().combine_chunks()
        x = matrix(a.column("x").combine_chunks(), width) if len(a) else np.zeros((0, width))
        held = {n: a.column(n).to_numpy() for n in ("no", "vec_id", "label")} | {"x": x, "d": distances(np.hstack([x, np.zeros((len(x), 1))]), points)}
        whole = spark.sparkContext.broadcast(held | {"windows": [[(-LONGEST, LONGEST, 0)]] * len(a)})
        mates = durable(first_of(search(table, whole, True, positives, width, longest), positives, ["no"], "vec_id").select("no", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        windows = {n: set() for n in held["no"].tolist()}
        for r in mates.select("no", "positive_score").distinct().collect():
            score = r["positive_score"]
            windows[r["no"]].add((-(-least * score // 100), most * score // 100, score))
        narrow = spark.sparkContext.broadcast(held | {"windows": [sorted(w for w in windows[n] if w[0] <= w[1]) for n in held["no"].tolist()]})
        ranked = first_of(search(table, narrow, False, negatives, width, longest), negatives, ["no", "key"], "vec_id").select("no", F.col("key").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        met = mates.join(ranked, ["no", "positive_score"])
        names = part.select("no", F.col("vec_id").alias("anchor_id"))
        out.append(durable(met.join(names, "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
