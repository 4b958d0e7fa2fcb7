"""Secret scan with a random forest that removes false positives.

Rules propose findings: provider formats, assignments to secret-like names, and any long token
with a digit. A finding is looked at from two sides that share nothing.

* Evidence: the provider's format or the secret-like name it is assigned to speak for a secret; a digest's or
  version's name, a URL around it, a UUID, a plain number, or the same value among ever other words speak against.
  Many findings have neither.
* Features: the value's length, its character transitions against those of the whole corpus, how much of it words of
  the corpus cover, the path of its document, and the words around, without the name, URL or format that is evidence.

The forest learns the evidence from the features, on a bounded sample of labelled findings, so it can tell what
evidence is silent on and contradict it. Its probability is the score; the verdict weighs score and evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable, join_checked
from helixlake.llm.arrow import map_batches
from helixlake.llm.words import lowered, raw_words

#: Bounds of the fit: labelled findings drawn, and the share of values held out from it. A word of the dictionary has at
#: least this share of the corpus's words; a value in so many different surroundings is public.
SAMPLE, HOLD_OUT, WORD_SHARE, PUBLIC = 5_000, 5, 1e-6, 3
#: A score so near a half says nothing.
UNSURE = 0.2
TREES, DEPTH, SEED, NEAR = 40, 6, 7, 16
#: Provider formats: fixed values.
PROVIDERS = {
    "aws": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "google": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
}
NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key"
# Runs have no upper length and are possessive, so that a token is found whole and in time linear in the text.
_ASSIGNED = re.compile(rf"(?i)(?:{NAMES})['\"]?\s{{0,3}}(?:=|:|:=|=>)\s{{0,3}}['\"]?([^\s'\",;]{{8,}}+)")
_LONG = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+")
_DIGIT = re.compile("[0-9]")
#: A text without any of these holds no such secret.
MARKS = {"aws": ("AKIA", "ASIA"), "github": ("gh",), "slack": ("xox",), "google": ("AIza",), "jwt": ("eyJ",), "pem": ("-----BEGIN",)}
_PROVIDERS = [(k, re.compile(p)) for k, p in PROVIDERS.items()]
_NAMED = re.compile(rf"(?i)[\w.-]*(?:{NAMES})[\w-]*['\"]?\s{{0,3}}(?:=|:|:=|=>)?\s{{0,3}}['\"]?$")
_DIGEST = re.compile(r"(?i)(?<![a-z])(?:sha-?\d*|md5|commit|checksum|digest|hash|etag|rev|revision|uuid|guid|isbn|version|build|crc\d*)(?:\s+of)?['\"]?\s{0,3}(?:=|:|:=|=>)?\s{0,3}['\"]?$")
_URL = re.compile(r"\S*://\S*$")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_TEST_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|doc")
_CONFIG_PATH = re.compile(r"(?i)\.(?:env|ini|cfg|conf|ya?ml|toml|json|properties)$|config|secret|deploy")
_LETTERS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]{3,}")
FEATURES = ("length", "transition", "worst", "coverage", "digits", "upper", "entropy", "test_path", "config_path", *(f"near{k}" for k in range(NEAR)))
SCHEMA = "start int, end int, kind string, value string, vkey binary, path string, near array<string>, evidence double, around long, pairs array<long>"
#: Codes of bytes in letter pairs: a-z in either case, then digits; 36 is anything else.
_CODE = np.full(256, 36, dtype=np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _k


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of findings, the most specific kind for overlapping ones, by start."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _PROVIDERS:
        if any(mark in text for mark in MARKS[kind]):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    taken = sorted(found)
    assigned = _ASSIGNED.finditer(text) if "=" in text or ":" in text else ()
    long = _LONG.finditer(text) if _DIGIT.search(text) else ()
    for kind, spans in (("assigned", (m.span(1) for m in assigned)), ("long", (m.span() for m in long))):
        new, k = [], 0
        for a, b in spans:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or b <= taken[k][0]:
                new.append((a, b, kind))
        found += new
        taken = sorted(found)
    return taken


def context(text: str, start: int, end: int, kind: str) -> tuple[list[str], float | None]:
    """The words around a finding beyond its evidence, and the evidence: 1, 0 or None."""
    value, before, after = text[start:end], text[max(0, start - 160) : start], text[end : end + 40]
    evidence = None
    if kind in PROVIDERS:
        evidence = 1.0
    elif m := _NAMED.search(before):
        before = before[: m.start()]
        evidence = 1.0 if kind == "assigned" else None
    elif m := _DIGEST.search(before):
        before, evidence = before[: m.start()], 0.0
    elif m := _URL.search(before):
        before, evidence = before[: m.start()], 0.0
    if evidence is None and kind == "long" and (value.isdigit() or _UUID.fullmatch(value) or "://" in value):
        evidence = 0.0
    near = [f"b{k}:{w.lower()}" for k, w in enumerate(reversed(_LETTERS.findall(before[-60:])[-3:]))]
    return near + [f"a{k}:{w.lower()}" for k, w in enumerate(_LETTERS.findall(after)[:2])], evidence


def pair_counts(text: str) -> np.ndarray:
    """Counts of the 36 * 36 pairs of letters and digits in a text, and the number of its words of a-z."""
    code = _CODE[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    a, b = code[:-1], code[1:]
    both = (a < 36) & (b < 36)
    letter = code < 26
    words = int(letter[:1].sum()) + int((letter[1:] & ~letter[:-1]).sum())
    return np.append(np.bincount(a[both] * 36 + b[both], minlength=1296), words)


class Transitions:
    """Log probabilities of letter pairs, from their counts; one that never occurs counts half."""

    def __init__(self, counts: np.ndarray):
        self.log = np.log((np.asarray(counts, dtype=np.float64) + 0.5) / (np.sum(counts) + 648))
        self.floor = float(np.log(0.5 / (np.sum(counts) + 648)))

    def of(self, value: str) -> tuple[float, float]:
        """Mean over a value's pairs, and the worst eighth's mean."""
        code = _CODE[np.frombuffer(value.encode("utf-8", "replace"), dtype=np.uint8)]
        a, b = code[:-1], code[1:]
        odds = np.where((a < 36) & (b < 36), self.log[np.minimum(a * 36 + b, 1295)], self.floor)
        return (float(odds.mean()), float(np.sort(odds)[: max(1, len(odds) // 8)].mean())) if len(odds) else (self.floor, self.floor)


def substrings(value: str) -> set[str]:
    """The dictionary words that a value could hold: 3 to 12 letters a-z, lower-cased."""
    return {run[a : a + n] for run in (r.lower() for r in _RUN.findall(value)) for n in range(3, 13) for a in range(len(run) - n + 1)}


def coverage(value: str, words: set[str]) -> float:
    """Share of characters that words cover, found greedily from the left, the longest first."""
    low, k, hit = value.lower(), 0, 0
    while k < len(low):
        n = next((n for n in range(min(12, len(low) - k), 2, -1) if low[k : k + n] in words), 0)
        hit, k = hit + n, k + max(1, n)
    return hit / max(1, len(low))


def features(value: str, path: str | None, near: list[str], words: set[str], transitions: Transitions) -> list[float]:
    import xxhash

    n, counts = max(1, len(value)), {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    beside = [0.0] * NEAR
    for word in near:
        beside[xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % NEAR] += 1
    where = path or ""
    return [
        float(len(value)), *transitions.of(value), coverage(value, words), sum(map(str.isdigit, value)) / n, sum(map(str.isupper, value)) / n, entropy,
        float(bool(_TEST_PATH.search(where))), float(bool(_CONFIG_PATH.search(where))), *beside,
    ]


def findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id and SCHEMA of every finding in whole texts (vkey is a 128-bit hash of the value), and for each task a row
    with its pair_counts alone."""
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        pairs, kind_of = np.zeros(1297, dtype=np.int64), None
        types = [None, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [kind_of, *types[1:]], strict=True)], names=names)
        for batch in batches:
            out, kind_of = [], batch.schema.field(0).type
            for doc, value, where in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = value.as_py() or ""
                pairs += pair_counts(whole)
                for a, b, kind in find(whole):
                    near, evidence = context(whole, a, b, kind)
                    around = xxhash.xxh64_intdigest(f"{whole[max(0, a - 20) : a]}|{whole[b : b + 20]}".encode("utf-8", "surrogatepass")) >> 1
                    out.append((doc, a, b, kind, whole[a:b], xxhash.xxh3_128_digest(whole[a:b].encode("utf-8", "surrogatepass")), where, near, evidence, around, None))
            if out:
                yield rows(out)
        if kind_of is not None:
            yield rows([(None,) * 10 + (pairs.tolist(),)])

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), where.alias("path")), run, f"doc_id {kind_of_id}, {SCHEMA}")


def dictionary_hits(docs: DataFrame, found: DataFrame, n_words: int, text: str = "text") -> DataFrame:
    """vkey and words: the dictionary words that each distinct value holds. Words of the corpus are counted before they
    meet those that some value could hold, so no row is made for each occurrence of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vkey, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if subs := sorted(substrings(value)):
                    yield pa.RecordBatch.from_arrays([pa.array([vkey] * len(subs), pa.binary()), pa.array(subs)], names=["vkey", "word"])

    distinct = found.groupBy("vkey").agg(F.first("value").alias("value"))
    spread = durable(map_batches(distinct, run, "vkey binary, word string"), "substrings")
    wanted = durable(spread.select("word").distinct(), "wanted-words")
    every = docs.select(F.explode_outer(raw_words(text)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))  # each spelling is lower-cased once
    counts = every.where(F.col("w").rlike("^[A-Za-z]{3,12}$")).groupBy(lowered("w").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, WORD_SHARE * n_words))
    known = durable(counts.select("word").join(wanted, "word"), "dictionary")  # an inner join: a semi-join would be moved below the counting
    return join_checked(spread, known, "word", "left_semi").groupBy("vkey").agg(F.array_sort(F.collect_set("word")).alias("words"))


def described(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, start, end, kind, value, label (the evidence, 0 also for public values; null if there is none) and feats of every finding."""
    rows = durable(findings(docs, id_col, text, path), "findings")
    found = rows.where("kind IS NOT NULL")
    sums = rows.where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(1297)
    for r in sums.collect():  # 1297 rows at most
        counts[r["k"]] = r["n"]
    transitions = Transitions(counts[:1296])
    surroundings = found.groupBy("vkey").agg(F.count_distinct("around").alias("seen")).where(F.col("seen") >= PUBLIC)
    hits = dictionary_hits(docs, found, int(counts[1296]), text)
    known = durable(hits.join(surroundings, "vkey", "full"), "values")
    joined = found.join(apart(known, "vkey"), "vkey", "left")
    label = F.when(F.col("seen").isNotNull() & (F.col("kind") == "long"), F.lit(0.0)).otherwise(F.col("evidence"))
    kept = ["doc_id", "start", "end", "kind", "value", "label"]
    joined = joined.select(*[label.alias("label") if c == "label" else F.col(c) for c in kept], "path", "near", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, path, near, words = (batch.column(k).to_pylist() for k in (4, 6, 7, 8))
            feats = [features(v, p, n or [], set(w or ()), transitions) for v, p, n, w in zip(value, path, near, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(feats, pa.list_(pa.float64()))], names=[*kept, "feats"])

    kind_of_id = found.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, run, f"doc_id {kind_of_id}, start int, end int, kind string, value string, label double, feats array<double>")


def held_out():
    """Whether a finding's value is kept from the fit, with all its repetitions."""
    return F.pmod(F.xxhash64("value", F.lit(5)), F.lit(HOLD_OUT)) == 0


def fitted(labelled: DataFrame) -> RandomForestClassificationModel:
    """The forest of labelled findings (label, feats)."""
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", probabilityCol="p", rawPredictionCol="raw", predictionCol="guess", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(labelled.select("label", array_to_vector("feats").alias("x")))


def scored(found: DataFrame) -> DataFrame:
    """found with held_out, score (the forest's probability of a secret) and secret.

    The forest learns from at most SAMPLE labelled findings that aren't held out, picked by hash in a single order,
    so it is the same whatever the partitioning. secret says that the score is at least a half: the forest may remove
    a finding that its rule labels a secret. Only where it can't tell, within UNSURE of a half, does a label decide: what
    gives the label isn't among the features, so equal values in equal surroundings may have either. Without both labels
    nothing is learned: the score is the label, 0 where there is none.
    """
    order = F.xxhash64("value", "doc_id", "start", "kind")
    found = found.withColumn("held_out", held_out())
    labelled = found.where("label IS NOT NULL AND NOT held_out").select("label", "feats", order.alias("h"), "doc_id", "start").orderBy("h", "doc_id", "start").limit(SAMPLE)
    labelled = durable(labelled.coalesce(1), "labelled")
    if labelled.select("label").distinct().count() < 2:
        score = F.coalesce("label", F.lit(0.0))
        return found.withColumn("score", score).withColumn("secret", score >= 0.5)
    out = fitted(labelled).transform(found.withColumn("x", array_to_vector("feats")))
    out = out.withColumn("score", F.element_at(vector_to_array("p"), 2))
    unsure = F.abs(F.col("score") - 0.5) <= UNSURE
    return out.drop("x", "p", "raw", "guess").withColumn("secret", F.when(unsure & F.col("label").isNotNull(), F.col("label") == 1).otherwise(F.col("score") >= 0.5))


def quality(rows: DataFrame) -> tuple[float, float]:
    """(precision, recall) of the forest alone on labelled findings that it hasn't seen; 1 where there is nothing to miss."""
    yes, right = F.col("score") >= 0.5, F.col("label") == 1
    count = lambda c: F.sum(c.cast("long"))
    r = rows.where("held_out AND label IS NOT NULL").agg(count(yes & right).alias("hit"), count(yes).alias("said"), count(right).alias("there")).first()
    return (r["hit"] / r["said"] if r["said"] else 1.0, r["hit"] / r["there"] if r["there"] else 1.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, start, end, kind, value, label, held_out, score and secret of every finding.

    Null and empty texts have none; a null path is an empty one. Texts are searched whole and tokens found whole,
    however long. Of overlapping findings the more specific kind stays, then the first. Rows that repeat have
    theirs each. Columns beyond id, text and path are ignored; an empty table gives an empty one.
    """
    return scored(durable(described(docs, id_col, text, path), "described")).drop("feats")
