"""Language identification by compression.

Each language has a raw-content zstandard dictionary: the letters of a bounded sample of its labelled
texts, each taken whole. A text is cut into chunks, every chunk is compressed against each
dictionary, and the language with the smallest total wins. Chunks are short, so that a long text's own
history doesn't drown what the dictionary tells.

A letter is a character of Unicode category L. Numbers of any kind (`½`, `Ⅷ`, `①`, `²`) aren't letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixlake.llm.arrow import map_batches

#: Bounds of the fit: rows sampled per language, and how long a row's text may be to be drawn. Texts that are drawn
#: are used whole; a language without a text so short is learned from its shortest one. Dictionaries beyond 128 KB are several times slower.
SAMPLE_DOCS, SAMPLE_CHARS = 80, 1_500
CHUNK = 4096
LEVEL = 6
#: A margin (1 - smallest / second smallest size) below this is a rejection.
MARGIN = 0.005
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numbers that aren't decimal digits: word characters to `re`, but not letters. Few texts have any.
_NUMBERS = {c: " " for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
_TO_SPACES = str.maketrans(_NUMBERS)
SCHEMA = "lang_pred string, score double, rejected boolean"


def letters(text: str | None) -> str:
    """Lower-cased runs of letters with single spaces between; empty if there is no letter."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not plain.isascii() and not _NUMBERS.keys().isdisjoint(plain):
        plain = " ".join(plain.translate(_TO_SPACES).split())
    return plain.strip()


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionary of each language from rows that aren't held out and have text and label, the most
    frequent language first, by name among equals.

    The fit is bounded by SAMPLE_DOCS rows per language, picked by a hash of id and text among those of at
    most SAMPLE_CHARS characters, so the driver holds about a quarter of a megabyte a language; there is no limit to
    languages. Languages without a letter in their sample are left out; no labelled rows give no languages.
    """
    rows = docs.where(~held_out(id_col) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.length(text).alias("c"), F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(3)), F.lit(1_000_000)).alias("h"))
    share = rows.groupBy("l").agg(F.count("*").alias("n"), F.sum((F.col("c") <= SAMPLE_CHARS).cast("long")).alias("short"), F.min("c").alias("least")).collect()
    if not share:
        return {}
    bounds = docs.sparkSession.createDataFrame([(r["l"], 1_300_000 * SAMPLE_DOCS / r["short"] if r["short"] else 1e6, max(SAMPLE_CHARS, r["least"])) for r in share], "l string, below double, most int")
    drawn = rows.join(F.broadcast(bounds), "l").where("h < below AND c <= most").select("l", "h", "t").distinct()  # rows that repeat share a hash
    found: dict[str, list[tuple]] = {}
    for r in drawn.collect():
        found.setdefault(r["l"], []).append((r["h"], r["t"]))
    weight = {r["l"]: r["n"] for r in share}
    out = {}
    for name, texts in sorted(found.items(), key=lambda x: (-weight[x[0]], x[0])):
        body = " ".join(filter(None, (letters(t) for _, t in sorted(texts)[:SAMPLE_DOCS])))
        if body:
            out[name] = body.encode("utf-8", "surrogatepass")
    return out


class Classifier:
    """The dictionaries of all languages, ready to compress with."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names, self.coders = list(dictionaries), []
        for body in dictionaries.values():
            entry = z.ZstdCompressionDict(body, dict_type=z.DICT_TYPE_RAWCONTENT)
            entry.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=entry, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin in 0..1, and whether the margin is too narrow (or there is no letter)."""
        plain = letters(text)
        if not plain or not self.names:
            return UNKNOWN, 0.0, True
        chunks = [plain[k : k + CHUNK].encode("utf-8", "surrogatepass") for k in range(0, len(plain), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.names[0], 1.0, False
        score = 1 - sizes[order[0]] / sizes[order[1]]
        return self.names[order[0]], score, score < MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; the three replace columns of the same name.

    lang_pred is a learned language even where the margin is narrow, and `und` where the text is
    null or has no letter (or nothing was learned); those are rejected with score 0. Ties go to the
    language with more labelled rows (the first by name, if equal) and are rejected. Texts are judged
    whole, however long; repeated rows are judged each; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    schema = StructType([docs.schema[c] for c in kept] + StructType.fromDDL(SCHEMA).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            new = [pa.array([f[k] for f in found], type=t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return map_batches(docs.select(*kept, F.col(text).alias("__hl_text")), run, schema)


def language_of(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred, score and rejected for each row, trained on the rows themselves."""
    model = train(docs, text, lang, id_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("__hl_whole"))
    return classify(rows, model, "__hl_whole").drop("__hl_whole")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that are rejected; columns as they were, whatever their names. Null and empty
    texts and those without a letter are rejected; rows that repeat are judged each."""
    model = train(docs, text, lang, id_col)
    packed = docs.select(F.struct(*docs.columns).alias("__hl_row"), F.col(text).alias("__hl_whole"))
    return classify(packed, model, "__hl_whole").where("NOT rejected").select("__hl_row.*")
