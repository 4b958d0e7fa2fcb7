"""Benchmark decontamination over a positional inverted index of the training texts.

1. Count how often each test term occurs in the corpus.
2. In every test window (n consecutive words of an item) the two rarest terms are its anchors; a
   window with a term that the corpus lacks can't occur and has none.
3. The index stores the postings of anchor terms: term, document and position, and for terms that are
   some window's rarest the words around.
4. Posting lists are adjusted by the anchor's offset in the item, so that the postings of one
   occurrence meet at the same (document, item, shift). The rarest terms' lists are intersected with
   the second rarest's there, and a pair survives if it anchors one window.
5. The words stored around the rarest term settle which windows match exactly.
6. Where both anchors of a window occur a few words nearer or farther than in the item, it is a proximity match.

Only DataFrame functions run here. Common words never enter the index unless a window has nothing
rarer. Nothing is collected; test-side tables are broadcast only within a counted bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable, fits, join_checked
from helixlake.llm.words import case_key, lowered, raw_words, words

WINDOW, SLACK = 10, 5
KEY = ["doc_id", "text_key"]
#: Stands behind the last word of each document in the index, so that its position is their number. No word has this character.
END = "\x00"
AT = [*KEY, "item_key", "shift"]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_key, item_id, item_words and need (the length of its windows) of items that have a word.

    Items of fewer words than a window are one window. Null texts have none and are left out;
    repeated rows are one item."""
    found = benchmark.select(F.col(id_col).alias("item_id"), words(text).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return found.select(F.xxhash64(F.col("item_id").cast("string"), "item_words").alias("item_key"), "item_id", "item_words", F.least(F.lit(window), F.size("item_words")).alias("need"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key and the words of each row; id and text hash tell rows apart, since ids may repeat or be null."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), raw_words(text).alias("doc_words"))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """term and n: corpus frequency of every test term, 0 included; spellings in other case are counted too.

    explode_outer, since explode makes Spark split every text a second time to filter out empty arrays."""
    terms = durable(items.select(F.explode("item_words").alias("term")).distinct().select("term", case_key("term").alias("term_key")), "test-terms")
    spread = docs.select(F.explode_outer("doc_words").alias("w")).select(case_key("w").alias("term_key"))
    found = join_checked(spread, terms.select("term_key").distinct(), "term_key", "inner").groupBy("term_key").agg(F.count("*").alias("n"))
    return terms.join(found, "term_key", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(items: DataFrame, counts: DataFrame) -> DataFrame:
    """items with windows: for each window that can occur, the positions of its two rarest terms, rarest
    first (one, if the window is one word). Items without such windows are gone."""
    spread = items.select("item_key", F.posexplode("item_words").alias("pos", "term"))
    terms = spread.join(counts, "term").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("by_pos"))
    rows = items.join(terms, "item_key")

    def window(start: Column) -> Column:
        return F.slice(F.array_sort(F.transform(F.slice("by_pos", start + 1, F.col("need")), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos")))), 1, 2)

    starts = F.sequence(F.lit(0), F.size("item_words") - F.col("need"))
    able = F.filter(F.transform(starts, window), lambda w: w[0]["n"] > 0)
    return rows.select("item_key", "item_id", "item_words", "need", F.transform(able, lambda w: F.transform(w, lambda x: x["pos"])).alias("windows")).where(F.size("windows") > 0)


def anchor_pairs(items: DataFrame) -> DataFrame:
    """item_key, first, second, with the terms at both: the distinct anchors of an item's windows; second is
    null where a window is one word."""
    spread = items.select("item_key", "item_words", F.explode(F.array_distinct("windows")).alias("w"))
    rows = spread.select("item_key", "item_words", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(1)).alias("second"))
    return rows.select("item_key", "first", "second", F.get("item_words", F.col("first")).alias("first_term"), F.get("item_words", F.col("second")).alias("second_term"))


def build_index(docs: DataFrame, pairs: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """Stored postings of anchor terms: term, KEY, pos, before (how many of the words around precede it) and
    around, both null where the term is no window's rarest. END has a posting in each document.

    Terms too many to broadcast meet the words by shuffle, which then carries positions alone; the words around
    are cut afterwards, from each document's one row."""
    rarest = pairs.select(F.col("first_term").alias("term"), F.lit(True).alias("rarest"))
    others = pairs.where("second_term IS NOT NULL").select(F.col("second_term").alias("term"), F.lit(False).alias("rarest"))
    others = others.union(docs.sparkSession.createDataFrame([(END, False)], others.schema))
    terms = durable(rarest.union(others).groupBy("term").agg(F.max("rarest").alias("rarest")).withColumn("term_key", case_key("term")), "anchor-terms")
    docs = docs.withColumn("doc_words", F.concat("doc_words", F.array(F.lit(END))))
    before = F.least(F.col("pos"), F.lit(reach))
    around = F.slice("doc_words", F.col("pos") - before + 1, before + 1 + reach)  # lower-cased later: a lambda here would write out doc_words for every posting
    posting = ["term", *KEY, "pos", F.when(F.col("rarest"), before).alias("before"), F.when(F.col("rarest"), around).alias("around")]
    if fits(terms):
        spread = docs.select(*KEY, "doc_words", F.posexplode_outer("doc_words").alias("pos", "w")).withColumn("term_key", case_key("w"))
        return durable(spread.join(F.broadcast(terms), "term_key").where(lowered("w") == F.col("term")).select(*posting), "postings")
    spread = docs.select(*KEY, F.posexplode_outer("doc_words").alias("pos", "w")).withColumn("term_key", case_key("w"))
    found = durable(spread.join(terms, "term_key").where(lowered("w") == F.col("term")).select("term", *KEY, "pos", "rarest"), "positions")
    spots = found.where("rarest").groupBy(*KEY).agg(F.collect_list(F.struct("term", "pos", "rarest")).alias("spots")).withColumnsRenamed({k: f"at_{k}" for k in KEY})
    same = (F.col("text_key") == F.col("at_text_key")) & F.col("doc_id").eqNullSafe(F.col("at_doc_id"))
    cut = docs.dropDuplicates(KEY).join(spots, same).select(*KEY, "doc_words", F.explode("spots").alias("x")).select(*KEY, "doc_words", "x.*")
    return durable(cut.select(*posting).unionByName(found.where("NOT rarest").select("term", *KEY, "pos", F.lit(None).cast("int").alias("before"), F.lit(None).cast("array<string>").alias("around"))), "postings")


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lists of the rarest terms, adjusted and intersected with those of the second rarest: AT, and found (the
    rarest anchors there, with the words around)."""
    first = durable(pairs.select(F.col("first_term").alias("term"), "item_key", "first").distinct(), "first-anchors")
    second = durable(pairs.where("second IS NOT NULL").select(F.col("second_term").alias("term"), "item_key", "second").distinct(), "second-anchors")
    both = durable(pairs.select("item_key", "first", "second"), "anchor-pairs")
    a = join_checked(index.where("around IS NOT NULL"), first, "term", "inner").select(*KEY, "item_key", (F.col("pos") - F.col("first")).alias("shift"), "first", "before", "around")
    b = join_checked(index.select("term", *KEY, "pos"), second, "term", "inner").select(*KEY, "item_key", (F.col("pos") - F.col("second")).alias("shift"), "second")
    renamed = b.withColumnsRenamed({c: f"b_{c}" for c in AT})
    same = F.col("doc_id").eqNullSafe(F.col("b_doc_id"))
    for c in AT[1:]:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    met = a.join(renamed, same).select(*AT, "first", "second", "before", "around")
    met = join_checked(met, both, ["item_key", "first", "second"], "left_semi").drop("second")
    alone = join_checked(a, durable(both.where("second IS NULL").select("item_key", "first"), "lone-anchors"), ["item_key", "first"], "left_semi").select(*AT, "first", "before", "around")
    return met.unionByName(alone).groupBy(*AT).agg(F.collect_set(F.struct("first", "before", "around")).alias("found"))


def phrase_hits(met: DataFrame, items: DataFrame) -> DataFrame:
    """KEY, item_id and hit: the document positions of exact window occurrences on an alignment."""
    rows = join_checked(met, items.select("item_key", "item_id", "item_words", "need"), "item_key", "inner")
    first = lambda x: x["first"] - x["before"]  # noqa: E731  item position of the first word around
    agree = lambda x: F.transform(x["around"], lambda word, k: F.when(F.get("item_words", first(x) + k) == lowered(word), first(x) + k))
    near = F.transform("found", lambda x: F.filter(agree(x), lambda p: p.isNotNull()))
    exact = rows.select(*KEY, "item_id", "shift", "need", F.size("item_words").alias("n"), F.array_distinct(F.flatten(near)).alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("need")), lambda s: F.size(F.array_intersect(F.sequence(s, s + F.col("need") - 1), F.col("same"))) == F.col("need"))
    hit = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("need") - 1))))
    return exact.select(*KEY, "item_id", F.transform(hit, lambda p: p + F.col("shift")).alias("hit")).where(F.size("hit") > 0)


def proximity_hits(index: DataFrame, pairs: DataFrame, items: DataFrame, slack: int = SLACK) -> DataFrame:
    """KEY and item_id where both anchors of a window occur with shifts at most `slack` apart: a passage
    with words put in, left out or moved a little. Exact occurrences are among them.

    Shifts meet by cells of slack + 1: those of the second anchor in their own, those of the first in the cells beside, too."""
    cell = F.floor(F.col("shift") / (slack + 1))
    terms = ["item_key", "first", "second", "first_term", "second_term"]
    both = durable(pairs.select(*terms).distinct(), "anchor-terms-of-items")
    narrow = index.select("term", *KEY, "pos")
    at_first = both.select(F.col("first_term").alias("term"), "item_key", "first", "second")
    at_second = both.where("second IS NOT NULL").select(F.col("second_term").alias("term"), "item_key", "first", "second")
    a = join_checked(narrow, at_first, "term", "inner").select(*KEY, "item_key", "first", "second", (F.col("pos") - F.col("first")).alias("shift"))
    lone = a.where("second IS NULL").select(*KEY, "item_key")
    a = a.where("second IS NOT NULL").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).withColumnRenamed("shift", "shift_a")
    b = join_checked(narrow, at_second, "term", "inner").select(*KEY, "item_key", "first", "second", (F.col("pos") - F.col("second")).alias("shift"))
    b = b.withColumn("cell", cell).withColumnsRenamed({"shift": "shift_b", "doc_id": "b_doc_id"})
    near = a.join(b, ["text_key", "item_key", "first", "second", "cell"]).where(F.col("doc_id").eqNullSafe(F.col("b_doc_id")) & (F.abs(F.col("shift_a") - F.col("shift_b")) <= slack))
    met = near.select(*KEY, "item_key").union(lone).distinct()
    return join_checked(met, durable(items.select("item_key", "item_id"), "item-ids"), "item_key", "inner").select(*KEY, "item_id").distinct()


class Index:
    """The stored index of one corpus for one benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW):
        self.docs = keyed(docs, id_col, text)
        plain = durable(items_of(benchmark, item_id, item_text, window), "benchmark")
        self.items = durable(anchored(plain, term_counts(self.docs, plain)), "test-items")
        self.pairs = durable(anchor_pairs(self.items), "anchors")
        self.postings = build_index(self.docs, self.pairs, window - 1)

    def phrases(self) -> DataFrame:
        return phrase_hits(alignments(self.postings, self.pairs), self.items)

    def proximity(self, slack: int = SLACK) -> DataFrame:
        return proximity_hits(self.postings, self.pairs, self.items, slack)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, items (that have occurring windows) and n_near (how
    many items have a proximity match, exact ones included).

    Null and empty texts have no words; an empty benchmark hits nothing; repeated rows are judged
    each. Items that repeat an id are judged by each of their texts, and count once. Texts are searched whole, however
    long; columns beyond ids and texts are ignored, whatever their names; an empty table gives an empty one.
    """
    index = Index(docs, benchmark, id_col, text, item_id, item_text)
    exact = index.phrases().groupBy(*KEY).agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.collect_set("item_id").alias("items"))
    near = index.proximity().groupBy(*KEY).agg(F.count("*").alias("n_near"))
    same = lambda k: (F.col("text_key") == F.col(f"{k}_text_key")) & F.col("doc_id").eqNullSafe(F.col(f"{k}_doc_id"))
    named = lambda df, k: df.withColumnsRenamed({c: f"{k}_{c}" for c in KEY})
    near = durable(near, "near")
    hits = durable(near.join(named(exact, "hit"), same("hit"), "left").drop("hit_doc_id", "hit_text_key"), "hits")  # an exact occurrence is a near one, too
    sizes = index.postings.where(F.col("term") == END).select(*KEY, F.col("pos").cast("long").alias("n_words"))
    joined = join_checked(sizes, named(hits, "hit"), same("hit"), "left")
    none = F.lit(0).cast("long")
    items = F.coalesce("items", F.array().cast(hits.schema["items"].dataType)).alias("items")
    return joined.select(*KEY, "n_words", F.coalesce("n_hit", none).alias("n_hit"), items, F.coalesce("n_near", none).alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without rows that hold an exact occurrence of a test window; columns as they were."""
    bad = Index(docs, benchmark, id_col, text).phrases().select(F.col("doc_id").alias("__hl_id"), F.col("text_key").alias("__hl_key")).distinct()
    hit = (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__hl_key")) & F.col(id_col).eqNullSafe(F.col("__hl_id"))
    return join_checked(docs, durable(bad, "contaminated"), hit, "left_anti")
