"""The pipeline against a plain version of its stages."""

import brute
from support import SF

import corpus_pipeline
from helixlake.llm import langid, packing


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.Classifier(langid.train(docs))
    left = {d: t for d, t in rows.items() if not model.predict(t)[2]}
    last = {}
    for d, t in sorted(left.items()):
        last[t] = d
    left = {d: t for t, d in last.items()}
    pairs = sorted(left.items())
    left = {d: t for (d, t), (c, _) in zip(pairs, brute.jaccard_classes(pairs), strict=True) if c == d}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: left[d] for d, _, n, _ in brute.contamination(sorted(left.items()), bench) if not n}
    out = corpus_pipeline.run(spark, SF).collect()
    encode = packing.encoder(packing.tokenizer_path())
    assert {r["doc_id"] for r in out} == set(left) and 0 < len(left) < len(rows)
    assert sum(r["length"] for r in out) == sum(len(encode(t)) + 1 for t in left.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns


LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
TEXTS = [
    (1, "the and of that with this was from there which one would all their has been"), (2, None), (3, ""), (4, "12 34"), (5, LONG), (6, LONG), (7, LONG + " tail"), (None, "the and of that with this from there"),
    (8, f"here {ITEM} there and of that"), (8, f"here {ITEM} there and of that"), (9, "the and of that with this was from there which one would all their has gone"), (10, "of that with this was from there and the"),
]


def odd_tables(spark, folder, rows):
    """documents of odd rows, with more columns that clash with names that the stages use, and a benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank int, digest string, text_key string, node int, score string, `a b` int"
    spark.createDataFrame([(i, t, "en" if k % 2 else None, None, k, 1, "d", "t", 2, "s", 3) for k, (i, t) in enumerate(rows)], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, TEXTS)
    key = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    got = {name: f(spark, docs, str(tmp_path)) for name, f in corpus_pipeline.STAGES[:-1]}
    assert all(df.schema == docs.schema for df in got.values())
    assert not {"2", "3", "4"} & {i for i, _ in key(got["language_id"])} and ("5", LONG) in key(got["language_id"])
    want = {}
    for i, t in TEXTS:
        want[t or ""] = max([want.get(t or "", -1), -1 if i is None else i])
    assert key(got["exact_dedup"]) == sorted(("None" if i < 0 else str(i), t) for t, i in want.items())
    classes = brute.jaccard_classes(TEXTS)
    assert key(got["ngram_jaccard_join"]) == sorted((str(d), t or "") for (d, t), (c, _) in zip(TEXTS, classes, strict=True) if not brute.words(t) or c == d)
    assert key(got["benchmark_decontamination"]) == sorted((str(d), t or "") for d, t in TEXTS if d != 8)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    encode = packing.encoder(packing.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(encode(t or "")) + 1 for _, t in TEXTS)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {1, 5, 6, 7, None, 9, 10} and sum(r["doc_id"] in (5, 6, 7) and r["piece"] == 0 for r in out) == 1


def test_an_empty_table_passes(spark, tmp_path):
    odd_tables(spark, tmp_path, TEXTS[:1]).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
