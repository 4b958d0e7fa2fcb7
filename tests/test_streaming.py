"""File streams of reads."""

from helixlake.operators import evaluate
from helixlake.streaming import ingest


def test_reads_arrive_once_and_are_scored(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fasta").write_text(">Seq0\nACGTGGC\n>Seq1\nAAAA\n\n")
    rows = ingest.stream_reads(ingest.stream_lines(spark, str(src)))
    run = lambda: ingest.append_parquet(rows.select("file_id", "seq"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.fasta").write_text(">Seq0\nCCCCC\n")
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["seq"] for r in got.collect()) == ["AAAA", "ACGTGGC", "CCCCC"]
    assert evaluate.homopolymer(got).first()["longest_run"] == 5


def test_micro_batches_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("GGGG\nACGT\n")
    seen = {}
    reads = ingest.stream_reads(ingest.stream_lines(spark, str(src)))
    ingest.each_batch(reads, str(tmp_path / "cp"), lambda df, n: seen.update({n: sorted(r["seq"] for r in df.collect())})).awaitTermination()
    assert list(seen.values()) == [["ACGT", "GGGG"]]
    query = ingest.windowed_scores(reads).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("scores").first()
    assert (row["n"], row["mean_gc"], row["longest_run"], row["motifs"]) == (2, 75.0, 4, 0)
