"""Queries of encoding scores, read orders, result tables and clustering metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import seqfn
from helixlake.operators import assignment, cluster, evaluate, jobs, metrics, preprocess
from helixlake.plans.fixtures import ITEMS, READS, SMALL_READS, STRANDS, items, reads, small_items, small_reads, strands, strands_of, table
from helixlake.plans.q_sources import FASTA, fasta_lines
from helixlake.plans.registry import query

RUN = "list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x)))"
GC = "(length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq) * 100"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.octet_length(F.col("text")) * 8).cast("long").alias("bit_size"))


@query(f"""WITH {STRANDS}, f AS (SELECT file_id, count(*) AS n, arg_min(length(seq), pos) AS l FROM strands GROUP BY 1)
SELECT file_id, 8.0::DOUBLE * strlen(text) / (n * l) AS density FROM f JOIN documents ON doc_id = file_id""")
def eva1_density(spark, sf_dir):
    return evaluate.density(strands(spark, sf_dir), sizes(spark, sf_dir))


@query(f"WITH {STRANDS} SELECT file_id, greatest(1, max({RUN}))::BIGINT AS longest_run FROM strands GROUP BY 1")
def eva2_homopolymer(spark, sf_dir):
    return evaluate.homopolymer(strands(spark, sf_dir), "file_id")


@query(f"WITH {STRANDS} SELECT file_id, sum(len(regexp_extract_all(seq, 'GGC')) + len(regexp_extract_all(seq, 'GAATTC')))::BIGINT AS motifs FROM strands GROUP BY 1")
def eva3_motifs(spark, sf_dir):
    return evaluate.motifs(strands(spark, sf_dir), "file_id")


@query(f"WITH {STRANDS} SELECT file_id, pos, {GC} AS gc FROM strands")
def eva4_gc(spark, sf_dir):
    return evaluate.gc_percent(strands(spark, sf_dir))


@query(f"""WITH {STRANDS}, p AS (SELECT file_id, arg_min(seq, md5(concat_ws('|', '0', file_id::VARCHAR, pos::VARCHAR)) || lpad(pos::VARCHAR, 12, '0')) AS s FROM strands GROUP BY 1),
x AS (SELECT file_id, k * 6 AS prefix, substr(s, 1, k * 6) AS seq FROM p, (SELECT unnest(range(1, 26)) AS k))
SELECT file_id, prefix::INT AS prefix, {GC} AS gc FROM x""")
def eva5_local_gc(spark, sf_dir):
    return evaluate.local_gc(strands(spark, sf_dir))


@query()
def eva6_folding(spark, sf_dir):
    return evaluate.folding(strands(spark, sf_dir))


@query(f"""WITH {STRANDS}, f AS (SELECT file_id, count(*) AS n, arg_min(length(seq), pos) AS l, greatest(1, max({RUN})) AS r,
  sum(len(regexp_extract_all(seq, 'GGC')) + len(regexp_extract_all(seq, 'GAATTC'))) AS m FROM strands GROUP BY 1)
SELECT file_id, n::BIGINT AS n, r::BIGINT AS longest_run, m::BIGINT AS motifs, 8.0::DOUBLE * strlen(text) / (n * l) AS density FROM f JOIN documents ON doc_id = file_id""")
def eva7_report(spark, sf_dir):
    return evaluate.report(strands(spark, sf_dir), sizes(spark, sf_dir)).select("file_id", "n", "longest_run", "motifs", "density")


@query()
def eva7_report_json(spark, sf_dir):
    """One JSON object: files on the x axis, a series for each score; a file's folding energy is the mean of all its strands."""
    files = table(spark, sf_dir, "benchmark")
    rows = small_items(spark, sf_dir)
    size = files.select(F.col("item_id").alias("file_id"), (F.octet_length("text") * 8).cast("long").alias("bit_size"))
    energy = evaluate.folding(rows).groupBy("file_id").agg(F.round(F.avg("mfe"), 4).alias("mfe"))
    scores = evaluate.report(rows, size).join(energy, "file_id").join(evaluate.local_gc(rows).groupBy("file_id").agg(F.max("gc").alias("local_gc")), "file_id")
    return evaluate.report_json(scores)


@query(f"""WITH {STRANDS}, g AS (SELECT file_id, least(floor({GC} / 5) * 5, 95)::BIGINT AS bin, count(*) AS n FROM strands GROUP BY 1, 2)
SELECT file_id, bin, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY file_id) AS share FROM g""")
def eva8_gc_histogram(spark, sf_dir):
    return evaluate.gc_histogram(strands(spark, sf_dir))


@query(f"""WITH {STRANDS} SELECT lang, count(*) AS strands, round(avg({GC}), 6) AS mean_gc, greatest(1, max({RUN}))::BIGINT AS longest_run,
sum(len(regexp_extract_all(seq, 'GGC')) + len(regexp_extract_all(seq, 'GAATTC')))::BIGINT AS motifs FROM strands JOIN documents ON doc_id = file_id GROUP BY 1""")
def eva_report(spark, sf_dir):
    rows = strands_of(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    gc = seqfn.gc_fraction("seq") * 100
    return rows.groupBy("lang").agg(
        F.count("*").alias("strands"), F.round(F.avg(gc), 6).alias("mean_gc"), F.greatest(F.lit(1), F.max(seqfn.longest_run("seq"))).cast("long").alias("longest_run"), F.sum(evaluate.motif_count("seq")).cast("long").alias("motifs")
    )


@query(f"WITH {READS} SELECT read_id, seq, count(*) OVER (PARTITION BY seq) AS copies FROM reads")
def pre1_duplicate_sort(spark, sf_dir):
    return preprocess.by_duplicates(reads(spark, sf_dir)).select("read_id", "seq", "copies")


@query("SELECT doc_id AS read_id, abs(length(text) - 1000)::INT AS off FROM documents ORDER BY 2, 1")
def pre2_length_sort(spark, sf_dir):
    return preprocess.by_length(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")), 1000).select("read_id", "off")


@query("SELECT doc_id AS read_id, abs(length(text) - 1000)::INT AS off, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (ORDER BY abs(length(text) - 1000), copies DESC, doc_id) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM documents)".replace("count(*) OVER (PARTITION BY text) AS copies, row", "copies, row"))
def pre3_triple_sort(spark, sf_dir):
    rows = preprocess.by_length_and_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")), 1000)
    spread = rows.select("read_id", "off", "copies")
    from pyspark.sql import Window

    groups = spread.groupBy("off").agg(F.count("*").alias("c"))
    before = groups.select("off", F.coalesce(F.sum("c").over(Window.orderBy("off").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("off").orderBy(F.desc("copies"), "read_id"))
    return spread.withColumn("r", own).join(before, "off").select("read_id", "off", "copies", (F.col("r") + F.col("before")).alias("rank"))


@query("SELECT doc_id AS read_id, text AS seq FROM documents WHERE length(text) BETWEEN 990 AND 1010")
def pre4_length_band(spark, sf_dir):
    return preprocess.near_length(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")), 1000)


@query(f"WITH {FASTA} SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1)::BIGINT AS position, regexp_extract(line, 'Seq(\\d+)', 1)::INT AS seq_label FROM fasta WHERE line LIKE '>%'")
def pre5_position_labels(spark, sf_dir):
    return preprocess.position_labels(fasta_lines(spark, sf_dir))


RESULTS = """results AS (SELECT event_id AS id, props AS result, event_type AS "dataType", CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 2 = 0 THEN 'Segment length must be divisible by 2' ELSE 'boom' END AS error,
value < 10 AS is_valid, user_id AS "user" FROM events)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") != "error", "").when(F.col("event_id") % 2 == 0, jobs.KNOWN_ERRORS[0]).otherwise("boom")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("result"), F.col("event_type").alias("dataType"), error.alias("error"), (F.col("value") < 10).alias("is_valid"), F.col("user_id").alias("user"))


@query(f'WITH {RESULTS} SELECT "user", "dataType", id, result, error, is_valid FROM results QUALIFY row_number() OVER (PARTITION BY "user", "dataType" ORDER BY id DESC) = 1')
def job1_latest(spark, sf_dir):
    return jobs.latest(results(spark, sf_dir))


@query(f'WITH {RESULTS} SELECT "user", id, error, "dataType" FROM results WHERE NOT is_valid')
def job2_unread(spark, sf_dir):
    return jobs.unread(results(spark, sf_dir))


@query(f'WITH {RESULTS} SELECT id, result, "dataType", error, is_valid OR id IN (SELECT o_orderkey FROM orders) AS is_valid, "user" FROM results')
def job3_acknowledge(spark, sf_dir):
    return jobs.acknowledge(results(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query(f'WITH {RESULTS} SELECT id, result, "dataType", error, is_valid, "user" FROM results WHERE id = 77')
def job4_by_id(spark, sf_dir):
    return jobs.by_id(results(spark, sf_dir), 77)


@query(f'WITH {RESULTS} SELECT "dataType", count(*) * 2 AS n, sum(CASE WHEN error = \'\' THEN 0 ELSE 2 END)::BIGINT AS errors FROM results GROUP BY 1')
def job5_append(spark, sf_dir):
    from helixlake.durable import fresh_path

    path = fresh_path(spark, "results")
    rows = results(spark, sf_dir)
    jobs.append_results(rows, path)
    jobs.append_results(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("dataType").agg(F.count("*").alias("n"), F.sum(F.when(F.col("error") == "", 0).otherwise(1)).alias("errors"))


@query("""SELECT r.p_partkey AS request, i.p_partkey AS id, CASE WHEN i.p_partkey IS NULL THEN 'no such file' END AS error
FROM part r LEFT JOIN part i ON r.p_size = i.p_size AND i.p_name = r.p_name || CASE WHEN r.p_partkey % 2 = 1 THEN 'x' ELSE '' END""")
def job6_metadata(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("request"), F.col("p_size").alias("user"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 1, "x").otherwise("")).alias("file_name"))
    info = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("user"), F.col("p_name").alias("file_name"))
    return jobs.metadata_of(asked, info).select("request", "id", "error")


CLASH = """WITH r AS (SELECT c_custkey AS id, c_nationkey AS "user", c_mktsegment AS f FROM customer),
i AS (SELECT s_nationkey AS "user", ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1] AS f FROM supplier),
g AS (SELECT min(id) AS id FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i."user" = r."user" AND i.f = r.f) GROUP BY "user", f)"""


@query(CLASH + """ SELECT id, "user", f AS file_name, id IN (SELECT id FROM g) AS inserted FROM r""")
def job7_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user"), F.col("c_mktsegment").alias("file_name"))
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    info = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user"), F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("file_name"))
    fresh, clash = jobs.insertable(rows, info)
    return fresh.withColumn("inserted", F.lit(True)).unionByName(clash.withColumn("inserted", F.lit(False))).select("id", "user", "file_name", "inserted")


@query(f"WITH {RESULTS} SELECT id, CASE WHEN error IN ('', 'Segment length must be divisible by 2') THEN error ELSE 'internal error' END AS error FROM results")
def job8_masked(spark, sf_dir):
    return jobs.masked(results(spark, sf_dir)).select("id", "error")


PAIRS = "pairs AS (SELECT lang AS t, source AS p FROM documents), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM pairs GROUP BY 1, 2), a AS (SELECT t, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT p, sum(n) AS b FROM c GROUP BY 1), tot AS (SELECT sum(n) AS NN FROM c)"
MI = f"{PAIRS}, mi AS (SELECT sum(n / NN * ln(NN * n / (a * b))) AS mi FROM c JOIN a USING (t) JOIN b USING (p), tot), h AS (SELECT (SELECT -sum(a / NN * ln(a / NN)) FROM a, tot) AS ht, (SELECT -sum(b / NN * ln(b / NN)) FROM b, tot) AS hp)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("t"), F.col("source").alias("p"))


def scores(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    found = metrics.agreement(metrics.contingency(pairs(spark, sf_dir)), expected="ami" in names)
    return found.select(*[F.round(n, 9).alias(n) for n in names])


@query("SELECT i, coalesce(quality, -(row_number() OVER (PARTITION BY quality IS NULL ORDER BY i)))::BIGINT AS label FROM (SELECT doc_id AS i, quality FROM documents LEFT JOIN labels USING (doc_id))")
def met1_label_vector(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("label"))
    return metrics.filled_labels(spark.range(n).withColumnRenamed("id", "i"), labels)


@query(f"WITH {READS} SELECT (pos * 5 + copy)::BIGINT AS i, file_id, pos AS label FROM reads")
def met2_labels_from_clusters(spark, sf_dir):
    rows = reads(spark, sf_dir).groupBy("file_id", "pos").agg(F.collect_list((F.col("pos") * 5 + F.col("copy")).cast("long")).alias("members"))
    return rows.select("file_id", F.col("pos").alias("label"), F.explode("members").alias("i"))


@query("SELECT doc_id AS i, quality::BIGINT AS label FROM documents JOIN labels USING (doc_id) WHERE length(text) BETWEEN 590 AND 610")
def met3_labels_in_band(spark, sf_dir):
    rows = preprocess.near_length(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("seq")), 600)
    return rows.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("i"), F.col("quality").cast("long").alias("label"))


@query(f"WITH {MI} SELECT round(mi / ((ht + hp) / 2), 9) AS nmi FROM mi, h")
def met4_nmi(spark, sf_dir):
    return scores(spark, sf_dir, "nmi")


@query(f"""WITH {MI}, cells AS (SELECT a, b, NN, unnest(range(greatest(1, a + b - NN)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM a, b, tot),
e AS (SELECT sum(k / NN * ln(NN * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(NN - a + 1) + lgamma(NN - b + 1) - lgamma(NN + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(NN - a - b + k + 1))) AS emi FROM cells)
SELECT round((mi - emi) / ((ht + hp) / 2 - emi), 7) AS ami FROM mi, h, e""")
def met5_ami(spark, sf_dir):
    return scores(spark, sf_dir, "ami").select(F.round("ami", 7).alias("ami"))


PAIRED = f"{PAIRS}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(a * (a - 1) / 2) FROM a) AS qa, (SELECT sum(b * (b - 1) / 2) FROM b) AS qb, NN * (NN - 1) / 2 AS pn FROM tot)"


@query(f"WITH {PAIRED} SELECT round((s - qa * qb / pn) / ((qa + qb) / 2 - qa * qb / pn), 9) AS ari FROM q")
def met6_ari(spark, sf_dir):
    return scores(spark, sf_dir, "ari")


@query(f"WITH {PAIRED} SELECT round(s / sqrt(qa * qb), 9) AS fmi FROM q")
def met7_fmi(spark, sf_dir):
    return scores(spark, sf_dir, "fmi")


@query(f"WITH {MI} SELECT round(mi / ht, 9) AS homogeneity FROM mi, h")
def met8_homogeneity(spark, sf_dir):
    return scores(spark, sf_dir, "homogeneity")


@query(f"WITH {MI} SELECT round(mi / hp, 9) AS completeness FROM mi, h")
def met9_completeness(spark, sf_dir):
    return scores(spark, sf_dir, "completeness")


@query(f"WITH {MI} SELECT round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 9) AS v_measure FROM mi, h")
def met10_v_measure(spark, sf_dir):
    return scores(spark, sf_dir, "v_measure")


@query(f"WITH {PAIRS} SELECT round(sum(m) / max(NN), 9) AS purity FROM (SELECT p, max(n) AS m FROM c GROUP BY 1), tot")
def met11_purity(spark, sf_dir):
    return scores(spark, sf_dir, "purity")


_BEST = "CASE WHEN a.p = b.p OR a.p = c2.p OR a.p = d.p OR b.p = c2.p OR b.p = d.p OR c2.p = d.p THEN 0 ELSE a.n + b.n + c2.n + d.n END"


@query(f"""WITH {PAIRS}, ls AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM a), grid AS (SELECT k, b.p, coalesce(c.n, 0) AS n FROM ls, b LEFT JOIN c ON c.t = ls.t AND c.p = b.p)
SELECT round((SELECT max({_BEST}) FROM grid a, grid b, grid c2, grid d WHERE a.k = 1 AND b.k = 2 AND c2.k = 3 AND d.k = 4) / (SELECT max(NN) FROM tot), 9) AS accuracy""")
def met12_accuracy(spark, sf_dir):
    value = metrics.assignment_accuracy(metrics.contingency(pairs(spark, sf_dir)))
    return spark.createDataFrame([(round(value, 9),)], "accuracy double")


@query()
def met12_matching(spark, sf_dir):
    """The heaviest assignment of the strands of all documents to the clusters of their reads: as many labels as there are strands."""
    strand = F.concat_ws("-", F.col("file_id").cast("string"), F.col("pos").cast("string"))
    rows = reads(spark, sf_dir).select(strand.alias("t"), F.substring("seq", 1, 40).alias("p"))
    return assignment.best_matching(metrics.contingency(rows))


@query(f"""WITH {SMALL_READS}, d AS (SELECT a.file_id, a.pos, sum(levenshtein(a.seq, b.seq)) AS d FROM reads a JOIN reads b ON a.file_id = b.file_id AND a.pos = b.pos AND a.copy < b.copy GROUP BY 1, 2)
SELECT file_id || '-' || pos AS cluster, round(d / 10.0::DOUBLE, 9) AS distance FROM d""")
def met13_intra_distance(spark, sf_dir):
    rows = small_reads(spark, sf_dir).select(F.concat_ws("-", F.col("file_id").cast("string"), F.col("pos").cast("string")).alias("cluster"), F.col("copy").alias("member"), "seq")
    return metrics.intra_distance(rows).select("cluster", F.round("distance", 9).alias("distance"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_name AS s FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region),
d AS (SELECT sum(levenshtein(a.s, b.s)) AS d FROM c a JOIN c b ON a.k < b.k), k AS (SELECT count(*) AS k FROM c)
SELECT d::BIGINT AS total, d / k::DOUBLE - 1 AS as_published, d / (k * (k - 1) / 2.0::DOUBLE) AS mean FROM d, k""")
def met14_inter_distance(spark, sf_dir):
    centres = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("seq"))
    more = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("cluster"), F.col("r_name").alias("seq"))
    return metrics.inter_distance(centres.unionByName(more))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


@query("""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT a.id, a.label AS la, b.label AS lb, sum(list_distance(a.x, b.x)) AS d, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN la = lb AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN d / n END) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 7) AS silhouette FROM s""")
def met15_silhouette(spark, sf_dir):
    return metrics.silhouette(vectors(spark, sf_dir)).select(F.round("silhouette", 7).alias("silhouette"))


@query("""WITH v AS (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT k, avg(x) AS m FROM v GROUP BY 1), c AS (SELECT label, k, avg(x) AS c, count(*) AS n FROM v GROUP BY 1, 2)
SELECT round((SELECT sum(n * (c - m) * (c - m)) FROM c JOIN m USING (k)) * (max(n) - count(DISTINCT label)) / ((SELECT sum((x - c) * (x - c)) FROM v JOIN c USING (label, k)) * (count(DISTINCT label) - 1)), 6) AS calinski_harabasz
FROM (SELECT label, (SELECT count(*) FROM embeddings) AS n FROM embeddings)""")
def met16_calinski_harabasz(spark, sf_dir):
    return metrics.calinski_harabasz(vectors(spark, sf_dir)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("""WITH r AS (SELECT s_suppkey AS i, s_nationkey AS x, s_suppkey % 7 AS y, s_nationkey % 5 AS c FROM supplier), p AS (SELECT (a.x <> b.x)::INT + (a.y <> b.y)::INT AS d, (a.c = b.c)::INT AS same FROM r a JOIN r b ON a.i <> b.i)
SELECT sum((2 - 2 * d) * same + d)::DOUBLE AS ncc FROM p""")
def met17_category_cohesion(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 7).alias("y"), (F.col("s_nationkey") % 5).alias("c"))
    return metrics.categorical_cohesion(rows, ["x", "y"], "c")


@query(f"""WITH {READS}, w AS (SELECT DISTINCT seq FROM items), x AS (SELECT w.seq, count(r.seq) AS c FROM w LEFT JOIN reads r ON r.seq = w.seq GROUP BY 1), s AS (SELECT count(*) AS n, sum((c > 0)::INT) AS hit, sum(c) AS hits FROM x)
SELECT round(hit / n::DOUBLE, 9) AS fraction, round(hits / n::DOUBLE / (hit / n::DOUBLE), 9) AS redundancy FROM s""")
def met18_recovery(spark, sf_dir):
    return metrics.recovery(items(spark, sf_dir), reads(spark, sf_dir, columns=("seq",))).select(F.round("fraction", 9).alias("fraction"), F.round("redundancy", 9).alias("redundancy"))


@query(f"""WITH {SMALL_READS}, w AS (SELECT seq, min(file_id * 1000 + pos) AS pos FROM items GROUP BY 1), h AS (SELECT seq, count(*) AS c FROM reads GROUP BY 1),
m AS (SELECT h.seq, c, min(levenshtein(h.seq, w.seq)) AS d FROM h, w GROUP BY 1, 2) SELECT round(sum((1 - d / 100.0::DOUBLE) * c) / sum(c), 9) AS rate FROM m""")
def met19_reconstruction_rate(spark, sf_dir):
    originals = small_items(spark, sf_dir).select((F.col("file_id") * 1000 + F.col("pos")).alias("pos"), "seq")
    return metrics.mean_rate(metrics.reconstruction_rate(originals, small_reads(spark, sf_dir))).select(F.round("rate", 9).alias("rate"))


def metric_scores(spark, sf_dir):
    """Scores of two predicted label files, the sources and the languages themselves, against the languages."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select("lang", F.explode(F.array(F.struct(F.lit("source").alias("f"), F.col("source").alias("p")), F.struct(F.lit("lang").alias("f"), F.col("lang").alias("p")))).alias("x"))
    return metrics.agreement(metrics.contingency(both.select(F.col("x.f").alias("pred_file"), F.col("lang").alias("t"), F.col("x.p").alias("p")), "pred_file"), "pred_file")


SIX = ("nmi", "ari", "fmi", "homogeneity", "completeness", "purity")
REPORT = f"""{PAIRED}, mi AS (SELECT sum(n / NN * ln(NN * n / (a * b))) AS mi FROM c JOIN a USING (t) JOIN b USING (p), tot), h AS (SELECT (SELECT -sum(a / NN * ln(a / NN)) FROM a, tot) AS ht, (SELECT -sum(b / NN * ln(b / NN)) FROM b, tot) AS hp),
pu AS (SELECT sum(m) / max(NN) AS pu FROM (SELECT p, max(n) AS m FROM c GROUP BY 1), tot),
six AS (SELECT 'source' AS pred_file, mi / ((ht + hp) / 2) AS nmi, (s - qa * qb / pn) / ((qa + qb) / 2 - qa * qb / pn) AS ari, s / sqrt(qa * qb) AS fmi, mi / ht AS homogeneity, mi / hp AS completeness, pu AS purity FROM q, mi, h, pu
UNION ALL SELECT 'lang', 1, 1, 1, 1, 1, 1)"""


@query(f"WITH {REPORT} SELECT pred_file, {', '.join(f'round({n}, 6) AS {n}' for n in SIX)} FROM six")
def met20_metric_report(spark, sf_dir):
    return metric_scores(spark, sf_dir).select("pred_file", *[F.round(n, 6).alias(n) for n in SIX])


@query(f"""WITH {REPORT}, l AS (SELECT list(pred_file ORDER BY pred_file) AS f, {', '.join(f"list((round_even({n}, 3) + 0.0)::VARCHAR ORDER BY pred_file) AS {n}" for n in SIX)} FROM six)
SELECT '{{"pred_file":["' || array_to_string(f, '","') || '"]' || {' || '.join(f"""',"{n}":[' || array_to_string({n}, ',') || ']'""" for n in SIX)} || '}}' AS report FROM l""")
def met20_report_json(spark, sf_dir):
    """The report in its published form: a JSON object of columns, rounded to three digits."""
    return metrics.rounded_report(metric_scores(spark, sf_dir), *SIX)


@query(f"""WITH {READS}, k AS (SELECT file_id, pos, count(*) AS n FROM reads GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT seq) FROM items) AS originals, (SELECT count(*) FROM reads) AS reads, count(*) AS clusters, sum((n >= 5)::INT)::BIGINT AS good, sum((n < 5)::INT)::BIGINT AS bad FROM k""")
def met21_run_report(spark, sf_dir):
    rows = reads(spark, sf_dir)
    sizes_ = rows.groupBy("file_id", "pos").agg(F.count("*").alias("n"))
    one = sizes_.agg(F.sum("n").alias("reads"), F.count("*").alias("clusters"), F.sum((F.col("n") >= 5).cast("int")).alias("good"), F.sum((F.col("n") < 5).cast("int")).alias("bad"))
    return items(spark, sf_dir).agg(F.count_distinct("seq").alias("originals")).join(F.broadcast(one)).select("originals", "reads", "clusters", "good", "bad")


@query()
def met21_clustering_report(spark, sf_dir):
    """Counts of originals, reads and clusters at each stage of the hash-sketch clustering."""
    rows = small_reads(spark, sf_dir)
    return cluster.run_report(small_items(spark, sf_dir), rows)
