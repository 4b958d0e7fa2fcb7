"""Queries of this subpackage: one per operator, over its whole table. QUERIES and ORACLE_SQL go by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import ann, decontam, exact_dedup, hard_negatives, langid, near_dedup, packing, pii, prefix_trie, secrets, token_counts, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rolled_up(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "kind", "label", "held_out", "score", "secret")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), pii.verdicts(F.col("judged")).alias("judged"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_filter.numbered_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_low", 6).alias("bad_low"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_keep")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_ALL = (
    op1_decontamination, op2_token_counts, op3_language, op4_secrets, op5_pii, op6_url_filter, op7_exact_dedup, op8_warc, op9_packing, op10_jaccard_join,
    op11_hard_negatives, op12_nearest, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS need FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, need, list_slice(w, s + 1, s + need) AS k FROM (SELECT item_id, w, need, unnest(range(len(w) - need + 1)) AS s FROM b)),
dw AS (SELECT doc_id, need, s, list_slice(w, s + 1, s + need) AS k
       FROM (SELECT doc_id, w, need, unnest(range(len(w) - need + 1)) AS s FROM d, (SELECT DISTINCT need FROM b) WHERE len(w) >= need)),
hit AS (SELECT doc_id, item_id, s, dw.need FROM dw JOIN win ON dw.k = win.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + need)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
bp AS (SELECT DISTINCT item_id, w, need, unnest(w) AS x, unnest(range(len(w))) AS p FROM b),
tn AS (SELECT t.x, count(dp.x) AS n FROM (SELECT DISTINCT x FROM bp) t LEFT JOIN dp ON lower(dp.x) = lower(t.x) GROUP BY t.x),
wp AS (SELECT item_id, w, need, s, bp.x, p, n, row_number() OVER (PARTITION BY item_id, w, s ORDER BY n, p) AS r
       FROM (SELECT item_id, w, need, x, p, unnest(range(greatest(0, p - need + 1), least(p, len(w) - need) + 1)) AS s FROM bp) bp JOIN tn USING (x)),
an AS (SELECT DISTINCT item_id, w, a.p AS p1, a.x AS x1, z.p AS p2, z.x AS x2 FROM (SELECT * FROM wp WHERE r = 1 AND n > 0) a LEFT JOIN (SELECT * FROM wp WHERE r = 2) z USING (item_id, w, s)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
  SELECT a.doc_id, item_id FROM an JOIN dp a ON a.x = x1 JOIN dp z ON z.x = x2 AND z.doc_id = a.doc_id AND abs((a.p - p1) - (z.p - p2)) <= 5
  UNION ALL SELECT a.doc_id, item_id FROM an JOIN dp a ON a.x = x1 WHERE x2 IS NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT unit, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
      FROM (SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\.$|\.?:[0-9]*$', '') AS unit, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\.html|/)?$', 1), '') AS BIGINT) AS doc_id FROM p)
      LEFT JOIN bad USING (doc_id) GROUP BY unit),
parts AS (SELECT *, string_split(unit, '.') AS l, regexp_matches(unit, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$') AS address,
  CASE WHEN array_to_string(list_slice(string_split(unit, '.'), -2, -1), '.') IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','ne.jp','or.jp','com.br','com.cn','co.in','co.kr','co.nz','co.za') THEN 2 ELSE 1 END AS k FROM h),
hs AS (SELECT unit, n, bad, CASE WHEN address THEN '(addresses)' ELSE array_to_string(list_slice(l, -k, -1), '.') END AS suffix,
  CASE WHEN address THEN unit ELSE array_to_string(list_slice(l, -k - 1, -1), '.') END AS domain FROM parts),
ds AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY domain, suffix),
a AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, greatest(1.0::DOUBLE, coalesce(sum(n), 0)) AS most FROM hs),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean, any_value(most) AS most FROM hs, a GROUP BY suffix),
sk AS (SELECT sum(n * (bad / n - mean) * (bad / n - mean) - mean * (1 - mean)) AS x, sum(mean * (1 - mean) * (n - 1)) AS w FROM s1 WHERE n > 1),
sr AS (SELECT suffix, most, (bad + k * mean) / (n + k) AS mean FROM s1, (SELECT CASE WHEN w > 0 AND x > 0 THEN least(a.most, greatest(1.0::DOUBLE, w / x - 1)) ELSE a.most END AS k FROM sk, a)),
d1 AS (SELECT domain, n, bad, mean, most FROM ds JOIN sr USING (suffix)),
dk AS (SELECT sum(n * (bad / n - mean) * (bad / n - mean) - mean * (1 - mean)) AS x, sum(mean * (1 - mean) * (n - 1)) AS w FROM d1 WHERE n > 1),
dr AS (SELECT domain, (bad + k * mean) / (n + k) AS mean FROM d1, (SELECT CASE WHEN w > 0 AND x > 0 THEN least(a.most, greatest(1.0::DOUBLE, w / x - 1)) ELSE a.most END AS k FROM dk, a)),
h1 AS (SELECT unit, n, bad, mean FROM hs JOIN dr USING (domain)),
hk AS (SELECT sum(n * (bad / n - mean) * (bad / n - mean) - mean * (1 - mean)) AS x, sum(mean * (1 - mean) * (n - 1)) AS w FROM h1 WHERE n > 1),
hp AS (SELECT unit, bad + k * mean AS a, n - bad + k * (1 - mean) AS b FROM h1, (SELECT CASE WHEN w > 0 AND x > 0 THEN least(a.most, greatest(1.0::DOUBLE, w / x - 1)) ELSE a.most END AS k FROM hk, a)),
hq AS (SELECT *, a / (a + b) AS r, (1 - 1 / (9 * b)) * (1 - 1 / (9 * b)) - 3.8416 / (9 * b) AS p, (1 - 1 / (9 * a)) * (1 - 1 / (9 * b)) AS q, (1 - 1 / (9 * a)) * (1 - 1 / (9 * a)) - 3.8416 / (9 * a) AS t FROM hp),
hr AS (SELECT unit, r, CASE WHEN p > 0 AND q * q - p * t >= 0 THEN a * f / (a * f + b) ELSE greatest(0.0::DOUBLE, r - 1.96 * sqrt(r * (1 - r) / (a + b + 1))) END AS low
       FROM (SELECT *, pow(greatest(0.0::DOUBLE, (q - sqrt(greatest(q * q - p * t, 0.0::DOUBLE))) / CASE WHEN p > 0 THEN p END), 3) AS f FROM hq)),
f AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, f.host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE CASE WHEN low > 0.3 THEN 'block' ELSE 'allow' END END AS verdict,
  round(r, 6) AS bad_rate, round(low, 6) AS bad_low
FROM f LEFT JOIN hr ON regexp_replace(regexp_replace(f.host, '^.*@', ''), ':[0-9]*$|\.$|\.?:[0-9]*$', '') = hr.unit""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_warc": """
WITH s AS (SELECT page_id, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS x FROM pages),
b32 AS (SELECT page_id, body, x FROM s)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || rpad(substr(x, (k * 5 // 4 + 1)::BIGINT, 3), 3, '0'))::BIGINT) >> (7 - (k * 5) % 4)) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM b32 WINDOW g AS (PARTITION BY x, strlen(body))""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_inner_product(a.x, e.x)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base,
  xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_transform(range(8), lambda k: ((ascii(s) >> k::INT) & 1)::BIGINT)))),
                              lambda x, b: xor(x >> 1, CASE WHEN (x & 1) <> b THEN 3988292384 ELSE 0 END))) % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, i AS d, role, text FROM c JOIN t ON t.conv_id = base AND i <= h
      UNION ALL SELECT c.conv_id, i - c.h + least(c.h, coalesce(b.own, 0)), role, text FROM c JOIN t USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE i > c.h),
k AS (SELECT conv_id, d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r UNION ALL SELECT conv_id, 0, '', '' FROM c),
g AS (SELECT *, min(conv_id) OVER w AS rep, count(*) OVER w AS n, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM k WINDOW w AS (PARTITION BY d, key)),
n AS (SELECT g.conv_id, g.d, g.n, p.rep AS parent, (g.n - 1) * CASE WHEN g.d > 0 THEN len(regexp_extract_all(g.text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
      FROM g LEFT JOIN g p ON p.conv_id = g.conv_id AND p.d = g.d - 1 WHERE g.conv_id = g.rep),
ch AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.rep AS conv_id, a.d, sum(saved)::BIGINT AS saved, count(*) FILTER (ch.c IS NULL) AS leaves FROM n LEFT JOIN ch USING (conv_id, d) JOIN g a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY ALL),
e AS (SELECT rep AS conv_id, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM g WHERE ends GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(c, 0) AS n_children, leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (conv_id, d) LEFT JOIN ch USING (conv_id, d) LEFT JOIN e USING (conv_id, d)""",
}
